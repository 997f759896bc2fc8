"""Main text of web pages by wrapper induction.

Each page becomes a small tree of its structural elements; runs of text-level blocks are one node.
Trees of one host are aligned by simple tree matching into a wrapper. Pages are then laid on the
wrapper of their host to count how many of them have each node, and each text there. Recurring texts are template, the rest is content.
The content region is the outermost article or main elements, or else the whole page; what is
marked up as menu, advert, form, comments and the like is left out.

Pages are aligned where they are read: a task sends one wrapper per host and batch. Wrappers are
merged in two steps, so that a host with a third of all pages meets no single task.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_stats, staged

# HTML's element kinds, and words in class, id and role that mark what is not the article.
STRUCTURE = set("html body div section article main header footer nav aside form fieldset dialog template center table tbody thead tfoot details figure".split())
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre address tr figcaption summary caption hr hgroup".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp select svg math canvas object video audio".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head nav footer aside form button dialog template fieldset menu".split()) | RAW
HIDDEN_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CHROME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer "
    "sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay "
    "share sharing social related recommended recommendations comment comments disqus respond reply replies pagination pager toolbar masthead skip toc tags".split()
)
HEADER_WORDS = set("header topbar".split())
CONTENT_WORDS = set("article post entry content story main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARKING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
WORD = re.compile(r"[a-z]+")
#: Structural elements nested deeper than this belong to the node at that depth; no text is lost.
DEEPEST = 150


class Node:
    __slots__ = ("label", "children", "chrome", "blocks", "content")

    def __init__(self, label: str, chrome: bool = False, content: bool = False):
        self.label, self.chrome, self.content, self.children, self.blocks = label, chrome, content, [], []


@lru_cache(maxsize=8192)
def marks_of(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is not part of an article, and whether it looks like one."""
    if tag in DROPPED:
        return True, False
    if tag == "header" and not inside:
        return True, False
    content = tag in ("article", "main")
    if not attributes:
        return False, content
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    words = set(WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found.get("class", "") + " " + found.get("id", "")).lower()))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in HIDDEN_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, False
    if tag not in ("html", "body", "main") and (words & CHROME_WORDS and not (tag == "article" and not words & {"comment", "ad", "related", "promo"}) or not inside and words & HEADER_WORDS):
        return True, False
    return False, content or role in ("main", "article") or bool(words & CONTENT_WORDS) or found.get("itemprop", "").lower() == "articlebody"


def parse(page: str) -> Node:
    """The tree of structural nodes; a text node ("t") holds [text, characters in links] per block."""
    root = Node("root")
    stack: list[tuple[str, Node, bool]] = [("", root, False)]  # tag, node, hidden inline element
    hidden, link, inside, at, run = 0, 0, 0, 0, []

    def flush() -> None:
        nonlocal run
        if run:
            text = " ".join(html.unescape("".join(x for x, _ in run)).split())
            if text:
                node = stack[-1][1]
                last = node.children[-1] if node.children and node.children[-1].label == "t" else None
                if last is None:
                    last = Node("t")
                    node.children.append(last)
                last.blocks.append([text, sum(len(x) for x, linked in run if linked)])
            run = []

    def close(depth: int) -> None:
        nonlocal hidden, inside, link
        while len(stack) > depth:
            tag, node, was_hidden = stack[-1]
            if tag in STRUCTURE or tag in TEXT_BLOCKS:
                flush()
                link = 0
            stack.pop()
            hidden -= was_hidden
            inside -= node.content and node is not stack[-1][1]

    while True:
        m = TOKEN.search(page, at)
        if not hidden:
            chunk = page[at : m.start()] if m else page[at:]
            if chunk:
                run.append((chunk, link > 0))
        if not m:
            break
        at = m.end()
        end, tag, attributes = m[1], m[2] or m[4], m[3] or m[5] or ""
        if end:
            end = end.lower()
            if end == "a":
                link = 0
            if end in ("td", "th") and not hidden:
                run.append((" ", False))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == end:
                    close(depth)
                    break
                if stack[depth][0] in ("td", "th", "table") and end not in ("table", "tr", "tbody", "thead", "tfoot", "div", "section", "article", "main", "body", "html"):
                    break
            else:
                if end == "p":
                    flush()
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if attributes.rstrip().endswith("/") and tag in ("svg", "iframe", "script"):
                continue
            close_at = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if close_at:
                at = page.find(">", close_at.start()) + 1 or len(page)
            elif tag in ("script", "style", "textarea", "title"):
                at = len(page)
            continue
        if tag in VOID:
            if not hidden:
                if tag == "hr":
                    flush()
                else:
                    run.append((" ", False)) if tag == "br" else None
            continue
        block = tag in STRUCTURE or tag in TEXT_BLOCKS
        if block:  # an open paragraph ends where a block begins
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in STRUCTURE or stack[depth][0] in TEXT_BLOCKS:
                    break
        if tag in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in CLOSES[tag]:
                    close(depth)
                    break
                if stack[depth][0] in STRUCTURE or stack[depth][0] in ("ul", "ol", "dl"):
                    break
        if attributes and not MARKING.search(attributes):
            attributes = ""
        chrome, content = marks_of(tag, attributes, inside > 0)
        if tag == "a":
            link = 1
        if block or tag == "head":
            flush()
            if chrome or (tag in STRUCTURE or content) and len(stack) < DEEPEST:
                node = Node(("-" if chrome else "+" if content else "") + tag, chrome, content)
                stack[-1][1].children.append(node)
            else:
                node = stack[-1][1]
            stack.append((tag, node, False))
            inside += content and node is not stack[-2][1]
        elif chrome or tag in ("b", "i", "em", "strong", "span", "a", "td", "th"):
            stack.append((tag, stack[-1][1], chrome))
            hidden += chrome
    flush()
    return root


def key_of(text: str) -> int:
    return zlib.crc32(text.encode()) << 16 | len(text) & 0xFFFF


# A wrapper node: [label, pages, {text key: pages}, children]. While wrappers are merged they have no
# texts; texts and pages are counted when the wrapper of a host is done.


def as_wrapper(node: Node) -> list:
    """A page's tree as a wrapper of one page; neighbours with one label become one node."""
    kids: list = []
    for c in node.children:
        w = as_wrapper(c)
        if kids and kids[-1][0] == w[0]:
            join_in(kids[-1], w)
            on_one_page(kids[-1])
        else:
            kids.append(w)
    return [node.label, 1, {}, kids]


def on_one_page(w: list) -> None:
    w[1] = 1
    for c in w[3]:
        on_one_page(c)


def size(w: list) -> int:
    return 1 + sum(map(size, w[3]))


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the largest number of nodes that two trees share with order and
    parents kept, and the pairs of children in it."""
    if a[0] != b[0]:
        return 0, []
    ka, kb = a[3], b[3]
    if [x[0] for x in ka] == [x[0] for x in kb]:
        return 1 + sum(match(x, y)[0] for x, y in zip(ka, kb, strict=True)), [(i, i) for i in range(len(ka))]
    table = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
    took = {}
    for i, x in enumerate(ka):
        for j, y in enumerate(kb):
            w = match(x, y)[0]
            best = max(table[i][j + 1], table[i + 1][j])
            if w and table[i][j] + w > best:
                best = table[i][j] + w
                took[i, j] = True
            table[i + 1][j + 1] = best
    pairs, i, j = [], len(ka), len(kb)
    while i and j:
        if (i - 1, j - 1) in took and table[i][j] > max(table[i - 1][j], table[i][j - 1]):
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return 1 + table[-1][-1], pairs[::-1]


def pairs_of(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Which of two lists of trees simple tree matching pairs."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [(i, i) for i in range(len(a))]
    return match([0, 0, 0, a], [0, 0, 0, b])[1]


def join_in(a: list, b: list) -> None:
    """Merges wrapper b into a: matched nodes add up, others are inserted in order."""
    a[1] += b[1]
    pairs = pairs_of(a[3], b[3])
    kids, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[3]), len(b[3]))]:
        kids += a[3][i:x] + b[3][j:y]
        if x < len(a[3]):
            join_in(a[3][x], b[3][y])
            kids.append(a[3][x])
        i, j = x + 1, y + 1
    a[3] = kids


def merged(wrappers: list[list]) -> list:
    """One wrapper; those with more pages first, so that the order of arrival hardly matters."""
    wrappers = sorted(wrappers, key=lambda w: (-w[1], -size(w), json.dumps(w, sort_keys=True)))
    for w in wrappers[1:]:
        join_in(wrappers[0], w)
    return wrappers[0]


def packed(w: list) -> bytes:
    return zlib.compress(json.dumps(w, separators=(",", ":")).encode(), 1)


def unpacked(raw: bytes) -> list:
    w = json.loads(zlib.decompress(raw))

    def numbers(x: list) -> None:
        x[2] = {int(k): n for k, n in x[2].items()}
        for c in x[3]:
            numbers(c)

    numbers(w)
    return w


WRAPPERS = "host string, part int, wrapper binary"


def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper per host and batch; pages of equal source count once in it."""
    for batch in batches:
        hosts: dict[str, list] = {}
        seen, part = set(), 0
        for host, raw in zip(batch.column("host"), batch.column("html"), strict=True):
            host, raw = host.as_py(), raw.as_py()
            h = hash(raw)
            if raw is None or (host, h) in seen:
                continue
            seen.add((host, h))
            part ^= zlib.crc32(raw[:200].encode(errors="replace"))
            w = as_wrapper(parse(raw))
            if host in hosts:
                join_in(hosts[host], w)
            else:
                hosts[host] = w
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([part % 64] * len(hosts), pa.int32()), pa.array([packed(w) for w in hosts.values()], pa.binary())], names=["host", "part", "wrapper"])


def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        filled = []
        for w, counts in zip(batch.column("wrapper").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            filled.append(packed(with_counts(unpacked(w), [(c["place"], c["text"], c["pages"]) for c in counts or ()])))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(filled, pa.binary())], names=["host", "wrapper"])


def merge_group(rows: pd.DataFrame) -> pd.DataFrame:
    whole = merged([unpacked(bytes(x)) for x in rows["wrapper"]])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [rows["part"].iloc[0]], "wrapper": [packed(whole)]})


def aligned(node: Node, w: list, out: list[tuple[Node, list]]) -> list[tuple[Node, list]]:
    """The nodes of a page and the wrapper nodes that they stand at."""
    out.append((node, w))
    groups: list[list[Node]] = []
    for c in node.children:
        if groups and groups[-1][0].label == c.label:
            groups[-1].append(c)
        else:
            groups.append([c])
    if [g[0].label for g in groups] == [c[0] for c in w[3]]:
        pairs = [(i, i) for i in range(len(groups))]
    else:
        pairs = pairs_of(as_wrapper(node)[3], w[3])
    for i, j in pairs:
        for c in groups[i]:
            aligned(c, w[3][j], out)
    return out


def template_of(root: Node, wrapper: list, least: int, share: float) -> set[int]:
    """Ids of blocks whose text recurs on more than `share` of the pages that have the place."""
    return {id(b) for node, w in aligned(root, wrapper, []) if w[1] >= least for b in node.blocks if w[2].get(key_of(b[0]), 0) > share * w[1]}


def in_order(w: list, out: list[list]) -> list[list]:
    out.append(w)
    for c in w[3]:
        in_order(c, out)
    return out


def places_of(page: str, wrapper: list) -> set[tuple[int, int]]:
    """(place, text key) of all blocks of a page, each once, and (place, -1) for each place it has;
    a place is the number of a wrapper node."""
    number = {id(w): i for i, w in enumerate(in_order(wrapper, []))}
    out = set()
    for node, w in aligned(parse(page), wrapper, []):
        out.add((number[id(w)], -1))
        out.update((number[id(w)], key_of(b[0])) for b in node.blocks)
    return out


def with_counts(wrapper: list, counts: list) -> list:
    """The wrapper with the pages of its places and of the texts that recur there."""
    nodes = in_order(wrapper, [])
    for w in nodes:
        w[1], w[2] = 0, {}
    for place, text, pages in counts or ():
        if text == -1:
            nodes[place][1] = pages
        else:
            nodes[place][2][text] = pages
    return wrapper


def counted(rows: DataFrame, wrappers: DataFrame, least: int, share: float) -> DataFrame:
    """(host, counts): how many different pages have each place, and each text that is on more
    than `share` of them there, exactly. Pages of equal source count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list] = {}
        for batch in batches:
            items = []
            for raw, w in zip(batch.column("html"), batch.column("wrapper"), strict=True):
                w = w.as_py()
                if w not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[w] = unpacked(w)
                items.append([{"place": p, "text": t} for p, t in places_of(raw.as_py(), known[w])])
            kind = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(items, kind)], names=["host", "page", "items"])

    joined = join_stats(rows.filter("html is not null").select("host", "html", F.xxhash64("html").alias("page")), wrappers, "host", "page", most=2_000)
    items = joined.filter("wrapper is not null").select("host", "page", "html", "wrapper").mapInArrow(run, "host string, page long, items array<struct<place:int,text:long>>")
    once = items.groupBy("host", "page").agg(F.first("items").alias("items")).select("host", F.inline("items"))
    # no text on fewer pages than this can recur
    counts = staged(once.groupBy("host", "place", "text").agg(F.count("*").alias("pages")).filter((F.col("text") == -1) | (F.col("pages") > share * least)))
    whole = counts.filter("text = -1").select("host", "place", F.col("pages").alias("of"))
    recurring = counts.join(whole, ["host", "place"]).filter((F.col("of") >= least) & ((F.col("text") == -1) | (F.col("pages") > share * F.col("of"))))
    return recurring.groupBy("host").agg(F.collect_list(F.struct("place", "text", "pages")).alias("counts"))


def good_text(node: Node, template: set[int]) -> int:
    """Characters outside links that are neither chrome nor template."""
    if node.chrome:
        return 0
    return sum(max(0, len(b[0]) - b[1]) for b in node.blocks if id(b) not in template) + sum(good_text(c, template) for c in node.children)


def outermost(node: Node, found: list[Node]) -> list[Node]:
    for c in node.children:
        if c.chrome:
            continue
        if c.content and c.label not in ("+html", "+body"):
            found.append(c)
        else:
            outermost(c, found)
    return found


def region_of(root: Node, template: set[int]) -> list[Node]:
    """The nodes that hold the article: all outermost ones marked up as content that hold varying
    text, or the whole page. What is not chrome or template in them is the article."""
    return [c for c in outermost(root, []) if good_text(c, template)] or [root]


def blocks_of(node: Node, template: set[int], out: list[str]) -> None:
    if node.chrome:
        return
    linked = sum(b[1] >= 0.8 * len(b[0]) for b in node.blocks)
    links_only = linked >= 3 and linked == len(node.blocks)  # a list of links
    for b in node.blocks:
        if id(b) not in template and not links_only:
            out.append(b[0])
    for c in node.children:
        blocks_of(c, template, out)


def main_text(page: str | None, wrapper: list | None, least: int = 4, share: float = 0.5) -> str:
    """The page's article: blocks joined by two newlines."""
    if not page:
        return ""
    root = parse(page)
    template: set[int] = set()
    if wrapper is not None:
        template = template_of(root, wrapper, least, share)
    out: list[str] = []
    for node in region_of(root, template):
        blocks_of(node, template, out)
    if not out and template:  # all of it recurs, as when a host has only copies of one page
        for node in region_of(root, set()):
            blocks_of(node, set(), out)
    return "\n\n".join(out)


def extract(pages: DataFrame, least: int = 4, share: float = 0.5) -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points of text).

    A null or empty html gives an empty text. Pages without a host (null or odd url) form one host.
    Whole pages are read and no block is capped. Unclosed elements, comments and raw text elements
    end where HTML parsers end them. Repeated rows get equal results; on a host of copies, what
    recurs is not taken for template. An empty table gives no rows. Other columns are not read.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    sent = rows.select("host", "html").mapInArrow(induce, WRAPPERS)
    merged_ = sent.groupBy("host", "part").applyInPandas(merge_group, WRAPPERS)
    wrappers = staged(merged_.groupBy("host").applyInPandas(merge_group, WRAPPERS).select("host", "wrapper"))
    wrappers = wrappers.join(counted(rows, wrappers, least, share), "host", "left").select("host", "wrapper", "counts").mapInArrow(fill, "host string, wrapper binary")
    # a wrapper takes some kilobytes: 2,000 of them may be broadcast
    joined = join_stats(rows, wrappers, "host", "page_id", most=2_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list] = {}
        for batch in batches:
            texts = []
            for raw, w in zip(batch.column("html"), batch.column("wrapper"), strict=True):
                w = w.as_py()
                if w is not None and w not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[w] = unpacked(w)
                texts.append(main_text(raw.as_py(), known.get(w), least, share))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
