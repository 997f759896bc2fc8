"""N-gram Jaccard join by grouped prefixes.

Documents are sets of hashed word shingles. Two sets of at least 75 % Jaccard similarity share a
shingle among the rarest quarter of either (its prefix, ordered by the number of documents that
have the shingle). Documents with equal prefixes and sizes form a group; pairs of groups that share a prefix
shingle are filtered by size, by the place of that shingle and by bitmaps of the sets, expanded to members,
and verified on whole sets.

Classes of near duplicates hold thousands of documents, and one verified link joins two components, so
the join is made in rounds. First each set meets its next neighbours in the lists of its prefix shingles, and
the nearest ones there of other components. Then groups of different components are paired, all of them; of each pair of components a few members are
verified first, more where those do not link, and in the last round all. No pair that could
still join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import bounded, boxed, join_stats, quoted, staged
from .components import components
from .windows import SENT, U, in_chunks, mix, read_words, runs_of, scale_of

COUNTS = "chunk int, bucket int, counts binary"
SETS = "doc_id long, text_hash long, node long, check long, n long, keys binary, prefix array<long>, bits array<long>"


def shingle_sets(texts: pa.ChunkedArray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and where each text's begin.

    ASCII letters count as lower case. A text of fewer than `size` words has its whole sequence as
    one shingle; a null or blank one has none.
    """
    words = read_words(texts, lower=True)
    n = np.diff(words.first)
    at = words.starts(size)
    keys = [words.windows(size)[at]]
    doc = [np.searchsorted(words.first, at, side="right") - 1]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            keys.append(words.windows(k)[words.first[short]])
            doc.append(short)
    keys, doc = np.concatenate(keys), np.concatenate(doc)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(n) + 1))


def set_ids(keys: np.ndarray, first: np.ndarray, seed: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A hash of each set; equal for equal sets."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(keys ^ U(seed)), dtype=U)])
    n = np.diff(first).astype(U)
    return mix(sums[first[1:]] - sums[first[:-1]] + n * U(0x9E3779B97F4A7C15)).view(np.int64)


def second_ids(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """An independent hash of each set, which tells sets apart whose first hashes agree."""
    return set_ids(keys, first, 0x2545F4914F6CDD1D)


def first_of_each(*ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids[0]), bool)
    out[np.unique(np.stack(ids), axis=1, return_index=True)[1] if len(ids) > 1 else np.unique(ids[0], return_index=True)[1]] = True
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key and its place there in 32 bits; both keep the order of the keys."""
    low = ((keys & U(2**32 - 1)) * U(buckets)) >> U(32)
    x = (keys >> U(32)) * U(buckets) + low
    return x >> U(32), (x & U(2**32 - 1)).astype("<u4")


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers as all their first bytes, then all their second: small ones compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(memoryview(x.as_buffer()), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1) for x in column]


def send_shingles(chunk: int, docs: pa.Table, buckets: int) -> pa.Table:
    """Each shingle once with the number of different sets here that have it, in order."""
    keys, first = shingle_sets(docs.column("text"))
    once = np.repeat(first_of_each(set_ids(keys, first), second_ids(keys, first)), np.diff(first))
    keys, counts = np.unique(keys[once], return_counts=True)
    bucket, place = bucket_of(keys, buckets)
    at = np.searchsorted(bucket, np.arange(buckets + 1).astype(U))
    used = np.flatnonzero(np.diff(at))
    return pa.table(
        [
            pa.array(used, pa.int32()),
            pa.array(np.full(len(used), chunk), pa.int32()),
            pa.array([planes(np.diff(place[at[b] : at[b + 1]], prepend=place.dtype.type(0))) for b in used], pa.binary()),
            pa.array([planes(counts[at[b] : at[b + 1]]) for b in used], pa.binary()),
        ],
        names=["bucket", "chunk", "keys", "notes"],
    )


def count_shingles(rows: pa.Table) -> pa.Table:
    """For every chunk, how many sets have each of the shingles it sent, in the order it sent them.

    Shingles of a bucket that agree in 32 bits count as one: the number is too high for both,
    in every chunk alike, so the order of shingles stays the same everywhere.
    """
    places = [np.cumsum(x, dtype="<u4") for x in unplaned(rows.column("keys"))]
    counts = np.concatenate(unplaned(rows.column("notes")))
    order, runs, run = runs_of(np.concatenate(places))
    total = np.zeros(len(order), "<u4")
    total[order] = np.minimum(np.add.reduceat(counts[order].astype(np.int64), runs), 2**32 - 1)[run]
    cuts = np.cumsum([len(x) for x in places])[:-1]
    return pa.table([rows.column("chunk").combine_chunks(), rows.column("bucket").combine_chunks(), pa.array([planes(x) for x in np.split(total, cuts)], pa.binary())], names=["chunk", "bucket", "counts"])


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any set it links to."""
    return -(-percent * n // 100)


def bitmap(keys: np.ndarray, words: int = 4) -> np.ndarray:
    """Each key turns over one of 64 * `words` bits. Two sets differ in at least as many keys as their
    bitmaps differ in bits."""
    bits = np.bincount((mix(keys ^ U(0x632BE59BD9B4E019)) % U(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def find_prefixes(docs: pa.Table, replies: pa.Table, percent: int, node_bits: int = 64) -> pa.Table:
    """Every document's set id and size; for those that can link at all, once per set, its shingles
    and the part of its prefix that others have too."""
    keys, first = shingle_sets(docs.column("text"))
    node, check, n = set_ids(keys, first) >> (64 - node_bits), second_ids(keys, first), np.diff(first)
    sent, at = np.unique(keys, return_inverse=True)
    told = unplaned(replies.sort_by("bucket").column("counts"))
    counts = np.concatenate([np.zeros(0, "<u4"), *told]).astype(np.int64)
    if len(counts) != len(sent):
        raise ValueError("a chunk's shingles and their counts do not match")
    count = counts[at]
    doc = np.repeat(np.arange(len(n)), n)
    shared = np.bincount(doc, weights=count > 1, minlength=len(n)).astype(np.int64)
    need = needed(n, percent)
    carries = (n > 0) & (shared >= need) & first_of_each(node, check)
    raw, prefixes, bits = [], [], []
    for i in range(len(n)):
        if not carries[i]:
            raw.append(None), prefixes.append(None), bits.append(None)
            continue
        a, b = first[i], first[i + 1]
        raw.append(keys[a:b].astype("<u8").tobytes())
        bits.append(bitmap(keys[a:b]))
        order = np.lexsort((keys[a:b], count[a:b]))[: n[i] - need[i] + 1]
        prefixes.append(keys[a:b][order][count[a:b][order] > 1].view(np.int64))
    return pa.table(
        [docs.column("doc_id").combine_chunks(), docs.column("text_hash").combine_chunks(), pa.array(node), pa.array(check), pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
        names=["doc_id", "text_hash", "node", "check", "n", "keys", "prefix", "bits"],
    )


def same_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, as sorted distinct keys, link."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def keys_in(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(memoryview(v.as_buffer()), "<u8") for v in column]


def beside(token: np.ndarray, c: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in sorted lists: each with the next `width` ones of its list, or, with components c, with
    the nearest ones before and after that are of another component."""
    n = len(token)
    if c is None:
        for k in range(1, width + 1):
            i = np.arange(max(0, n - k))
            yield i, i + k
        return
    new = np.ones(n, bool)
    new[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    i = np.arange(n)
    after = np.append(starts, n)[run + 1] if n else i
    yield i[after < n], after[after < n]
    first = starts[run] if n else i
    yield first[first > 0] - 1, i[first > 0]


#: Seeds of the orders in which prefix lists are sorted.
ORDERS = mix(np.arange(1, 17, dtype=U) * U(0x9E3779B97F4A7C15))


def least_hashes(prefix: np.ndarray) -> np.ndarray:
    """For each order, the three least hashes of a prefix (the greatest number where it has fewer), as signed numbers."""
    hashes = np.sort(mix(prefix[None, :] ^ ORDERS[:, None]), axis=1)[:, :3]
    return np.pad(hashes, ((0, 0), (0, 3 - hashes.shape[1])), constant_values=2**64 - 1).view(np.int64)


def list_pairs(sets: DataFrame, percent: int, c: str | None = None, width: int = 2, most: int = 3, piece: int = 50_000) -> DataFrame:
    """Pairs (a, b) of sets near each other in the list of a shingle that both have in their prefix, if sizes and
    bitmaps let them link; for each a the `most` of them whose bitmaps differ least. With a column c of
    components, only pairs of different ones.

    Each list is sorted by the least hashes of prefixes, in one of several orders of hashes, so that prefixes with much in
    common are near in some of their lists. Ranges of the order are the tasks, so a list may be long; it is looked at in pieces."""
    names = ["node", "token", "n", *([c] if c else [])]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for lo in range(0, whole.num_rows, piece):
                batch = whole.slice(lo, piece)
                now = [np.asarray(batch.column(x)) for x in names] + [np.asarray(batch.column("bits").flatten()).reshape(-1, 4).view(U)]
                now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
                node, token, n, bits = now[0], now[1], now[2], now[-1]
                out = []
                for i, j in beside(token, now[3] if c else None, width):
                    x, y = n[i], n[j]
                    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                    least = -(-percent * (x + y) // (100 + percent))
                    good = (token[i] == token[j]) & (node[i] != node[j]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (apart <= x + y - 2 * least)
                    if c:
                        good &= now[3][i] != now[3][j]
                    out.append((node[i][good], node[j][good], apart[good]))
                held = [x[-width:] for x in now]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "apart"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2_000):
                batch = whole.slice(lo, 2_000)
                prefix = [np.asarray(p.values).view(U) for p in batch.column("prefix")]
                token = np.concatenate([np.zeros(0, U), *prefix])
                row = np.repeat(np.arange(batch.num_rows), [len(p) for p in prefix])
                signs = np.stack([least_hashes(p) for p in prefix])[row, (token % U(len(ORDERS))).astype(np.int64)] if len(row) else np.zeros((0, 3), np.int64)
                columns = [batch.column(x).take(pa.array(row)) for x in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(token.view(np.int64)), *(pa.array(np.ascontiguousarray(signs[:, i])) for i in range(3))], names=[*kept, "token", "s0", "s1", "s2"])

    kept = ["node", "n", "bits", "g", *([c] if c else [])]
    kinds = "".join(f", {x} {'array<long>' if x == 'bits' else 'long'}" for x in kept)[2:]
    slim = sets.filter(F.size("prefix") > 0).withColumn("g", F.xxhash64("n", "prefix")).select(*kept, "prefix")
    posts = slim.mapInArrow(post, f"{kinds}, token long, s0 long, s1 long, s2 long")
    order = ("token", "s0", "s1", "s2", "n", "g", "node")
    near = posts.repartitionByRange(*order).sortWithinPartitions(*order).select(*names, "bits").mapInArrow(compare, "a long, b long, apart long")
    best = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("apart", "b"))), 1, most).alias("best"))
    return best.select("a", F.explode("best.b").alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def with_keys(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """`pairs` with the keys of their set on one side. A set that stands in very many pairs is spread: each
    pair takes one of as many copies as needed."""
    heavy = pairs.groupBy(side).agg(F.floor(F.count("*") / 256).cast("int").alias("copies"))
    spread = sets.select(F.col("node").alias(side), F.col("keys").alias(f"k{side}")).join(heavy, side).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies"))))
    salted = pairs.join(heavy, side).withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("copies") + 1).cast("int")).drop("copies")
    return salted.join(spread.select(side, "salt", f"k{side}"), [side, "salt"]).drop("salt")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link."""
    rows = with_keys(with_keys(pairs.select("a", "b"), sets, "a"), sets, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [same_enough(x, y, percent) for x, y in zip(keys_in(batch.column("ka")), keys_in(batch.column("kb")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes n and bitmaps (null: unknown) let two sets link."""
    a, b = F.col(f"n{x}"), F.col(f"n{y}")
    apart = reduce(lambda s, c: s + c, [F.bit_count(F.col(f"bits{x}")[i].bitwiseXOR(F.col(f"bits{y}")[i])) for i in range(4)])
    # the sets differ in a + b - 2 * overlap keys
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.coalesce(apart, F.lit(0)) <= a + b - 2 * overlap(a, b, percent))


def overlap(a: Column, b: Column, percent: int) -> Column:
    """The least overlap with which sets of these sizes link."""
    return F.ceil(percent * (a + b) / (100 + percent))


def part_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of parts (g1, c1, g2, c2, apart) of different components that share a prefix shingle and may link.

    `members` are nodes with their group g and component c; what a group has in one component is a
    part. `apart` tells how far the bitmaps of two of their members differ.
    """
    one = F.count("*") == 1
    parts = members.groupBy("g", "c").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.when(one, F.first("bits")).alias("bits"), F.min_by("bits", "node").alias("some"))
    # shingles that only one document has come first in a prefix and are not listed
    at = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - F.size("prefix")
    posts = staged(parts.select("g", "c", "n", "bits", "some", (F.col("n") - at).alias("rest"), F.posexplode("prefix").alias("i", "token")).withColumn("rest", F.col("rest") - F.col("i")).drop("i"))
    # a shingle with one component only has nothing to find; the parts of one are paired block by block, so
    # that it meets many tasks
    cut = posts.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / 1024).cast("int").alias("cuts")).filter("lo < hi").select("token", "cuts")
    left = join_stats(posts, cut, "token", ["g", "c"]).filter("cuts is not null")
    names = ("g", "c", "n", "bits", "some", "rest")
    mine, every = F.pmod(F.xxhash64("g", "c"), F.col("cuts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    x = left.select("token", mine.alias("p"), every.alias("q"), *[F.col(c).alias(f"{c}1") for c in names])
    y = left.select("token", every.alias("p"), mine.alias("q"), *[F.col(c).alias(f"{c}2") for c in names])
    # from the first shared shingle on, both sets must still hold the overlap
    enough = F.least("rest1", "rest2") >= overlap(F.col("n1"), F.col("n2"), percent)
    apart = reduce(lambda s, c: s + c, [F.bit_count(F.col("some1")[i].bitwiseXOR(F.col("some2")[i])) for i in range(4)])
    return x.join(y, ["token", "p", "q"]).filter((F.col("c1") < F.col("c2")) & enough & may_link("1", "2", percent)).select("g1", "c1", "g2", "c2", apart.alias("apart")).distinct()


def expanded(found: DataFrame, members: DataFrame, percent: int, most: int | None) -> DataFrame:
    """(a, b, now1, now2): the pairs of members of pairs of parts that may link, of each part the first `most`."""
    some = members if most is None else members.filter(F.col("place") <= most)
    for k, c in ((1, "a"), (2, "b")):
        found = found.join(some.select(F.col("g").alias(f"g{k}"), F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"), F.col("node").alias(c)), [f"g{k}", f"c{k}"])
    return found.filter(may_link("1", "2", percent)).select("a", "b", "now1", "now2")


def relabelled(found: DataFrame, joined: DataFrame) -> DataFrame:
    """`found` with components now1 and now2 as the links between components in `joined` (a, b) leave them; pairs
    that have come into one go."""
    label = components(joined)
    for k in (1, 2):
        found = found.join(label.select(F.col("node").alias(f"now{k}"), F.col("label").alias("to")), f"now{k}", "left").withColumn(f"now{k}", F.coalesce("to", f"now{k}")).drop("to")
    return found.filter("now1 <> now2")


def in_components(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """`sets` with their component c, which is the node itself where no edge meets it."""
    label = components(edges).select("node", F.col("label").alias("c"))
    return sets.join(label, "node", "left").withColumn("c", F.coalesce("c", "node"))


def links(sets: DataFrame, percent: int, rounds: tuple = ((4, 2), (None, None))) -> DataFrame:
    """Edges (a, b) between linked nodes that connect whatever the full join would connect.

    Sets meet their neighbours in the lists of their prefix shingles first, then the nearest ones of other
    components. Each of `rounds` says how many pairs of parts of two components are verified, the nearest first, and how many
    members of a part; None is all. Later rounds look only at what is still apart.
    """
    slim = sets.select("node", "n", "prefix", "bits")
    edges = staged(verify(list_pairs(slim, percent), sets, percent))
    across = list_pairs(staged(in_components(slim, edges)), percent, "c")
    edges = edges.unionByName(staged(verify(across, sets, percent)))
    place = F.row_number().over(Window.partitionBy("g", "c").orderBy("node"))
    members = staged(in_components(slim.withColumn("g", F.xxhash64("n", "prefix")), edges).withColumn("place", place))
    found = staged(part_pairs(members, percent).withColumns({"now1": F.col("c1"), "now2": F.col("c2")}))
    members = members.drop("prefix")
    for parts, most in rounds:
        n_found = found.count()
        if not n_found:
            break
        between = Window.partitionBy(F.least("now1", "now2"), F.greatest("now1", "now2")).orderBy("apart", "g1", "g2")
        some = found if parts is None else found.withColumn("nth", F.row_number().over(between)).filter(F.col("nth") <= parts).drop("nth")
        pairs = staged(expanded(bounded(some, n_found), members, percent, most))
        new = staged(verify(pairs.select("a", "b").distinct(), sets, percent))
        edges = edges.unionByName(new)
        if parts is None:
            break
        met = pairs.join(bounded(new, new.count()), ["a", "b"], "left_semi").select(F.col("now1").alias("a"), F.col("now2").alias("b"))
        found = staged(relabelled(found, met))
    return edges


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id that links
    reach (itself without links); text_hash (xxhash64 of the text) tells rows of one id apart.

    Two documents link when 100 * intersection >= percent * union of their sets of five-word
    shingles. Equal sets link. Null and blank texts have no shingles and link with nothing, not even
    one another. Rows that share an id are documents of their own; a null id joins components, whose
    smallest id is then that of the others (null if there is none). An empty table gives no rows.
    Other columns are not read. Shingles are compared by 64-bit hashes, equal sets by 128 bits.
    """
    return labelled(docs, percent).select("doc_id", "n_shingles", "component_id", "text_hash")


def told_apart(found: DataFrame) -> DataFrame:
    """`found` where different sets have different nodes: those whose 64-bit hashes agree, which only
    very large inputs hold, are named by both their hashes."""
    clash = staged(found.filter("n > 0").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo < hi").select("node", F.lit(True).alias("clash")))
    if clash.isEmpty():
        return found
    both = join_stats(found, clash, "node", ["doc_id", "text_hash"])
    return staged(both.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("clash"))


def labelled(docs: DataFrame, percent: int = 75, node_bits: int = 64) -> DataFrame:
    """The rows of `near_duplicates` with `label`, which tells components apart where ids do not
    (null without shingles). `node_bits` is lowered by tests alone, to make hashes of sets collide."""
    scale = scale_of(docs)
    chunks = in_chunks(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), scale, "text_hash")
    n = scale.buckets
    sent = chunks.groupBy("chunk").applyInArrow(lambda k, t: send_shingles(k[0].as_py(), t, n), SENT)
    # written down, so that the shingles' exchange is gone before the texts are read again
    counted = staged(sent.groupBy("bucket").applyInArrow(count_shingles, COUNTS))
    found = told_apart(staged(chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(lambda t, r: find_prefixes(t, r, percent, node_bits), SETS)))
    sets = staged(found.filter("keys is not null").groupBy("node", "n").agg(F.first("keys").alias("keys"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")))
    label = components(links(sets, percent))
    docs_ = found.select("doc_id", "text_hash", "n", "node")
    # nodes that links joined take their label; a set's node is its label otherwise
    rows = join_stats(docs_, label, "node", ["doc_id", "text_hash"]).select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))
    several = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).filter("m > 1").select("label", "least", F.lit(True).alias("grouped"))
    out = join_stats(rows, several, "label", ["doc_id", "text_hash"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("grouped"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", "label")


def keep_one_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """`docs` without all but one document of each group: the one with the smallest id.

    Of rows that share this id and are linked, or have equal texts, one stays. Documents without links
    all stay, null and blank ones too. Columns stay as they are, whatever their names.
    """
    groups = labelled(docs, percent).filter("doc_id <=> component_id")
    first = groups.groupBy("doc_id", "label", F.when(F.col("n_shingles") == 0, F.col("text_hash")).alias("blank")).agg(F.min("text_hash").alias("text_hash"))
    chosen = first.select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    rows = boxed(docs).select("_row", F.col("_row.doc_id").alias("doc_id"), F.xxhash64("_row.text").alias("hash"))
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("text_hash")), "left_semi")
    # of equal ids and texts the first by the other columns that can be ordered
    order = [F.col(f"_row.{quoted(f.name)}") for f in docs.schema if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (MapType, VariantType))]
    place = Window.partitionBy("doc_id", "hash").orderBy(*(order or [F.lit(0)]))
    return kept.withColumn("nth", F.row_number().over(place)).filter("nth = 1").select("_row.*")
