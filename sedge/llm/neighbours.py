"""Near-duplicate embeddings by NN-descent.

Equal vectors become one node. Neighbour lists start from blocks of vectors that share the signs of
random projections, and are refined by joining neighbours of neighbours: every node compares the
vectors that its list, and the lists it is in, bring together. Nodes whose whole list lies above the
threshold are saturated and get longer lists, twice as long each round. Of the pairs above the
threshold that a step sees, edges are kept that connect the same vectors. An audit compares a sample of
nodes with all others and adds rounds while recall is low; after the last round, components that it
finds short are compared with everything.

Edges give components. Links run inside components only, so the lists of a component's members are
at last enlarged to the whole component, block by block: link counts are exact there, and no pair is
written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components

BLOCK = 256  # rows of a block in which all pairs are compared
PAIRS = "a long, b long, sim float, edge boolean"


def unit_rows(column: pa.Array | pa.ChunkedArray | list) -> np.ndarray:
    """Raw little-endian float64 vectors as rows of length 1."""
    x = np.frombuffer(b"".join(bytes(v) for v in column), "<f8").reshape(len(column), -1)
    scale = np.abs(x).max(axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    x = x / scale  # first by the largest part, so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as raw doubles; null for those that link with nothing."""
    for batch in batches:
        raw = []
        for v in batch.column("embedding").to_pylist():
            x = np.array([np.nan if c is None else c for c in v], "<f8") if v else np.zeros(0)
            # + 0.0 turns -0.0 into 0.0, so that equal vectors have equal bytes
            raw.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], names=["vec_id", "raw"])


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the symmetric matrix `near` connects: a spanning tree of each part."""
    todo = near.any(axis=1)
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    for root in np.flatnonzero(todo):
        if not todo[root]:
            continue
        todo[root] = False
        front = np.array([root])
        while len(front):
            reach = near[front] & todo
            new = np.flatnonzero(reach.any(axis=0))
            a.append(front[reach[:, new].argmax(axis=0)])
            b.append(new)
            todo[new] = False
            front = new
    return np.concatenate(a), np.concatenate(b)


def pairs_among(ids: np.ndarray, x: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row among the rows, whatever their cosine, and, as edges, pairs that
    connect all rows which pairs at or above the threshold connect."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    linked = sims >= threshold
    i, j = forest(linked | linked.T)
    rows = np.concatenate([i, np.repeat(np.arange(len(ids)), k)])
    cols = np.concatenate([j, near.reshape(-1)])
    return ids[rows], ids[cols], sims[rows, cols], np.arange(len(rows)) < len(i)


def table_of(a: np.ndarray, b: np.ndarray, sims: np.ndarray, edge: np.ndarray) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sims.astype(np.float32)), pa.array(edge, pa.bool_())], names=["a", "b", "sim", "edge"])


def tables_for(bits: int, threshold: float, recall: float) -> int:
    """How many tables of `bits` signs bring a pair at the threshold together with this probability."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def starting_pairs(nodes: DataFrame, n: int, dims: int, seed: int, k: int, tables: int, threshold: float, recall: float) -> DataFrame:
    """Pairs from partitions of the nodes by signs of random projections: `tables` at least, and as
    many as a pair at the threshold needs to meet in one. Blocks that are too large are cut at
    random, differently per table."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / (BLOCK / 2))))
    tables = max(tables, tables_for(bits, threshold, recall))
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dims))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column("raw"))
            for t in range(tables):
                code = (x @ planes[t].T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), int)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("raw"), pa.array(np.full(len(x), t), pa.int32()), pa.array(code.astype(np.int64))], names=["node", "raw", "t", "code"]
                )

    coded = nodes.select("node", "raw").mapInArrow(codes, "node long, raw binary, t int, code long")
    # cuts come from counts per code; only the counts of crowded codes are joined
    crowded = coded.groupBy("t", "code").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK)
    cut = F.pmod(F.xxhash64("node", "t"), F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("long"))
    cells = coded.join(crowded, ["t", "code"], "left").select("node", "raw", "t", "code", cut.alias("cut"))

    def near(table: pa.Table) -> pa.Table:
        return table_of(*pairs_among(np.asarray(table.column("node")), unit_rows(table.column("raw").combine_chunks().to_pylist()), k, threshold))

    return cells.groupBy("t", "code", "cut").applyInArrow(near, PAIRS)


def best_lists(pairs: DataFrame, k: int, threshold: float, doublings: int) -> DataFrame:
    """(node, list): the k nearest known neighbours of each node; twice as many, up to `doublings`
    times, while all of them are above the threshold."""
    both = pairs.select(F.col("a").alias("node"), F.struct((-F.col("sim")).alias("d"), F.col("b").alias("to")).alias("x"))
    both = both.unionByName(pairs.select(F.col("b").alias("node"), F.struct((-F.col("sim")).alias("d"), F.col("a").alias("to")).alias("x")))
    ordered = both.groupBy("node").agg(F.array_sort(F.collect_set("x")).alias("s"))
    length = F.lit(k << doublings)
    for r in range(doublings - 1, -1, -1):
        length = F.when(F.try_element_at("s", F.lit(k << r))["d"] <= -threshold, length).otherwise(F.lit(k << r))
    return ordered.select("node", F.slice("s", F.lit(1), length).alias("list"))


def joined_neighbours(lists: DataFrame, nodes: DataFrame, k: int, seed: int, threshold: float) -> DataFrame:
    """Pairs from the local join: at each node, its neighbours and up to 2k of the nodes whose lists
    it is in (a hash decides, another one each round) are compared with one another."""
    ahead = lists.select("node", F.explode("list").alias("x")).select("node", F.col("x.to").alias("to"))
    drawn = ahead.select(F.col("to").alias("node"), F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("to")).alias("x"))
    back = drawn.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("x")), 1, 2 * k).alias("xs")).select("node", F.explode("xs.to").alias("to"))
    meet = ahead.unionByName(back).distinct()
    meet = meet.join(nodes.select(F.col("node").alias("to"), "raw"), "to")
    buckets = F.pmod(F.xxhash64("node"), F.lit(1 << 16))

    def near(table: pa.Table) -> pa.Table:
        at = np.asarray(table.column("node"))
        order = np.argsort(at, kind="stable")
        ids = np.asarray(table.column("to"))[order]
        x = unit_rows(table.column("raw").combine_chunks().to_pylist())[order]
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        found = [pairs_among(i, v, k, threshold) for i, v in zip(np.split(ids, cuts), np.split(x, cuts), strict=True)]
        a, b, s, e = (np.concatenate(z) for z in zip(*found, strict=True))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((~e, b, a))  # of equal pairs the edge is first
        a, b, s, e = a[order], b[order], s[order], e[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return table_of(a[new], b[new], s[new], e[new])

    return meet.withColumn("bucket", buckets).groupBy("bucket").applyInArrow(near, PAIRS)


def audit(nodes: DataFrame, label: DataFrame, threshold: float, seed: int, small: int, queries: int = 1024) -> tuple[float, DataFrame, list[int]]:
    """Compares hash-chosen nodes (bounded) with every node: `queries` of all nodes, and as many of
    those in components of at most `small` nodes, which large ones would else outvote.

    Returns the share of a node's links that stay inside its component, averaged over the nodes
    with links, each counting once (the lower of the two samples); the links found between
    components; and the nodes that they are missing from.
    """
    sizes = label.groupBy("label").agg(F.count("*").alias("m"))
    picked = staged(nodes.join(label.join(sizes, "label"), "node", "left").select("node", "raw", F.coalesce("label", "node").alias("label"), F.coalesce("m", F.lit(1)).alias("m")))
    drawn = F.xxhash64("node", F.lit(f"audit {seed}"))
    few = [r for some in (picked, picked.filter(F.col("m") <= small)) for r in some.orderBy(drawn).limit(queries).collect()]
    few = list({r["node"]: r for r in few}.values())
    if not few:
        return 1.0, label.select(F.col("node").alias("a"), F.col("label").alias("b")).limit(0), []
    ids, labels = (np.array([r[c] for r in few]) for c in ("node", "label"))
    q = unit_rows([r["raw"] for r in few])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        names = ["a", "b", "hit", "total"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                node, mine = np.asarray(part.column("node")), np.asarray(part.column("label"))
                r, c = np.nonzero(unit_rows(part.column("raw")) @ q.T >= threshold)
                other = node[r] != ids[c]
                r, c = r[other], c[other]
                same = mine[r] == labels[c]
                total += np.bincount(c, minlength=len(ids))
                hit += np.bincount(c[same], minlength=len(ids))
                r, c = r[~same], c[~same]
                # one link of each sampled node to each component is enough
                first = np.unique(np.stack([c, mine[r]]), axis=1, return_index=True)[1] if len(r) else []
                yield pa.RecordBatch.from_arrays([pa.array(ids[c[first]], pa.int64()), pa.array(node[r[first]], pa.int64()), pa.array([0] * len(first), pa.int64()), pa.array([0] * len(first), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([None] * len(ids), pa.int64()), pa.array(hit), pa.array(total)], names=names)

    seen = staged(picked.select("node", "raw", "label").mapInArrow(compare, "a long, b long, hit long, total long"))
    shares = {r["a"]: r["s"] for r in seen.groupBy("a").agg((F.sum("hit") / F.nullif(F.sum("total"), F.lit(0))).alias("s")).collect() if r["s"] is not None}
    of_all = [shares[r["node"]] for r in few[:queries] if r["node"] in shares]
    of_small = [shares[r["node"]] for r in few if r["node"] in shares and r["m"] <= small]
    recall = min([float(np.mean(x)) for x in (of_all, of_small) if x], default=1.0)
    return recall, seen.filter("b is not null").select("a", "b"), [r["node"] for r in few if shares.get(r["node"], 1) < 1]


def all_links(nodes: DataFrame, label: DataFrame, short: list[int], threshold: float, block: int = 1024) -> DataFrame:
    """Edges that connect all that links of the nodes of the components that hold the nodes `short` connect: these
    nodes are compared with every node, block by block."""
    spark = nodes.sparkSession
    every = nodes.join(label, "node", "left").select("node", "raw", F.coalesce("label", "node").alias("label"))
    which = every.join(F.broadcast(spark.createDataFrame([(x,) for x in short], "node long")), "node").select("label").distinct()
    some = staged(every.join(which, "label").select("node", "raw"))
    rows, cols = (max(1, math.ceil(x.count() / block)) for x in (some, nodes))
    place = lambda m: F.pmod(F.xxhash64("node"), F.lit(m)).cast("int")
    across = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    work = some.select("node", "raw", place(rows).alias("i"), across(cols).alias("j"), F.lit(1).alias("side"))
    work = work.unionByName(every.select("node", "raw", across(rows).alias("i"), place(cols).alias("j"), F.lit(2).alias("side")))

    def compare(table: pa.Table) -> pa.Table:
        node, side = np.asarray(table.column("node")), np.asarray(table.column("side"))
        x = unit_rows(table.column("raw").combine_chunks().to_pylist())
        near = (x @ x.T >= threshold) & (side[:, None] != side)
        a, b = forest(near | near.T)
        return pa.table([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], names=["a", "b"])

    return work.groupBy("i", "j").applyInArrow(compare, "a long, b long")


def links_inside(members: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(node, links): the weight of the other members of its component above the threshold.

    Components are cut into blocks; every pair of blocks is one piece of work, small components
    share pieces. Only sums leave a piece.
    """
    sizes = members.groupBy("label").agg(F.count("*").alias("m"))
    cut = members.join(sizes.withColumn("blocks", F.ceil(F.col("m") / block).cast("int")), "label")
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    small = F.col("blocks") == 1
    shared = F.pmod(F.xxhash64("label"), F.lit(4096)).cast("long")
    # a member takes part in the row of its block as a subject, and in the column as one counted
    subject = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "raw", "weight", "label", "blocks", F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(1).alias("side"))
    counted = (
        cut.filter("blocks > 1")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "raw", "weight", "label", "blocks", F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(2).alias("side"))
    )
    work = subject.unionByName(counted).withColumn("key", F.when(small, shared).otherwise(F.col("label")))

    def count(table: pa.Table) -> pa.Table:
        label, node, side = (np.asarray(table.column(c)) for c in ("label", "node", "side"))
        weight = np.asarray(table.column("weight"))
        x = unit_rows(table.column("raw").combine_chunks().to_pylist())
        order = np.argsort(label, kind="stable")
        out = np.zeros(len(node), np.int64)
        for some in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            a = some[side[some] == 1]
            b = some[side[some] == 2] if (side[some] == 2).any() else a
            near = x[a] @ x[b].T >= threshold
            out[a] = (near * weight[b]).sum(axis=1) - (near & (node[a][:, None] == node[b])) @ weight[b]
        keep = side == 1
        return pa.table([pa.array(node[keep]), pa.array(out[keep])], names=["node", "links"])

    return work.groupBy("key", "i", "j").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, k: int = 12, tables: int = 4, recall: float = 0.99, most_rounds: int = 6) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    Vectors link at a cosine (double precision) of `threshold` or more. Null, empty, zero and
    non-finite vectors, and those with null parts, link with nothing; vectors of different length
    are compared with those of their own length only. Rows that share an id are vectors of their own; of
    rows with equal vectors each links with all others. A null id counts as a vector and takes the
    least id of its component. An empty table gives no rows.
    """
    rows = staged(vectors.select("vec_id", "embedding").mapInArrow(as_bytes, "vec_id long, raw binary").withColumn("_hash", F.xxhash64("raw")))
    # equal vectors are one node; its id is the number of its first row, as ids may repeat or be null
    distinct = staged(
        rows.filter("raw is not null").groupBy("_hash", "raw").agg(F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id())
    )
    lengths = [r[0] for r in distinct.select(F.length("raw")).distinct().collect()]  # one per vector length
    labels = None
    for length in sorted(lengths):
        nodes = distinct.filter(F.length("raw") == length)
        part = linked_nodes(nodes, length // 8, threshold, k, tables, recall, most_rounds)
        labels = part if labels is None else labels.unionByName(part)
    if labels is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    known = distinct.select("_hash", "raw", "weight", "node").join(labels, "node", "left").select("_hash", "raw", "weight", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    # a vector that a third of all rows share: rows meet the nodes under one of 64 salts
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int"))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    marked = staged(salted.join(known, ["_hash", "raw", "_salt"], "left").select("vec_id", "label", (F.col("links") + F.col("weight") - 1).alias("links")))
    least = marked.filter("label is not null").groupBy("label").agg(F.min("vec_id").alias("least"), F.count("*").alias("_m"))
    large = least.filter("_m > 1").select("label", "least").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    out = marked.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int")).join(large, ["label", "_salt"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def linked_nodes(nodes: DataFrame, dims: int, threshold: float, k: int, tables: int, recall: float, most_rounds: int) -> DataFrame:
    """(node, label, links) for the nodes that link: component and weight of linked nodes."""
    n = nodes.count()
    pairs = staged(starting_pairs(nodes, n, dims, 1, k, tables, threshold, recall))
    edges = pairs.filter("edge").select("a", "b")
    r = 0
    while True:
        if r < most_rounds:
            lists = staged(best_lists(pairs, k, threshold, r + 1))
            found = joined_neighbours(lists, nodes, k, r, threshold)
            if r:  # new projections reach pairs that the lists do not lead to
                found = found.unionByName(starting_pairs(nodes, n, dims, 1 + r, k, tables, threshold, recall))
            found = staged(found)
            new = found.filter("edge").select("a", "b")
        else:  # what the audit found short is compared with everything
            new = all_links(nodes, label, short, threshold)
        edges = staged(edges.unionByName(new).distinct())
        label = staged(components(edges))
        share, missed, short = audit(nodes, label, threshold, r, k)
        if short:  # what the audit found is not lost
            edges = staged(edges.unionByName(missed).distinct())
            label = staged(components(edges))
        if share >= recall:
            break
        kept = lists.select(F.col("node").alias("a"), F.explode("list").alias("x")).select("a", F.col("x.to").alias("b"), (-F.col("x.d")).alias("sim"))
        pairs = kept.unionByName(found.select("a", "b", "sim"))
        r += 1
    members = nodes.join(label, "node").select("node", "raw", "weight", "label")
    return label.join(links_inside(members, threshold), "node")
