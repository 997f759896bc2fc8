"""Embedding near-dedup against all pairs."""

import random

import numpy as np

from sedge.llm import neighbours, queries

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.9):
    xs = []
    for _, v in rows:
        ok = v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        xs.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    links = [[j for j, y in enumerate(xs) if j != i and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold] for i, x in enumerate(xs)]
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            group, todo = set(), [i]
            while todo:
                k = todo.pop()
                if k not in group:
                    group.add(k)
                    todo += links[k]
            least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], len(links[i]), seen[i]))
    return sorted(out, key=str)


def test_query(spark):
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op2_embedding_near_dedup(spark, SF).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_groups_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    random.seed(2)
    rows = []
    for size in [1] * 300 + [2] * 40 + [5] * 10 + [400]:
        centre = rng.standard_normal(16)
        rows += [(len(rows) + i, (centre + 0.1 * rng.standard_normal(16)).astype("f4").tolist()) for i in range(size)]
    same = rng.standard_normal(16).astype("f4").tolist()
    rows += [(10_000 + i, same) for i in range(300)]
    rows += [(20_000, None), (20_001, [0.0] * 16), (20_002, [float("nan")] * 16), (20_003, [None] * 16), (20_004, []), (None, same), (7, same), (20_005, [1.0, 2.0]), (20_006, [2.0, 4.0]), (20_007, [1e-30] * 16), (20_008, [1e30] * 16)]
    random.shuffle(rows)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, node string")
    got = neighbours.near_vectors(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute([(i, [float(np.float32(c)) if c is not None else None for c in v] if v is not None else None) for i, v in rows])
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert neighbours.near_vectors(df.limit(0)).count() == 0


def test_block_keeps_links_beyond_the_nearest():
    """Two tight groups with one pair across: none is among the 12 nearest of another group's."""
    x = np.zeros((60, 3))
    x[:, 0], x[:, 1] = 1, np.where(np.arange(60) < 30, 0.0, 0.45)
    x[:, 2] = np.arange(60) * 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b, _, edge = neighbours.pairs_among(np.arange(60), x, 12, 0.9)
    assert ((a < 30) != (b < 30))[edge].any() and edge.sum() == 59


def test_audit_counts_nodes_alike(spark):
    """A large group whose links are all known does not hide pairs whose links are all missed."""
    rng = np.random.default_rng(4)
    rows, known = [], []
    for size in [300] + [2] * 50:
        centre = rng.standard_normal(32)
        for _ in range(size):
            rows.append((len(rows), bytearray((centre + 0.05 * rng.standard_normal(32)).astype("<f8").tobytes())))
    known = [(i, 0) for i in range(300)]
    nodes = spark.createDataFrame(rows, "node long, raw binary")
    share, missed, short = neighbours.audit(nodes, spark.createDataFrame(known, "node long, label long"), 0.9, 0, 12)
    assert share < 0.5 and len(short) == 100
    assert {frozenset((r["a"], r["b"])) for r in missed.collect()} == {frozenset((i, i + 1)) for i in range(300, 400, 2)}
    label = spark.createDataFrame(known, "node long, label long")
    edges = {frozenset((r["a"], r["b"])) for r in neighbours.all_links(nodes, label, short, 0.9, block=64).collect() if r["a"] != r["b"]}
    assert edges == {frozenset((i, i + 1)) for i in range(300, 400, 2)}


def test_tables_follow_bits():
    assert neighbours.tables_for(0, 0.9, 0.99) == 1
    assert [neighbours.tables_for(b, 0.9, 0.99) for b in (4, 9, 13)] == [6, 17, 33]
