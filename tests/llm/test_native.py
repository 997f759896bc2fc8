"""Sharding, mixing and quality rules against plain Python."""

import re
import zlib
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from sedge.llm import mixing, quality, queries, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _x int"
ODD = [
    (1, None, None, None, 0, "a", 1),
    (2, "", "en", "s1", 0, "a", 1),
    (2, "", "en", "s1", 0, "a", 1),
    (3, " \t\n", "en", None, 3, "b", 1),
    (None, "one two three one two three\none\none", None, "s2", 5, None, None),
    (4, "ab#*$ é " * 4000 + "\n" + "x y z\n" * 50, "fr", "s1", 5, None, None),
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_sharding(spark):
    rows = queries.op3_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r)
    assert set(by) == set(range(40))
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    share = Counter(d["source"] for d in docs.values())
    top, n = share.most_common(1)[0]
    for v in by.values():
        assert abs(sum(docs[r["doc_id"]]["source"] == top for r in v) - n / 40) <= 2


def test_sharding_odd(spark, odd):
    slim = odd.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    got = sharding.interleave(slim, "source", ["doc_id", "t"], 4).collect()
    assert Counter(r["shard"] for r in got) == {0: 2, 1: 1, 2: 2, 3: 1} or sorted(Counter(r["shard"] for r in got).values()) == [1, 1, 2, 2]
    assert sharding.interleave(slim.limit(0), "source", ["doc_id"], 4).count() == 0
    names = ["_row", "_source", "_key", "_bucket", "_rank", "_total", "_at", "_all", "_place", "_rows", "_k0", "_from", "_n", "_before", "_inside"]
    clash = slim.select("*", *[F.lit(f"own {n}").alias(n) for n in names], F.lit("own").alias("shard"))
    want = sorted(((*r[:3], *[f"own {n}" for n in names], *r[3:]) for r in got), key=str)
    assert sorted(map(tuple, sharding.interleave(clash, "source", ["doc_id", "t"], 4).collect()), key=str) == want


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def test_mixing(spark):
    rows = queries.op6_mixing(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = Counter()
    for d in docs.values():
        sizes[d["source"]] += len(words(d["text"]))
    want = targets(sizes)
    taken = Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(words(d["text"])) and r["source_size"] == sizes[d["source"]]
        assert r["target"] == pytest.approx(want[d["source"]])
        assert r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.15)
    again = queries.op6_mixing(spark, SF)
    assert sorted(again.collect()) == sorted(rows)


def test_mixing_odd(spark, odd):
    got = mixing.with_copies(odd.drop("size")).collect()
    assert len(got) == len(ODD) and all(0 <= r["copies"] <= 3 for r in got)
    assert mixing.mix(odd.limit(0)).count() == 0
    # any name of a helper may be a column; values stay
    names = ["size", "source_size", "target", "copies", "_source", "_copy", "_row", "_weight", "_salt", "col"]
    clash = odd.select("doc_id", "text", "source", *[F.lit(f"own {n}").alias(n) for n in names])
    plain = mixing.mix(odd.select("doc_id", "text", "source")).collect()
    assert sorted(map(tuple, mixing.mix(clash).collect()), key=str) == sorted(((*r, *[f"own {n}" for n in names]) for r in plain), key=str)


def test_mixing_per_source(spark):
    """Each source's taken words come near its target: within five standard deviations of the draw."""
    rows = [(i, "w " * (1 + i % 40), f"s{i % 7}") for i in range(21_000)]
    got = mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, noise, target = Counter(), Counter(), {}
    for r in got:
        rate = r["target"] / r["source_size"]
        assert r["copies"] in (int(rate), int(rate) + 1)
        taken[r["source"]] += r["copies"] * r["size"]
        noise[r["source"]] += r["size"] ** 2 * (rate % 1) * (1 - rate % 1)
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 5 * noise[s] ** 0.5 for s, t in target.items())


def base(t):
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op5_quality_rules(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality.judge(odd, labels).collect()
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted(base(x[1]) for x in ODD)
    assert quality.judge(odd.limit(0), labels.limit(0)).count() == 0


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 10, 600, 3000) for k in (0, 1, 5, 9) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long")
    got = df.select("n", "k", F.exp(quality.log_binomial_tail(F.col("n"), F.col("k"), 0.01)).alias("p")).collect()
    for r in got:
        want = sum(comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    n = 4000
    df = spark.range(n).select(
        F.lit("s").alias("stratum"),
        (F.col("id") / n * 0.04).alias("symbol_share"),
        F.lit(0.0).alias("dup_line_share"),
        F.lit(0.0).alias("repeat_share"),
        F.lit(5.0).alias("word_length"),
        F.lit(1).alias("quality"),
    )
    bad = df.limit(200).withColumns({"quality": F.lit(0), "symbol_share": F.lit(0.6)})
    cut = quality.certified_cutoffs(df.unionByName(bad)).collect()[0]
    assert cut["cut_symbol_share"] == 0.05 and cut["cut_word_length"] is None


def test_counts_of_ranks_are_not_broadcast(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("b"))
    out = sharding.ranked(rows, "g", "b", ["id"], "rank", "total")
    want = {g: sorted((i % 50, i) for i in range(500) if i % 3 == g) for g in range(3)}
    assert {r["id"]: (r["rank"], r["total"]) for r in out.collect()} == {i: (n, len(x)) for x in want.values() for n, (_, i) in enumerate(x)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
