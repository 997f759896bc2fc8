"""The n-gram Jaccard join and components against brute force."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sedge.llm import common, components, near_duplicates, queries, windows

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            index[k].append(i)
    for i, s in enumerate(sets):
        hits = defaultdict(int)
        for k in s:
            for j in index[k]:
                if j < i:
                    hits[j] += 1
        for j, h in hits.items():
            if 100 * h >= percent * (len(s) + len(sets[j]) - h):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op7_ngram_jaccard_join(spark, SF).collect()), key=str)
    assert got == brute(rows)
    assert sum(d != c for d, _, c in got) > 5


def test_clusters(spark, monkeypatch):
    """Chains, large groups, common passages and many chunks."""
    random.seed(11)
    voc = [f"w{i}" for i in range(300)]
    passage = " ".join(random.choices(voc, k=60))
    rows = []
    for c in range(8):
        w = random.choices(voc, k=random.choice([8, 40, 90]))
        for _ in range(25):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            w[random.randrange(len(w))] = random.choice(voc)
    rows += [(len(rows) + i, passage + " " + " ".join(random.choices(voc, k=random.choice([3, 10, 30])))) for i in range(40)]
    rows += [(None, "a b c"), (1000, "A  b\nC"), (1001, None), (1002, " "), (1003, ""), (5, "solo"), (5, passage), (1004, "x " * 30000)]
    random.shuffle(rows)
    monkeypatch.setattr(near_duplicates, "scale_of", lambda d: windows.Scale(5, 64))
    df = spark.createDataFrame([(d, t, 1, "g") for d, t in rows], "doc_id long, text string, node int, label string")
    got = sorted(map(tuple, near_duplicates.near_duplicates(df).drop("text_hash").collect()), key=str)
    assert got == brute(rows)
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_rounds_lose_no_link(spark, monkeypatch):
    """Groups of many members, and components that only a late pair of members joins."""
    random.seed(12)
    voc = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(6):
        w = random.choices(voc, k=60)
        for _ in range(12):
            x = list(w)
            for _ in range(random.randrange(4)):
                x[random.randrange(len(x))] = f"own{len(rows)}" if random.random() < 0.5 else random.choice(voc)
            rows.append((len(rows), " ".join(x)))
            if random.random() < 0.3:
                w = x
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    make, first = near_duplicates.links, near_duplicates.list_pairs
    for rounds in (((1, 1), (2, 1), (None, None)), ((None, None),), ((2, 1), (32, 4), (None, None))):
        for start in (first, lambda sets, percent, *c: first(sets, percent).limit(0)):
            monkeypatch.setattr(near_duplicates, "list_pairs", start)
            monkeypatch.setattr(near_duplicates, "links", lambda sets, percent, r=rounds: make(sets, percent, r))
            assert sorted(map(tuple, near_duplicates.near_duplicates(df).drop("text_hash").collect()), key=str) == want


def test_pairs_of_lists_share_a_prefix_shingle(spark):
    random.seed(13)
    made = [(i, i, random.randrange(60, 90), sorted(random.sample(range(30), 3)), [random.getrandbits(8) for _ in range(4)], i % 7) for i in range(200)]
    sets = spark.createDataFrame(made, "node long, check long, n long, prefix array<long>, bits array<long>, c long")
    for c, piece in ((None, 50_000), ("c", 50_000), ("c", 9)):
        pairs = [tuple(r) for r in near_duplicates.list_pairs(sets, 75, c, piece=piece).collect()]
        assert pairs and len(set(pairs)) == len(pairs)
        for a, b in pairs:
            apart = sum((x ^ y).bit_count() for x, y in zip(made[a][4], made[b][4], strict=True))
            assert a > b and set(made[a][3]) & set(made[b][3]) and apart <= made[a][2] + made[b][2] - 2 * -(-75 * (made[a][2] + made[b][2]) // 175)
            assert c is None or made[a][5] != made[b][5]


def test_unlinked_rows_of_one_id_all_stay(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (1, c), (1, d), (1, d + " more"), (2, c), (3, d), (None, c), (4, None), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in near_duplicates.keep_one_each(df).collect()]
    got = [(i, d if t == d + " more" else t) for i, t in got]  # either of the linked two
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (1, c), (1, d), (4, None), (4, " ")], key=str)


def test_sets_with_colliding_hashes(spark, monkeypatch):
    random.seed(3)
    rows = [(i, " ".join(random.choices("abcd", k=random.randrange(1, 12)))) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(30)]
    monkeypatch.setattr(near_duplicates, "scale_of", lambda d: windows.Scale(3, 64))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (1, 4):
        assert sorted((tuple(r[:3]) for r in near_duplicates.labelled(df, node_bits=bits).collect()), key=str) == brute(rows)


def test_keep_one_each_keeps_values_of_clashing_columns(spark):
    names = ["_row", "_id", "_hash", "_nth", "hash", "nth", "label", "node", "text_hash", "n", "least", "grouped", "_salt"]
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (None, None), (4, "x"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    got = sorted(map(tuple, near_duplicates.keep_one_each(df).collect()), key=str)
    assert got == sorted(((*r, *[f"own {n}" for n in names]) for r in [(1, "a b c d e f"), (3, "x"), (None, None)]), key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 60: 50, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_of_stats_are_not_broadcast(spark):
    """Of a staged table Spark knows the bytes of its files, not how many rows its copies make."""
    rows = spark.range(3000).select((F.col("id") % 700).alias("k"), "id")
    out = common.join_stats(rows, spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")), "k", "id", most=100)
    assert sorted(map(tuple, out.collect())) == sorted((i % 700, i, i % 700 * 3 if i % 700 < 500 else None) for i in range(3000))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_many_edges_are_not_broadcast(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (7, 7), (200, 201)]
    monkeypatch.setattr(components, "bounded", lambda rows, count: common.bounded(rows, count, most=10))
    label = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["label"] for r in label.collect()} == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 60: 50, 200: 200, 201: 200}
    joined = spark.range(300).withColumnRenamed("id", "node").join(label, "node")
    assert joined.count() == 46 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
