"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from sedge.llm import queries, resampling

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def features(text, n, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n, buckets, least_words, percent):
    own = Counter(f for _, t in docs for f in features(t, n, buckets))
    aim = Counter(f for t in target for f in features(t, n, buckets))
    s_all, t_all = sum(own.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        found = features(text, n, buckets)
        weight = sum(gain[f] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_odd(spark, n):
    random.seed(n)
    voc = ["a", "B", "é", "x9", "ß", "Word", "longerword"]
    join = lambda k: random.choice([" ", ", ", "\n"]).join(random.choices(voc[: 2 + k % 6], k=random.randrange(0, 60)))
    docs = [(random.choice([None, 7, i, -i]), join(i)) for i in range(150)]
    docs += [(90, None), (91, ""), (92, "--"), (93, "a b c " * 5000), (93, "a b c " * 5000), (94, "x" * 5000), (None, "a " * 30), (None, "a " * 30)]
    target = [join(3) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, row string, own int")
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for size in (40, 65_536):
        got = resampling.resample(df, aim, n, 50, 20, 30, chunk_bytes=size)
        assert rows_of(got) == brute(docs, target, n, 50, 20, 30)
    assert rows_of(resampling.resample(df, aim.limit(0), n, 50)) == brute(docs, [], n, 50, 20, 10)
    assert resampling.resample(df.limit(0), aim, n).count() == 0


def test_chunks_own_every_feature_once():
    random.seed(1)
    for _ in range(50):
        text = " ".join("w" * random.randrange(1, 9) for _ in range(random.randrange(0, 40))).encode()
        for n in (1, 2, 4):
            parts = list(resampling.chunks_of(text, n, 25))
            w = text.split()
            assert sum(own for _, own in parts) == len(w)
            at = 0
            for part, own in parts:
                assert part.split() == w[at : at + own + n - 1]
                at += own


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(d, n, w, s, r) for d, _, n, w, s, r in brute(docs, target, 1, 10_000, 20, 10)]
    assert sorted(map(tuple, queries.op13_importance_resampling(spark, SF).collect()), key=str) == want
