"""Substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from sedge.llm import queries, repeats, windows

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, size, hashes=None):
    """rows of (doc_id, text); rows of one id count in the order of their texts' hashes."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]] if hashes else 0)):
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone |= set(range(i, i + size))
            seen.add(key)
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows, 20))
    assert sum(x[2] for x in want) > 0
    assert sorted(map(tuple, queries.op10_substring_dedup(spark, SF).collect())) == want


def test_odd(spark):
    random.seed(5)
    voc = ["a", "b", "é", "A", "\x1c", "\xa0x"]
    rows = [(i, random.choice([" ", "\n", " \t "]).join(random.choices(voc[: 2 + i % 5], k=random.randrange(0, 40)))) for i in range(60)]
    rows += [(None, "a b " * 30), (None, None), (7, "again and again " * 10), (7, None), (8, rows[8][1]), (-5, rows[9][1]), (99, ""), (100, "z " * 50000), (101, "z " * 50000)]
    df = spark.createDataFrame([(d, t, 3, "c") for d, t in rows], "doc_id long, text string, chunk int, bucket string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    hashes = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    for size in (4, 7, 20):
        assert sorted(map(tuple, repeats.drop_repeats(df, size).collect()), key=key) == sorted(brute(rows, size, hashes), key=key)
    assert repeats.drop_repeats(df.limit(0)).count() == 0


def test_many_chunks(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    monkeypatch.setattr(repeats, "scale_of", lambda d: windows.Scale(9, 70))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeats.drop_repeats(df, 12).collect())) == sorted(brute(rows, 12))


def test_null_and_shared_ids_over_chunks_with_colliding_hashes(spark, monkeypatch):
    random.seed(6)
    rows = [(random.choice([None, None, 1, 2, 3, i]), " ".join(random.choices("ab", k=random.randrange(30)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    monkeypatch.setattr(repeats, "scale_of", lambda d: windows.Scale(7, 3))
    want = sorted(brute(rows, 6, hashes), key=str)
    for bits in (1, 4, 64):
        assert sorted(map(tuple, repeats.drop_repeats(df, 6, key_bits=bits).collect()), key=str) == want


def test_slices_do_not_change_words(monkeypatch):
    texts = pa.array(["aB c  dé" * 9, None, "x" * 300, " ", "q w e " * 50])
    whole = windows.read_words(texts, True, True)
    for size in (1, 7, 100):
        monkeypatch.setattr(windows, "SLICE", size)
        some = windows.read_words(texts, True, True)
        assert all((a == b).all() for a, b in ((whole.hashes, some.hashes), (whole.first, some.first), (whole.checks, some.checks)))
    assert len(set(whole.hashes.tolist())) == len(set(whole.checks.tolist())) == len({w for t in texts.to_pylist() for w in words((t or "").lower())})


def test_window_hashes():
    texts = ["a b c d e f g", None, "  c d  e\tf ", "x"]
    w = windows.read_words(pa.array(texts))
    assert w.first.tolist() == [0, 7, 7, 11, 12]
    for size in range(1, 8):
        h, at = w.windows(size), w.starts(size)
        flat = [x for t in texts for x in words(t)]
        seqs = Counter((tuple(flat[i : i + size]), int(h[i])) for i in at)
        assert len({s for s, _ in seqs}) == len({k for _, k in seqs}) == len(seqs)
