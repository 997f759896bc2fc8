"""Decontamination against brute force over all windows."""

import random
import re

import numpy as np
import pyarrow as pa

from sedge.llm import contamination, queries, windows

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window):
    """(doc_id, n_words, spans, items) by comparing every window with every other."""
    known = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            known.setdefault(tuple(w[i : i + size]), set()).add("" if name is None else str(name))
    sizes = {len(k) for k in known}
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := known.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= found
        spans = [[i] for i in sorted(hit) if i - 1 not in hit]
        for s in spans:
            end = s[0]
            while end in hit:
                end += 1
            s.append(end)
        out.append((doc, len(w), [tuple(s) for s in spans], sorted(names)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], r["items"]) for r in df.collect()), key=str)


def test_every_shared_window_keeps_a_common_fingerprint():
    random.seed(3)
    for size in (1, 2, 3, 4, 7, 10):
        texts = [" ".join(random.choices("abc", k=60)) for _ in range(20)]
        w = windows.read_words(pa.array(texts))
        at, keys = contamination.fingerprints(w, size)
        kept = dict(zip(at.tolist(), keys.tolist(), strict=True))
        starts = w.starts(size).tolist()
        k = contamination.gram_size(size)
        by = {}
        for s in starts:
            inside = [(p - s, kept[p]) for p in range(s, s + size - k + 1) if p in kept]
            assert inside
            by.setdefault(int(w.windows(size)[s]), []).append(set(inside))
        assert all(set.intersection(*v) for v in by.values())


def test_odd(spark):
    random.seed(4)
    voc = ["a", "B", "é", "x9", "ß", "c"]
    join = lambda k: random.choice([" ", ", ", "\n", "\x00"]).join(random.choices(voc[: 2 + k % 5], k=random.randrange(0, 45)))
    items = [(random.choice([None, 1, 2, i]), join(i)) for i in range(25)] + [(70, None), (71, " .,"), (72, "B"), (73, "one two"), (74, "One two three")]
    docs = [(random.choice([None, 7, i]), join(i)) for i in range(60)]
    docs += [(90, None), (91, ""), (92, "--"), (93, items[3][1]), (93, items[3][1]), (94, "one two " * 30000), (95, "one two three")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, key string, row int")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, size int")
    for window in (1, 3, 10):
        assert rows_of(contamination.contaminated(df, bench, window)) == brute(docs, items, window)
    assert rows_of(contamination.contaminated(df, bench.limit(0))) == brute(docs, [], 10)
    assert contamination.contaminated(df.limit(0), bench).count() == 0


def test_shuffled_items_and_full_map(spark, monkeypatch):
    """The join that spreads items, and a map so small that it lets nearly all fingerprints pass."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute(docs, items, 10)
    assert any(w[2] for w in want)
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(contamination, "MOST_BITS", 6)
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == want


def test_map(spark):
    keys = [random.Random(5).getrandbits(64) - 2**63 for _ in range(500)]
    bits = contamination.bit_map(spark.createDataFrame([(k,) for k in keys], "key long"), 500)
    assert contamination.known(np.array(keys), bits).all()
    assert contamination.known(np.array([random.Random(6).getrandbits(63) for _ in range(2000)]), bits).mean() < 0.1


def test_query_has_every_document(spark):
    rows = queries.op11_decontamination(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert any(r["contaminated"] for r in rows) and not all(r["contaminated"] for r in rows)
