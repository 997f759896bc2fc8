"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from sedge.llm import spelling


def counts(docs, shortest, least):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times=10):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= times * n else None
        out[w] = [w, form, None, n, len(near), words[form] if form else None]
    for w, r in out.items():
        r[2] = w
        while out[r[2]][1]:
            r[2] = out[r[2]][1]
    return sorted(map(tuple, out.values()))


def rows_of(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


@pytest.mark.parametrize("most_pairs", [0, 3, 500])
def test_variants_of_words_of_all_lengths(spark, most_pairs):
    random.seed(most_pairs)
    words = {"".join(random.choices("abé", k=random.randrange(1, 8))): int(10 ** random.uniform(0, 4)) for _ in range(400)}
    words |= {"q" * k: 10 ** (k % 5) for k in range(1, 12)} | {"lang" * 300: 5, "lang" * 300 + "e": 500, "lang" * 299 + "lxng": 5}
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, key string")
    assert rows_of(spelling.variants(df, most_pairs=most_pairs)) == brute(words)


def test_ties_and_chains(spark):
    words = {"formulate": 1000, "formulaxe": 1000, "formulaye": 10, "formulaze": 100, "formulazes": 10, "formulazess": 1, "separate": 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r[0]: r for r in rows_of(spelling.variants(df))}
    assert got["formulaye"][1:3] == ("formulate", "formulate")
    assert got["formulazess"][1:3] == ("formulazes", "formulate")
    assert got["separate"] == ("separate", None, "separate", 7, 0, None)
    assert rows_of(spelling.variants(df)) == brute(words)


def test_words_of_documents(spark, monkeypatch):
    random.seed(8)
    syllables = ["an", "É", "TOer", "eraß", "×", "anto", "ā", "-", "’", "ana"]
    docs = [(random.choice([None, 5, i, -i]), random.choice([" ", "\n", ", "]).join("".join(random.choices(syllables, k=random.randrange(1, 5))) for _ in range(random.randrange(150)))) for i in range(80)]
    docs += [(1, None), (2, ""), (3, "Antoerantoer " * 20000), (3, "Antoerantoer"), (3, "Antoerantoer"), (4, "ÃÃÃÃÃÃÃ " * 3)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, word int")
    want = counts(docs, 7, 2)
    assert len(want) > 30
    for piece, held in ((50, 20), (1_000_000, 100_000)):
        monkeypatch.setattr(spelling, "PIECE", piece)
        monkeypatch.setattr(spelling, "HELD", held)
        assert {r["word"]: r["n"] for r in spelling.word_counts(df).collect()} == want
    assert rows_of(spelling.spelling_variants(df)) == brute(want)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
