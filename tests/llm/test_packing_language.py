"""Packing against the tokenizer itself and the lower bound; language ID by held-out accuracy."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sedge.llm import language, packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check_packing(texts, rows, capacity=2048):
    tok = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    total = 0
    assert set(got) == set(texts)
    for d, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want = [(k, s, min(capacity, len(ids) - s), zlib.crc32(struct.pack(f"<{len(ids[s : s + capacity])}I", *ids[s : s + capacity]))) for k, s in enumerate(range(0, len(ids), capacity))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got[d]) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), -(-total // capacity)


def test_packing(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used, bound = check_packing(texts, queries.op4_packing(spark, SF).collect())
    assert used <= bound + 1


def test_packing_odd(spark):
    texts = {1: None, 2: "", 3: "It's THE 12 Été é İ ẞ ① ½ ª <|endoftext|> don't''s 한글 \U0001f600!!", 4: "word " * 9000, 5: "x" * 5000, 6: "a b　c\x85d\x1ce"}
    df = spark.createDataFrame([(k, v, 7) for k, v in texts.items()], "doc_id long, text string, piece int")
    check_packing(texts, packing.pack(df, PATH).collect())
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = packing.pack(df.union(df), PATH).collect()
    assert len(twice) == 2 * packing.pack(df, PATH).count()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)


@pytest.mark.parametrize("lengths", [[6, 4, 5, 5, 3, 7, 10, 1], [6] * 5 + [5] * 4 + [4] * 9, [9, 9, 9], [], [5, 4, 3, 3, 2, 2, 1] * 7])
def test_plan_packs_everything(lengths):
    bins = packing.plan(dict(Counter(lengths)), 10)
    assert Counter(k for b, n in bins for k in b * n) == Counter(lengths)
    assert all(sum(b) <= 10 for b, _ in bins)
    large = sum(2 * k > 10 for k in lengths)
    assert sum(n for _, n in bins) <= max(-(-sum(lengths) // 10), large) + 1


def test_plan_beats_best_fit():
    # best fit takes 7+2 first and needs 4; bin completion finds 3
    lengths = [7, 6, 4, 3, 4, 2, 2, 2]
    assert sum(n for _, n in packing.plan(dict(Counter(lengths)), 10)) == 3


@pytest.mark.parametrize("histogram", [{1: 300_000}, {2: 300_000, 1: 5, 700: 3}, {2048: 2, 1: 1}, {1: 3000, 2: 3000, 1500: 10}])
def test_plan_of_very_many_short_pieces(histogram):
    bins = packing.plan(histogram)
    got = Counter()
    for b, n in bins:
        for k, m in Counter(b).items():
            got[k] += m * n
    assert got == Counter(histogram)
    assert all(sum(b) <= 2048 for b, _ in bins)
    assert sum(n for _, n in bins) <= -(-sum(k * v for k, v in histogram.items()) // 2048) + 1


def smallest(lengths, capacity):
    """The least number of bins, by trying every place of each piece."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_plan_against_every_packing():
    random.seed(8)
    for _ in range(12):
        lengths = sorted((random.randint(1, 20) for _ in range(random.randint(1, 9))), reverse=True)
        for bins in (packing.plan(dict(Counter(lengths)), 20), packing.best_fit(dict(Counter(lengths)), 20)):
            assert Counter(k for b, n in bins for k in b * n) == Counter(lengths) and all(sum(b) <= 20 for b, _ in bins)
        assert sum(n for _, n in packing.plan(dict(Counter(lengths)), 20)) == smallest(lengths, 20)


def test_packing_many_empty_texts(spark):
    texts = {i: None if i % 2 else "" for i in range(5000)} | {5000 + i: "the" for i in range(2500)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    used, bound = check_packing(texts, packing.pack(df, PATH).collect())
    assert used <= bound + 1


def test_fillings_are_undominated():
    assert packing.fillings(10, {7: 1, 3: 1, 2: 3}) == [[7, 3]]
    # 2, 2, 2 leaves room for the 5 in place of a 2
    assert packing.fillings(9, {5: 1, 2: 3}) == [[5, 2, 2]]
    assert packing.fillings(11, {9: 1, 5: 1, 4: 1}) == [[9], [5, 4]]


def test_language(spark):
    rows = queries.op9_language_id(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held)


def test_language_odd(spark):
    train = spark.createDataFrame([(i, "the cat and the dog of the house" if i % 2 else "le chat et le chien de la maison", "en" if i % 2 else "fr") for i in range(20)], "doc_id long, text string, lang string")
    model = language.learn(train)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 !?", 1), (4, "THE dogs", 1), (5, "chiens", 1), (6, "the " * 100000, 1), (6, "the " * 100000, 1)], "doc_id long, text string, score int")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(odd, model, ["doc_id"]).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (6, "en"), (6, "en")]
    assert language.identify(odd.limit(0), model, ["doc_id"]).count() == 0
    empty = language.learn(train.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, empty, ["doc_id"]).collect()} == {"und"}


def plain_scores(word, n, words, grams):
    """Word-first backoff over plain dictionaries of counts per language."""
    from math import log

    total = [sum(c[j] for c in words.values()) for j in range(n)]
    if word in words:
        return [log((words[word][j] + 0.1) / (total[j] + 0.1 * len(words) + 1)) for j in range(n)]
    kinds = sum(len(g) == 1 for g in grams)
    letters = [sum(c[j] for g, c in grams.items() if len(g) == 1) for j in range(n)]
    out, marked = [0.0] * n, f"<{word}>"
    for end in range(2, len(marked) + 1):
        found = next((marked[end - k : end] for k in range(min(4, end), 0, -1) if marked[end - k : end] in grams), None)
        for j in range(n):
            if found is None:
                out[j] += log(0.4) * 5
            else:
                before = letters[j] + kinds if len(found) == 1 else grams[found[:-1]][j] + 1
                out[j] += log((grams[found][j] + 0.05) / (before + 0.05 * kinds)) + log(0.4) * (4 - len(found))
    return out


def test_language_against_plain_backoff(spark):
    import re
    from math import exp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.filter(~language.held_out("doc_id"))
    model = language.learn(train, per_language=10**9)
    words, grams, langs = Counter(), Counter(), model.langs
    counts = {x: Counter() for x in langs}
    for r in train.filter("lang is not null and text is not null").collect():
        counts[r["lang"]].update(re.findall(r"[^\W\d_]+", r["text"].lower()))
    every = {w for c in counts.values() for w in c}
    words = {w: [c[w] if c[w] >= 3 else 0 for c in counts.values()] for w in every if any(c[w] >= 3 for c in counts.values())}
    grams = defaultdict(lambda: [0] * len(langs))
    for j, c in enumerate(counts.values()):
        for w, n in c.items():
            m = f"<{w}>"
            for k in range(1, 5):
                for i in range(len(m) - k + 1):
                    grams[m[i : i + k]][j] += n
    some = [*sorted(every)[:300], "zzqy", "日本", "a", "éé", "the"]
    got = language.scores_of(pa.array(some), model)
    for w, row in zip(some, got, strict=True):
        assert row.tolist() == pytest.approx(plain_scores(w, len(langs), words, grams), rel=1e-4)
    # the prediction and its score, from the same sums
    memory = {}
    for r in language.identify(docs, model, ["doc_id", "text"]).collect():
        found = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        sums = [sum(x) for x in zip(*[memory.setdefault(w, plain_scores(w, len(langs), words, grams)) for w in found], strict=True)]
        odds = [exp((x - max(sums)) / len(found) * min(10, len(found))) for x in sums]
        assert r["lang_pred"] == langs[sums.index(max(sums))]
        assert r["score"] == pytest.approx(max(odds) / sum(odds), rel=1e-3)


def test_rare_letters_count_as_unknown(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LETTERS", 3)
    model = language.learn(spark.createDataFrame([(i, "abab abba baz", "x") for i in range(5)], "doc_id long, text string, lang string"))
    assert len(model.letters) == 3 and chr(model.letters[-1]) == "b"
    assert language.scores_of(pa.array(["zz", "ab"]), model).shape == (2, 1)


def test_words_as_the_tokenizer_gives_them():
    tok = Tokenizer.from_file(PATH)
    texts = ["Hello, WORLD's a1b2", "İstanbul ΣΣ éÉ ''s", None, "", "x<|endoftext|>y <| 'sun I'LL", "Åa A\u030a ½²ªº×÷µſŉẞŸŒ 日本\x00\x1f\x7f\x85\xa0z", " \n\t ", "12 3a4,,b--C"]
    ids, at = packing.encode_texts(pa.array(texts), PATH)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 0]


def test_packing_holds_a_part_of_a_batch():
    """Texts of a batch are encoded in parts of about a million bytes: what is held does not follow the batch."""
    texts = [f"word{i % 50} and more of text {i}. " * 200 for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    parts = list(packing.piece_batches(iter([batch]), public_tokenizers.path("word_bpe_49k.json"), 2048))
    assert len(parts) > sum(map(len, texts)) // 1_100_000 > 1
    assert sorted({d for p in parts for d in p.column("doc_id").to_pylist()}) == list(range(400))
