"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unknown one is read by character
n-grams, the longest known one at each position, each step to a shorter one at a penalty. The
model is learned from a bounded sample of labelled documents, so its size does not follow the corpus.
It is a few flat arrays: the known words, and per length the n-grams as numbers in sorted order, each
with one row of a float32 matrix. All unknown words of a slice are scored at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import quoted, unit_hash
from .packing import slices

LETTERS = r"\p{L}+"
MAX_N = 4
BACKOFF = math.log(0.4)
#: Different letters that n-grams may hold (four of them fit one number); rarer ones count as unknown.
MOST_LETTERS = 50_000


@dataclass
class Model:
    """Words and n-grams of a sample; row i of a score matrix is for entry i, a column a language."""

    langs: list[str]
    words: pa.Array
    word_scores: np.ndarray
    letters: np.ndarray  # sorted code points of the n-grams; number i + 1 stands for letters[i]
    grams: list[np.ndarray]  # for sizes 1 to MAX_N: n-grams as numbers, sorted
    gram_scores: list[np.ndarray]


NOTHING = Model([], pa.array([], pa.string()), np.zeros((0, 0), np.float32), np.zeros(0, np.uint32), [np.zeros(0, np.int64)] * MAX_N, [np.zeros((0, 0), np.float32)] * MAX_N)


def learn(labelled: DataFrame, per_language: int = 2000, min_count: int = 3, seed: str = "language") -> Model:
    """A model from rows of (doc_id, text, lang): about `per_language` hash-chosen documents of
    each language (all, if it has fewer), words seen `min_count` times or more, and the n-grams of
    all their words. Null texts and languages are ignored; no rows give a model without languages.
    """
    labelled = labelled.filter("lang is not null and text is not null")
    per = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return NOTHING
    share = F.create_map(*[F.lit(x) for k, v in per.items() for x in (k, per_language / v)])
    sample = labelled.filter(unit_hash(seed, F.col("doc_id")) < F.element_at(share, F.col("lang")))
    words = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    marked = words.select("lang", "n", F.concat(F.lit("<"), "word", F.lit(">")).alias("w"), F.length("word").alias("k"))
    grams = (
        marked.select("lang", "n", "w", F.explode(F.sequence(F.lit(1), F.lit(MAX_N))).alias("size"), "k")
        .filter("size <= k + 2")
        .select("lang", "n", F.explode(F.expr("transform(sequence(1, k + 3 - size), i -> substring(w, i, size))")).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    langs = sorted(per)
    known = counts_of(words.filter(F.col("n") >= min_count).select("lang", F.col("word").alias("key"), "n"), langs)
    return as_logs(langs, *known, *counts_of(grams.select("lang", F.col("gram").alias("key"), "n"), langs))


def counts_of(rows: DataFrame, langs: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Distinct keys, and how often each language has them."""
    found = rows.toArrow().combine_chunks()
    keys = found.column("key").combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    counts = np.zeros((len(keys.dictionary), len(langs)))
    at = pc.index_in(found.column("lang"), value_set=pa.array(langs, pa.string()))
    np.add.at(counts, (np.asarray(keys.indices), np.asarray(at)), np.asarray(found.column("n")))
    return keys.dictionary, counts


def as_logs(langs: list[str], words: pa.Array, word_counts: np.ndarray, grams: pa.Array, gram_counts: np.ndarray) -> Model:
    """Counts to smoothed log frequencies (words) and log probabilities of a character after those before it (n-grams)."""
    scores = np.log((word_counts + 0.1) / (word_counts.sum(axis=0) + 0.1 * len(words) + 1)).astype(np.float32)
    points, size, _ = points_of(grams)
    used, at = np.unique(points, return_inverse=True)
    if len(used) > MOST_LETTERS:
        often = np.bincount(at, weights=np.repeat(gram_counts.sum(axis=1), size))
        used = np.sort(used[np.argsort(-often, kind="stable")[:MOST_LETTERS]])
    by_size, known = [], letters_of(points, used)
    first = np.cumsum(size) - size
    for k in range(1, MAX_N + 1):
        some = np.flatnonzero(size == k)
        numbers = np.zeros(len(some), np.int64)
        whole = np.ones(len(some), bool)
        for i in range(k):
            letter = known[first[some] + i]
            numbers, whole = numbers * (len(used) + 1) + letter, whole & (letter > 0)
        order = np.argsort(numbers[whole], kind="stable")
        by_size.append((numbers[whole][order], gram_counts[some[whole][order]]))
    single = by_size[0][1]
    kinds = len(single)
    logs = [np.log((single + 0.05) / (single.sum(axis=0) + kinds + 0.05 * kinds)).astype(np.float32)]
    for (short, before), (numbers, counts) in zip(by_size, by_size[1:], strict=False):
        prior = before[np.searchsorted(short, numbers // (len(used) + 1))] + 1
        logs.append(np.log((counts + 0.05) / (prior + 0.05 * kinds)).astype(np.float32))
    return Model(langs, words, scores, used, [n for n, _ in by_size], logs)


def points_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of strings end to end, how many each has, and where each begins."""
    size = np.asarray(pc.utf8_length(words)).astype(np.int64)
    text = "".join(words.to_pylist())
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), size, np.cumsum(size) - size


def letters_of(points: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The number of each code point among `letters`, from 1; 0 for others."""
    if not len(letters):
        return np.zeros(len(points), np.int64)
    at = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
    return np.where(letters[at] == points, at + 1, 0).astype(np.int64)


def backoff_scores(words: pa.Array, model: Model) -> np.ndarray:
    """Log scores of unknown words: at each character after the opening mark the longest known n-gram
    that ends there, each shorter size at a penalty."""
    marked = pc.binary_join_element_wise("<", words, ">", "")
    points, size, first = points_of(marked)
    letter = letters_of(points, model.letters)
    base = len(model.letters) + 1
    end = np.ones(len(points), bool)
    end[first] = False
    end = np.flatnonzero(end)
    room = end - np.repeat(first, size)[end] + 1  # characters of the word up to here
    row, at_size = np.full(len(end), -1), np.zeros(len(end), np.int64)
    open_ = np.arange(len(end))
    for k in range(MAX_N, 0, -1):
        some = open_[room[open_] >= k]
        numbers = np.zeros(len(some), np.int64)
        whole = np.ones(len(some), bool)
        for i in range(k - 1, -1, -1):
            one = letter[end[some] - i]
            numbers, whole = numbers * base + one, whole & (one > 0)
        table = model.grams[k - 1]
        if len(table):
            at = np.minimum(np.searchsorted(table, numbers), len(table) - 1)
            hit = whole & (table[at] == numbers)
            row[some[hit]], at_size[some[hit]] = at[hit], k
        open_ = open_[at_size[open_] == 0]
    scores = np.repeat((BACKOFF * (MAX_N - at_size) + (at_size == 0) * BACKOFF)[:, None], len(model.langs), axis=1)
    for k in range(1, MAX_N + 1):
        some = np.flatnonzero(at_size == k)
        scores[some] += model.gram_scores[k - 1][row[some]]
    return np.add.reduceat(scores, np.cumsum(size - 1) - (size - 1), axis=0) if len(words) else np.zeros((0, len(model.langs)))


def scores_of(words: pa.Array, model: Model) -> np.ndarray:
    """Log scores of distinct non-empty words in each language."""
    at = np.asarray(pc.fill_null(pc.index_in(words, value_set=model.words), -1))
    scores = np.zeros((len(words), len(model.langs)))
    scores[at >= 0] = model.word_scores[at[at >= 0]]
    scores[at < 0] = backoff_scores(words.filter(pa.array(at < 0)), model)
    return scores


def predict_texts(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    n, langs = len(texts), model.langs
    if not langs:
        return ["und"] * n, np.zeros(n)
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+")
    words = split.flatten().dictionary_encode()
    real = np.asarray(pc.not_equal(words.dictionary, "")).astype(bool)
    scores = np.zeros((len(real), len(langs)))
    scores[real] = scores_of(words.dictionary.filter(pa.array(real)), model)
    codes = np.asarray(words.indices)
    offsets = np.asarray(split.offsets).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(doc, weights=real[codes].astype(float), minlength=n)
    sums = np.stack([np.bincount(doc, weights=scores[codes, j], minlength=n) for j in range(len(langs))], axis=1)
    # mean evidence of a word, times at most ten words: long texts are not all scored 1
    mean = sums / np.maximum(count, 1)[:, None] * np.minimum(count, 10)[:, None]
    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
    odds /= odds.sum(axis=1, keepdims=True)
    best = sums.argmax(axis=1)
    none = count == 0
    return [("und" if z else langs[b]) for b, z in zip(best.tolist(), none.tolist(), strict=True)], np.where(none, 0.0, odds[np.arange(n), best])


def identify(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """`columns` of `docs` plus lang_pred and score (0 to 1), read from the column `text` (or the field
    of a struct, `column.field`), which goes to Python once.

    Whole texts are read. A null text, one without a letter, and any text under a model without
    languages are `und` with score 0. Ties go to the first language in order. Repeated rows get
    equal results. `docs` may have its own `score` or `lang_pred` if they are not in `columns`.
    """
    fields = [f for f in docs.schema if f.name in columns]
    fields.sort(key=lambda f: columns.index(f.name))
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, not by the corpus
    head, *inside = text.split(".")
    sent = [F.col(quoted(c)) for c in columns]
    if head not in columns:
        head, inside = "_text", []
        sent.append(F.col(text).alias(head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(head)
            for field in inside:
                texts = pc.struct_field(texts, field)
            for lo, hi in slices(texts) if batch.num_rows else ():
                part = batch.slice(lo, hi - lo)
                lang, score = predict_texts(texts.slice(lo, hi - lo), shared.value)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])

    return docs.select(*sent).mapInArrow(run, schema)


def held_out(doc_id):
    """True where crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
