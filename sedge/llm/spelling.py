"""Spelling variants by an even-partition pigeonhole join.

A word within one edit of another shares one of two halves with it. Every word is indexed under its
two halves, together with its length; words of the same length, and words one longer, probe that
index with the parts of theirs that can stand there: the first half at the start, the second half at
its place or, in a longer word, one further. Candidates meet on the key of a half, are verified and
counted once.

A half that very many words share is not paired as it is: what is still open in its words is a
shorter word with the same one edit, so it is cut into halves again, until the pairs of a key are
few. Groups therefore stay small however many words there are, and no pair is lost.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_stats, staged

#: Keys with more pairs than this are cut again, as that costs less than comparing them.
PAIRS = 500
#: Letters in lower case, other ASCII as a space. Bytes above stay: all of U+00C0 to U+00FF begin with C3.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LEAD = 0xC3
#: Texts are split piece by piece, cut between runs, and counts sent on when so many words are held.
PIECE, HELD = 1_000_000, 100_000


def folded(raw: bytes) -> bytes:
    """The text's bytes with letters in lower case and a space for whatever is no letter."""
    out = raw.translate(FOLD)
    if raw.isascii():
        return out
    b = np.frombuffer(out, np.uint8)
    lead = b == LEAD
    letter = (b < 128) | lead
    letter[1:] |= lead[:-1]
    return np.where(letter, b, 32).astype(np.uint8).tobytes()


def runs_of(raw: bytes, shortest: int) -> Iterator[bytes]:
    """The letter runs of a text that have `shortest` code points or more."""
    text, lo = folded(raw), 0
    while lo < len(text):
        hi = text.find(b" ", lo + PIECE)
        hi = len(text) if hi < 0 else hi
        yield from (w for w in text[lo:hi].split() if len(w) >= shortest and (w.isascii() or len(w) - w.count(LEAD) >= shortest))
        lo = hi


def without(word: bytes, at: int) -> bytes:
    """`word` without its code point number `at`."""
    if word.isascii():
        return word[:at] + word[at + 1 :]
    text = word.decode()
    return (text[:at] + text[at + 1 :]).encode()


def long_enough(word: bytes, shortest: int) -> bool:
    return len(word) - word.count(LEAD) >= shortest


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, modulus: int = 31) -> DataFrame:
    """(word, n): letter runs of the whole texts, ASCII in lower case. Where `modulus` divides the
    checksum of `doc_id:run`, the run loses the code point that the checksum names.

    Only words of `shortest` code points and `least` occurrences count. Deleting shortens, so
    shorter runs are not even taken. A null text has no words, a null doc_id is an empty name.
    Tasks send sums of what they have counted, so a frequent word costs each of them a few rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run in runs_of(bytes(text.as_buffer()), shortest) if text.is_valid else ():
                    h = zlib.crc32(run, prefix)
                    if h % modulus == 0:
                        run = without(run, h % (len(run) - run.count(LEAD)))
                        if not long_enough(run, shortest):
                            continue
                    counts[run] += 1
                if len(counts) >= HELD:
                    yield sums(counts)
                    counts = Counter()
        yield sums(counts)

    def sums(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def cut(entries: DataFrame) -> DataFrame:
    """Both halves of what is open in each entry: the key of the half, and the other one as open.

    Halves follow the length in the index, which the open part of a longer word exceeds by one: its
    second half ends where the word ends, so it stands one place further.
    """
    size = F.char_length("open") - F.col("longer").cast("int")
    half = F.floor(size / 2).cast("int")
    place = F.char_length("open") - (size - half)  # of the second half
    parts = [
        (1, F.substring("open", F.lit(1), half), F.substring("open", half + 1, F.char_length("open"))),
        (2, F.substring("open", place + 1, F.char_length("open")), F.substring("open", F.lit(1), place)),
    ]
    each = F.explode(F.array(*[F.struct(F.xxhash64("key", F.lit(k), part).alias("key"), rest.alias("open")) for k, part, rest in parts])).alias("e")
    return entries.select("word", "n", "longer", each).select("word", "n", "longer", "e.*")


def indexed(words: DataFrame) -> DataFrame:
    """The entries of each word: under its own length, as index and equal probe, and under one less."""
    roles = F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")
    whole = words.select("word", "n", roles).withColumn("open", F.col("word"))
    return cut(whole.withColumn("key", F.xxhash64(F.char_length("word") - F.col("longer").cast("int"))))


def paired(entries: DataFrame) -> DataFrame:
    """Verified pairs among entries of one key; `a` is the indexed word."""
    a = entries.filter("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    b = entries.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "key").filter((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "na", "b", "nb")


def near_pairs(words: DataFrame, most_pairs: int = PAIRS) -> DataFrame:
    """(a, na, b, nb), once for each two of the distinct `words` (word, n) that one edit parts."""
    found, entries = [], indexed(words)
    while True:
        entries = staged(entries)
        index, probes = F.count_if(~F.col("longer")), F.count_if("longer")
        keys = entries.groupBy("key").agg(index.alias("i"), probes.alias("j"), F.max(F.char_length("open") - F.col("longer").cast("int")).alias("size"))
        pairs = F.col("i") * (F.col("i") - 1) / 2 + F.col("i") * F.col("j")
        keys = staged(keys.filter(pairs > 0).select("key", ((pairs > most_pairs) & (F.col("size") > 1)).alias("hot")))
        some = entries.join(keys, "key")
        found.append(staged(paired(some.filter("not hot"))))
        if keys.filter("hot").isEmpty():
            break
        entries = cut(some.filter("hot"))
    return reduce(DataFrame.unionByName, found).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the way from form to form. A form is several times as
    frequent as its word, so ways end after a few steps; only words still on their way take the next."""
    ahead = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    rows, done = forms.select("word", F.col("form").alias("root")), []
    while True:
        # many variants may share a form
        new = staged(join_stats(rows, ahead, "root", "word", salts=8))
        done.append(new.filter("next is null").select("word", "root"))
        rows = new.filter("next is not null").select("word", F.col("next").alias("root"))
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


def variants(words: DataFrame, times: int = 10, most_pairs: int = PAIRS) -> DataFrame:
    """One row per row of `words` (word, n; words distinct): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them.
    The form is the near word of largest n, of equal ones the smallest by code points, if its n is
    at least `times` the word's (above 1), else null; the root is where forms end, the word itself without one.
    Words of any length are compared whole; a null word is dropped; an empty table gives no rows.
    """
    words = staged(words.select("word", "n").filter("word is not null"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("e")
    near = near_pairs(words, most_pairs).select(sides).select("e.*").groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    good = -F.col("best.minus") >= times * F.col("n")
    near = staged(near.select("word", "n_near", F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n")))
    roots = last_forms(near.filter("form is not null"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """`variants` of the words of documents, as `word_counts` takes them. Other columns are not read."""
    return variants(word_counts(docs))
