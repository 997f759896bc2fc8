"""Benchmark decontamination by winnowing.

Of the k-grams of every window of words, the one with the least hash is kept (of equal ones the
last). Two texts that share a whole window keep the same k-gram of it, so the kept ones, the
fingerprints, meet in a join wherever a window of a benchmark item stands in a document. A hit then
extends word by word to both sides; it counts if it grows to a whole window.

Documents are read once. Fingerprints that no item can have are dropped where they are made, by a
bit map of the items' fingerprints whose size is bounded; what is left carries its few neighbouring words,
so that extending needs neither text again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .windows import U, Words, mix, read_words
from .wording import plain, slices, words_in

#: A window holds so many k-grams; its k-grams are so many words, less one, shorter than it.
GRAMS = 3
#: Bits of the map: 64 for each fingerprint of the items, and at most 2 ** MOST_BITS.
MOST_BITS = 27
#: Bytes of the items' fingerprints up to which they are broadcast.
BROADCAST_BYTES = 16_000_000
CONTEXT = "key long, gram string, before array<string>, after array<string>"


def gram_size(window: int) -> int:
    return max(1, window - GRAMS + 1)


def fingerprints(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept k-grams of all windows of so many words, and a key of each that the window's size is part of."""
    k = gram_size(window)
    starts = words.starts(window)
    grams = words.windows(k)
    best = starts + window - k
    for step in range(window - k - 1, -1, -1):
        best = np.where(grams[starts + step] < grams[best], starts + step, best)
    best = np.unique(best)
    return best, mix(grams[best] + U(window)).view(np.int64)


def context(words: list[str], at: int, window: int) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """A k-gram, and the words before it (the nearest first) and after it that a window with it can hold."""
    k = gram_size(window)
    reach = window - k
    return " ".join(words[at : at + k]), tuple(words[max(0, at - reach) : at][::-1]), tuple(words[at + k : at + k + reach])


def item_fingerprints(items: DataFrame, window: int) -> DataFrame:
    """(item, size, key, gram, before, after) of items; an item shorter than `window` is one window of its own size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = plain(batch.column("text"))
            words = read_words(texts)
            sizes = np.minimum(np.diff(words.first), window)
            rows = []
            for size in np.unique(sizes[sizes > 0]).tolist():
                at, keys = fingerprints(words, size)
                item = np.searchsorted(words.first, at, side="right") - 1
                own = sizes[item] == size
                rows += [(i, size, key, place - int(words.first[i])) for i, key, place in zip(item[own].tolist(), keys[own].tolist(), at[own].tolist(), strict=True)]
            split = {i: words_in(texts[i]) for i in {r[0] for r in rows}}
            found = [(batch.column("item")[i].as_py(), size, key, *context(split[i], at, size)) for i, size, key, at in rows]
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([list(x) if isinstance(x, tuple) else x for x in c], t) for c, t in zip(columns, types, strict=True)], names=["item", "size", "key", "gram", "before", "after"])

    return items.mapInArrow(run, f"item string, size int, {CONTEXT}").distinct()


def bit_map(keys: DataFrame, n: int) -> np.ndarray:
    """A map with the bit of each of the n keys set, made in tasks; a bounded number of its words comes here."""
    bits = 1 << min(MOST_BITS, max(10, (64 * n).bit_length()))
    place = F.col("key").bitwiseAND(bits - 1)
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return out


def known(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = keys & (len(bits) * 64 - 1)
    return (bits[place >> 6].view(U) >> (place & 63).astype(U)) & U(1) > 0


def document_hits(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """(doc_id, n_words, hits) per document: its fingerprints that items may have, once per surrounding
    with all their places."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = plain(batch.column("text"))
            words = read_words(texts)
            hits: dict[int, dict[tuple, list[int]]] = {}
            for size in sizes:
                at, keys = fingerprints(words, size)
                some = known(keys, shared.value)
                at, keys = at[some], keys[some]
                doc, cuts = np.unique(np.searchsorted(words.first, at, side="right") - 1, return_index=True)
                for i, places, own in zip(doc.tolist(), np.split(at, cuts[1:]), np.split(keys, cuts[1:]), strict=False):
                    split, into = words_in(texts[i]), hits.setdefault(i, defaultdict(list))
                    for place, key in zip((places - words.first[i]).tolist(), own.tolist(), strict=True):
                        into[(size, key, *context(split, place, size))].append(place)
            rows = [[{"size": s, "key": k, "gram": g, "before": list(b), "after": list(a), "at": at} for (s, k, g, b, a), at in hits.get(i, {}).items()] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(rows, HITS)], names=["doc_id", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, hits array<struct<size: int, key: long, gram: string, before: array<string>, after: array<string>, at: array<int>>>")


HITS = pa.list_(pa.struct([("size", pa.int32()), ("key", pa.int64()), ("gram", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())), ("at", pa.list_(pa.int32()))]))


def agreeing(x: str, y: str) -> Column:
    """How many words two lists have in common at their starts."""
    differs = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(x)).cast("int")


def met(hits: DataFrame, items: DataFrame, salts: int = 16) -> DataFrame:
    """Hits and items of one fingerprint. The items' side is broadcast where its bytes are few, else
    spread, so that a passage that stands in a third of all documents meets many tasks."""
    names = {c: f"item_{c}" for c in ("gram", "before", "after")}
    items = items.drop("size").withColumnsRenamed(names)
    size = items.agg(F.sum(F.octet_length("item_gram") + F.octet_length(F.concat_ws(" ", "item_before", "item_after")) + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return hits.join(F.broadcast(items), "key")
    items = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return hits.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(items, ["key", "salt"]).drop("salt")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, spans (start, end: words, end exclusive; sorted, apart)
    and items (names, sorted as strings), of the benchmark items' windows that stand in it.

    Words are runs of letters, digits and non-ASCII characters, ASCII in lower case. A window is
    `window` consecutive words of an item; an item of fewer words is one window, one without words
    has none. Null texts have no words. Rows that share an id are documents of their own, a null id stays null.
    Items of one id count once; a null item_id is named by an empty string. Equal items are all
    named. Without items, or in an empty table, nothing is hit. Other columns are not read.
    """
    items = staged(item_fingerprints(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"), window))
    count = items.count()
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most `window`
    found = document_hits(docs.select("doc_id", "text"), sizes, bit_map(items, count))
    # rows are numbered as they are written, so that numbers stay whatever is computed again
    found = staged(found.withColumn("row", F.monotonically_increasing_id()))
    hits = found.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    left, right = agreeing("before", "item_before"), agreeing("after", "item_after")
    k = F.greatest(F.lit(1), F.col("size") - GRAMS + 1)
    whole = (F.col("gram") == F.col("item_gram")) & (left + k + right >= F.col("size"))
    matches = staged(met(hits, items).filter(whole).select("row", "item", "at", left.alias("left"), (k + right).alias("right")))
    named = matches.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    each = matches.select("row", "at", "left", "right").distinct().select("row", F.explode("at").alias("at"), "left", "right")
    spans = each.select("row", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end")).distinct()
    along = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(along))
    spans = spans.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    none = F.from_json(F.lit("[]"), "array<struct<start: int, end: int>>").alias("spans"), F.array().cast("array<string>").alias("items")
    clean = found.filter(F.size("hits") == 0).select("doc_id", "n_words", *none)
    hit = found.filter(F.size("hits") > 0).select("row", "doc_id", "n_words").join(spans, "row", "left").join(named, "row", "left")
    return clean.unionByName(hit.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")))
