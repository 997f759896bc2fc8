"""Target-distribution importance resampling over hashed n-gram features.

Long texts are cut at word boundaries into chunks that carry the next n - 1 words along; a chunk owns
the features that start before what it carries, so every feature counts once. Chunks of one text
are dealt out; their feature counts and weights are sums, by bucket and by document.

Buckets of features are counted in all documents and in the target texts; the gain of a bucket is
the logarithm of its smoothed share in the target over that in the documents. Documents are drawn
without replacement by their mean gain plus Gumbel noise that a hash of their id decides.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .wording import plain, slices

#: Texts of more bytes are cut into chunks of about so many.
CHUNK_BYTES = 65_536
#: Buckets of features that a task remembers.
HELD = 200_000
#: Scores are counted in steps of so many, to find where the draw ends.
STEP = 100


class Buckets(dict):
    """The bucket of each feature."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.n
        return bucket


def chunks_of(text: bytes, n: int, size: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of about `size` bytes with the n - 1 words after them, and the words that each owns."""
    words, lo = text.split(), 0
    while lo < len(words) or not lo:
        hi, length = lo, 0
        while hi < len(words) and (hi == lo or length + len(words[hi]) < size):
            length += len(words[hi]) + 1
            hi += 1
        yield b" ".join(words[lo : hi + n - 1]), hi - lo
        lo = max(hi, lo + 1)


def chunked(docs: DataFrame, n: int, size: int = CHUNK_BYTES) -> DataFrame:
    """(row, doc_id, text, own) of the texts: short ones as they are (row and own null), long ones as chunks
    with the words each owns, written down so that readers take them chunk by chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(batch.column("row"), batch.column("doc_id"), batch.column("text"), strict=True):
                for part, own in chunks_of(bytes(plain(pa.array([text.as_py()], pa.string()))[0].as_buffer()), n, size):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([doc.as_py()], batch.schema.field("doc_id").type), pa.array([part], pa.binary()).cast(pa.string()), pa.array([own], pa.int64())], names=["row", "doc_id", "text", "own"])

    docs, length = docs.select("doc_id", "text"), F.coalesce(F.octet_length("text"), F.lit(0))
    long_ones = docs.filter(length > size).withColumn("row", F.monotonically_increasing_id())
    long_ones = staged(long_ones.mapInArrow(run, f"row long, doc_id {kind}, text string, own long"))
    return docs.filter(length <= size).select(F.lit(None).cast("long").alias("row"), "doc_id", "text", F.lit(None).cast("long").alias("own")).unionByName(long_ones)


def features(words: list[bytes], own: int | None, n: int, buckets: Buckets) -> np.ndarray:
    """The buckets of all runs of 1 to n words that start at the words owned (all of them if null)."""
    own = len(words) if own is None else own
    found = [np.fromiter(map(buckets.__getitem__, words[:own]), np.int64, min(own, len(words)))]
    for size in range(2, n + 1):
        runs = [b" ".join(words[i : i + size]) for i in range(min(own, len(words) - size + 1))]
        found.append(np.fromiter(map(buckets.__getitem__, runs), np.int64, len(runs)))
    return np.concatenate(found)


def each_text(batch: pa.RecordBatch, n: int, buckets: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the number of its own words and the buckets of its features."""
    for text, own in zip(plain(batch.column("text")), batch.column("own").to_pylist(), strict=True):
        words = bytes(text.as_buffer()).split()
        yield len(words) if own is None else own, features(words, own, n, buckets)


def bucket_counts(texts: DataFrame, n: int, n_buckets: int) -> np.ndarray:
    """How many features of the chunks fall into each bucket. Tasks send sums; n_buckets numbers come here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(n_buckets), np.zeros(n_buckets, np.int64)
        for batch in slices(batches):
            for _, found in each_text(batch, n, buckets):
                np.add.at(total, found, 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    sums = texts.select("text", "own").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_buckets, np.int64)
    out[np.asarray(sums.column("bucket"))] = np.asarray(sums.column("n"))
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's share in the target over its share here, rounded down; counts smoothed by one."""
    n, s_all, t_all = len(own), int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: Column, seed: str) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(texts: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """(doc_id, n_words, n_features, gain) per document: the sums of its chunks."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(len(gain))
        for batch in slices(batches):
            sums = [(words, len(found), int(gain[found].sum())) for words, found in each_text(batch, n, buckets)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *[pa.array([x[i] for x in sums], pa.int64()) for i in range(3)]], names=["row", "doc_id", "n_words", "n_features", "gain"])

    each = lambda some: some.mapInArrow(run, f"row long, doc_id {kind}, n_words long, n_features long, gain long")
    sums = each(texts.filter("row is not null")).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    return each(texts.filter("row is null")).unionByName(sums).drop("row")


def drawn(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """`scored` with rank: 1, 2, ... for the highest scores among documents of enough words, `percent` of
    these, ties to the smaller doc_id; null for the others.

    Where the draw ends comes from counts per step of scores, a few thousand at most. What may
    be drawn is sorted by ranges; a rank is the place in its range after the sizes of those before.
    """
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()).withColumn("step", F.floor(F.col("score") / STEP)))
    enough = F.col("n_words") >= least_words
    steps = sorted(((r["step"], r["n"]) for r in scored.filter(enough).groupBy("step").agg(F.count("*").alias("n")).collect()), reverse=True)
    take = percent * sum(n for _, n in steps) // 100
    last, seen = None, 0
    for step, n in steps:
        if seen < take:
            last, seen = step, seen + n
    may = enough & (F.col("step") >= F.lit(last)) if last is not None else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features", "row"]
    top = scored.filter(may).repartitionByRange(*order).sortWithinPartitions(*order)
    top = staged(top.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = top.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    top = top.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("at") + 1)
    top = top.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return top.select(columns).unionByName(scored.filter(~may).withColumn("rank", F.lit(None).cast("long")).select(columns))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, n_buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and rank (null: not drawn).

    Features are all runs of 1 to n words; words are runs of letters, digits and non-ASCII
    characters, ASCII in lower case. The weight is the mean gain of a document's features rounded
    down, 0 without any; null and wordless texts have none. Documents of fewer than `least_words`
    words are never drawn. Rows that share an id are documents of their own with the same noise; a
    null id takes the noise of an empty one and loses ties. Equal rows take neighbouring ranks in
    either order. An empty table gives no rows; without target texts all counts there are 0. Other columns
    are not read.
    """
    texts = chunked(docs, n, chunk_bytes)
    aims = chunked(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, chunk_bytes)
    gain = gains(bucket_counts(texts, n, n_buckets), bucket_counts(aims, n, n_buckets))
    rows = weighed(texts, gain, n)
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = rows.select("doc_id", "n_words", "n_features", mean.alias("weight"), (mean + gumbel(F.col("doc_id"), seed)).alias("score"))
    return drawn(scored, least_words, percent)
