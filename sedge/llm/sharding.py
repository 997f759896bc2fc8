"""Proportional stratified interleaving: shards of equal row counts that all match the mixture.

Rows of a source are put in a seeded random order; row r of n gets the fractional rank
(r - 1/2) / n; all rows, sorted by that rank, are cut into shards of equal length. A shard then
holds every source in proportion, within a row or two.

Ranks come from counts of hash buckets plus a row number inside a bucket, so neither a source
with a third of all rows nor the global order ever meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed


def ranked(rows: DataFrame, group: str, bucket: str, order: list[str], rank: str, total: str) -> DataFrame:
    """Adds the 0-based `rank` of each row by (bucket, order) inside `group`, and the group's `total`.

    Only counts per (group, bucket) are summed along a group; rows are numbered per bucket. The counts, which may
    be nearly as many as the rows, are merged: by the bytes of the rows' files Spark would broadcast them.
    """
    along = Window.partitionBy(group).orderBy(bucket)
    counts = (
        rows.groupBy(group, bucket)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn(total, F.sum("_n").over(Window.partitionBy(group)))
        .select(group, bucket, F.coalesce("_before", F.lit(0)).alias("_before"), total)
    )
    inside = F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order))
    return (
        rows.withColumn("_inside", inside)
        .join(counts.hint("merge"), [group, bucket])
        .withColumn(rank, F.col("_before") + F.col("_inside") - 1)
        .drop("_before", "_inside")
    )


def interleave(rows: DataFrame, source: str, key: list[str], n_shards: int, seed: str = "shard", hex_digits: int = 4) -> DataFrame:
    """`rows` with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in a shard).

    Shard sizes differ by one row at most. A null source is a source of its own. `key` names the
    columns that decide the shuffle; equal rows take neighbouring places in either order. An empty
    table stays empty. `hex_digits` sets the number of hash buckets, 16 to that power per source;
    the buckets are numbered one by one, so it is raised where a bucket would outgrow a task.
    Columns of `rows` may have any names; a `shard` or `slot` of their own is replaced.
    """
    rows = boxed(rows.drop("shard", "slot"), *dict.fromkeys([source, *key]))
    rows = rows.select("_row", F.col(source).alias("_from"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)])
    key = [f"_k{i}" for i in range(len(key))]
    buckets = 16**hex_digits
    text = F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in key])
    rows = (
        rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("_from")), F.lit("")))
        .withColumn("_key", F.md5(text))
        .withColumn("_bucket", F.substring("_key", 1, hex_digits))
    )
    rows = ranked(rows, "_source", "_bucket", ["_key", *key], "_rank", "_total")
    rows = (
        rows.withColumn("_at", (F.col("_rank") + 0.5) / F.col("_total"))
        .withColumn("_bucket", F.floor(F.col("_at") * buckets))
        .withColumn("_all", F.lit(0))
    )
    rows = ranked(rows, "_all", "_bucket", ["_at", "_key", *key], "_place", "_rows")
    return (
        rows.withColumn("shard", F.expr(f"(_place * {n_shards}) div _rows").cast("int"))
        .withColumn("slot", F.col("_place") - F.expr(f"(shard * _rows + {n_shards - 1}) div {n_shards}"))
        .select("_row.*", "shard", "slot")
    )
