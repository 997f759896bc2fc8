"""Mixing sources to target weights: tokens per source give repetition rates, rates give copies.

Each document is emitted floor(rate) times, and once more when a number in [0, 1) hashed from
the seed and its id lies below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, join_stats, n_words_of, unit_hash

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(`_source`, `source`, `_size`) summed per source; adds each source's target.

    Sources in code point order, null last, weigh `weights`, repeating. The targets share the
    whole size by weight but stop at `most` times the source's own size, and the excess is shared
    again until none is above. Sources ordered by limit per weight are full up to some point; the
    level shared by the others follows from running sums, so no iteration is needed. The windows
    run over one row per source.
    """
    n = len(weights)
    per_source = sizes.groupBy("_source").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    fill = Window.orderBy("_limit_rate", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    place = (F.row_number().over(by_name) - 1) % n + 1
    return (
        per_source.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
        .withColumn("_limit", F.col("source_size") * most)
        .withColumn("_limit_rate", F.col("_limit") / F.col("_weight"))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.when(F.col("_left") / F.col("_weights") <= F.col("_limit_rate"), F.col("_left") / F.col("_weights")))
        .withColumn("_level", F.first("_level", True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("_source", "source_size", F.least("_limit", F.col("_level") * F.col("_weight")).alias("target"))
    )


def with_copies(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds `size` (words), `source_size`, `target` and `copies` (0 to 3) to `docs`, which must not
    have columns of these names or one that begins with an underscore, but `_row`.

    Null texts have size 0 and a null source is a source of its own. A source without words has
    target 0 and none of its documents is taken. Repeated rows share their document id's hash, so
    reruns and copies agree.
    """
    sized = docs.withColumns({"size": n_words_of(F.col("text")), "_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))})
    targets = source_targets(sized.select("_source", "source", "size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = (unit_hash(seed, F.col("doc_id")) < rate - whole).cast("int")
    return join_stats(sized, targets, "_source", "doc_id").withColumn("copies", whole.cast("int") + extra).drop("_source")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixture itself: every document `copies` times, with the columns of `docs`, whatever their
    names. Of an empty table nothing is taken."""
    own = boxed(docs, "doc_id", "source", "text")
    taken = with_copies(own, seed).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
