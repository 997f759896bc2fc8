"""Operators on the nested-set table of nodes: ancestors and descendants, and the order in which walkers visit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Slots in the order in which a walker takes them, where it does not take them as they stand in the text.
LOOP_WALK = {"ForStmt": ("body", "init", "condition", "update"), "WhileStmt": ("body", "condition"), "IfStmt": ("then", "else", "condition")}
USE_WALK = {"TryStmt": ("body", "finally", "catch_clauses")}


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that is not to be broadcast. Spark sizes what comes from nodes by the table that the
    texts came from, before parsing and unfolding, so that many rows of every file seem few."""
    return side.hint("merge")


def visit_key(walk: dict[str, tuple[str, ...]] | None = None, *more: Column) -> Column:
    """When a walker comes to a node, as an array that sorts in order of visits: the slot's rank and
    the node on each step from the root. A node comes before what is below it. `more` tells apart
    what is found on one node: -1 and a number, so that it comes before what is below, too."""
    ranks = [x for kind, slots in (walk or {}).items() for i, s in enumerate(slots) for x in (F.lit(f"{kind}.{s}"), F.lit(i))]
    rank = (lambda e: F.coalesce(F.create_map(*ranks)[e], F.lit(0))) if ranks else (lambda e: F.lit(0))
    steps = F.flatten(F.zip_with("edge_path", "nid_path", lambda e, n: F.array(rank(e), n)))
    return F.concat(steps, F.array(F.lit(-1), *[m.cast("int") for m in more])) if more else steps


def contained(ancestors: DataFrame, descendants: DataFrame) -> DataFrame:
    """Pairs (ancestor, descendant), structs of the rows of both, where the descendant lies below the
    ancestor. Both have file, nid and end_nid.

    Both sides are merged in one pass per file in the order of nid: a stack holds the ancestors that
    are still open, whose depth bounds it. No pair of rows is tested in vain, and no range joined.
    """
    kinds = [F.struct(*d.columns).alias("row") for d in (ancestors, descendants)]
    a = ancestors.select("file", "nid", "end_nid", F.lit(1).alias("side"), kinds[0].alias("ancestor"))
    d = descendants.select("file", "nid", "end_nid", F.lit(0).alias("side"), kinds[1].alias("descendant"))
    # of equal nids the descendant comes first, as no node is below itself
    rows = a.unionByName(d, allowMissingColumns=True).repartition("file").sortWithinPartitions("file", "nid", "side")
    schema = a.select("ancestor").schema.fields + d.select("descendant").schema.fields

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []  # (end, ancestor)
        for batch in batches:
            above, places = [], []
            rows = zip(*[batch.column(c).to_pylist() for c in ("file", "nid", "end_nid", "side")], strict=True)
            for i, (f, nid, end, side) in enumerate(rows):
                if f != file:
                    file, open_ = f, []
                while open_ and open_[-1][0] < nid:
                    open_.pop()
                if side:
                    open_.append((end, batch.column("ancestor")[i].as_py()))
                else:
                    above += [x for _, x in open_]
                    places += [i] * len(open_)
            yield pa.RecordBatch.from_arrays([pa.array(above, batch.column("ancestor").type), batch.column("descendant").take(pa.array(places, pa.int64()))], names=["ancestor", "descendant"])

    return rows.select("file", "nid", "end_nid", "side", "ancestor", "descendant").mapInArrow(merge, StructType(schema))


def counts_between(intervals: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """`intervals` (the columns `by`, lo, hi and others) with n: how many `events` (`by`, nid) of their
    key have lo <= nid <= hi.

    The number of events up to a place is a running count along nid, so an interval's count is a
    difference of two ranks: one sorted pass per key, however much intervals overlap.
    """
    key = [F.col(c) for c in by]
    ends = F.explode(F.array(F.struct((F.col("lo") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign")))).alias("_end")
    asked = intervals.select(*key, F.struct(*intervals.columns).alias("_row"), ends).select(*by, "_row", "_end.*", F.lit(0).alias("one"))
    told = events.select(*key, F.col("nid").alias("at"), F.lit(0).alias("sign"), F.lit(1).alias("one"))
    along = Window.partitionBy(*by).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = asked.unionByName(told, allowMissingColumns=True).withColumn("rank", F.sum("one").over(along))
    return ranked.filter("sign <> 0").groupBy("_row").agg(F.sum(F.col("sign") * F.col("rank")).alias("n")).select("_row.*", "n")


def subtree_counts(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, nid, n_below): how many of `nodes` lie below each of `roots`, itself left out."""
    below = roots.select("file", "nid", (F.col("nid") + 1).alias("lo"), F.col("end_nid").alias("hi"))
    return counts_between(below, nodes, ["file"]).select("file", "nid", F.col("n").alias("n_below"))


def around(*kinds: str) -> Column:
    """The number of the innermost node of these kinds above a node; null without one."""
    return F.array_max(F.transform("edge_path", lambda e, i: F.when(F.substring_index(e, ".", 1).isin(*kinds), parent_at(i))))


def parent_at(i: Column) -> Column:
    """The node above the node that step i of the path (from 0) leads to; the root has number 0."""
    return F.when(i == 0, F.lit(0)).otherwise(F.get("nid_path", i - 1))
