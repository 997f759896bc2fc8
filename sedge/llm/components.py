"""Connected components of a graph held in a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge: label is the smallest node reachable from it.

    `edges` has two long columns a and b, non-null. Each round points every node at the smallest
    node it knows and replaces an edge by one between that node and the neighbour (large and small
    stars), so long chains shrink by rounds, not steps. Each round's edges are written to the shared
    folder; only their number and a checksum come to the driver, and rounds end when these stay.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, n = None, now.count()
    while True:
        # large star: every larger neighbour of a node, and the node, go to its least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m"))
        large = now.select(F.col("b").alias("n"), F.col("a").alias("larger")).join(bounded(least, 2 * n), "n").select(F.col("larger").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # small star: the smaller neighbours of a node, which are few now, and the node go to the least of them
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a"))).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = staged(small.select("e.*").filter("a <> b").distinct())
        # two independent sums over the distinct edges tell whether they are those of the round before
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if sums == before:
            break
        before, n = sums, sums[0]
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return bounded(nodes.unionByName(roots), 2 * n)
