"""The tolerant baseline: known violations found again although their lines have moved."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class FreeEntries:
    """The unused entries of a cluster, by line. A line that is used up points to its neighbours, and
    pointers are shortened on the way, so finding the next free line takes nearly constant time."""

    def __init__(self, entries: list[tuple[int, int]]):
        """`entries` are (line, ord), sorted."""
        self.lines: list[int] = []
        self.ords: list[list[int]] = []
        for line, ord_ in entries:
            if not self.lines or self.lines[-1] != line:
                self.lines.append(line)
                self.ords.append([])
            self.ords[-1].append(ord_)
        for some in self.ords:
            some.reverse()  # the first listed is taken from the end
        n = len(self.lines)
        self.after = list(range(n + 1))  # place n: none
        self.before = list(range(n + 1))  # of place i - 1; 0: none

    @staticmethod
    def find(pointers: list[int], i: int) -> int:
        while pointers[i] != i:
            pointers[i] = pointers[pointers[i]]
            i = pointers[i]
        return i

    def take(self, line: int, tolerance: int) -> bool:
        """Uses up the nearest entry within `tolerance` lines, the first listed of two, if there is one."""
        place = bisect_left(self.lines, line)
        right, left = self.find(self.after, place), self.find(self.before, place) - 1
        near = [(abs(self.lines[i] - line), self.ords[i][-1], i) for i in (left, right) if 0 <= i < len(self.lines)]
        near = [x for x in near if x[0] <= tolerance]
        if not near:
            return False
        i = min(near)[2]
        self.ords[i].pop()
        if not self.ords[i]:
            self.after[i] = i + 1
            self.before[i + 1] = i
        return True


def clusters(rows: DataFrame, tolerance: int) -> DataFrame:
    """`rows` (file, rule_id, line) with `cluster`: lines of one cluster have no gap of more than
    `tolerance` between neighbours, so only they can meet."""
    along = Window.partitionBy("file", "rule_id").orderBy("line")
    gap = F.coalesce((F.col("line") - F.lag("line").over(along) > tolerance).cast("int"), F.lit(0))
    return rows.withColumn("gap", gap).withColumn("cluster", F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")


def baseline_tolerant(violations: DataFrame, baseline: DataFrame, tolerance: int = 5, order: str = "emit_ord") -> DataFrame:
    """Violations without a baseline entry of their own: in order of emission each takes the nearest unused
    entry of its file and rule within `tolerance` lines (the first listed of two). `baseline` has ord.

    Each cluster of lines is decided on its own, in one pass: its entries come first, sorted by
    line, then its violations in order. A task holds the entries of one cluster.
    """
    v = violations.select("file", "rule_id", "line", F.lit(True).alias("found"), F.col(order).alias("turn"), F.lit(None).cast("long").alias("ord"), F.struct(*violations.columns).alias("row"))
    none = {c: F.lit(None).cast(v.schema[c].dataType).alias(c) for c in ("turn", "row")}
    b = baseline.select("file", "rule_id", "line", F.lit(False).alias("found"), none["turn"], F.col("ord").cast("long").alias("ord"), none["row"])
    both = clusters(v.unionByName(b), tolerance).repartition("file", "rule_id", "cluster").sortWithinPartitions("file", "rule_id", "cluster", "found", "turn", "line", "ord")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, entries, free = None, [], None
        for batch in batches:
            keep = []
            for *key, line, found, ord_ in zip(*[batch.column(c).to_pylist() for c in ("file", "rule_id", "cluster", "line", "found", "ord")], strict=True):
                if key != group:
                    group, entries, free = key, [], None
                if found:
                    free = free or FreeEntries(entries)
                    keep.append(not free.take(line, tolerance))
                else:
                    entries.append((line, ord_))
                    keep.append(False)
            yield pa.RecordBatch.from_struct_array(batch.column("row").filter(pa.array(keep, pa.bool_())))

    return both.select("file", "rule_id", "cluster", "line", "found", "ord", "row").mapInArrow(decide, violations.schema)
