"""Relational operators over violations: diffs, baselines, order, counts, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sarif_level
from ..schemas import SEVERITIES, sev_rank
from .matching import baseline_tolerant  # noqa: F401

def select_rules(rules: DataFrame, disabled: tuple[str, ...] = (), enabled: tuple[str, ...] = (), min_severity: str = "info") -> DataFrame:
    """Rules that run: not disabled by themselves or by id, in the list of enabled ones if there is
    one, and of at least min_severity. It is rules that are filtered, not rows."""
    kept = rules.filter(F.col("enabled") & (sev_rank(F.col("severity")) >= SEVERITIES.index(min_severity)))
    kept = kept.filter(~F.col("id").isin(*disabled)) if disabled else kept
    return kept.filter(F.col("id").isin(*enabled)) if enabled else kept

def changed_files(files: DataFrame, diffs: DataFrame) -> DataFrame:
    return files.join(diffs.select("file"), "file", "left_semi")

def in_ranges(line: Column, end_line: Column, ranges: Column, policy: Column) -> Column:
    """Whether a violation lies in the changed ranges: by its line (anchor) or any of its lines (intersect).
    A file without ranges passes everything."""
    last = F.when(policy == "intersect", F.coalesce(end_line, line)).otherwise(line)
    return ranges.isNull() | (F.size(ranges) == 0) | F.exists(ranges, lambda r: (r["start"] <= last) & (line <= r["end"]))

def filter_by_diff(violations: DataFrame, diffs: DataFrame, policies: dict[str, str] | None = None) -> DataFrame:
    """Violations in changed lines; the ranges are an array per file, so the join is on the file alone."""
    policy = F.lit("anchor")
    for rule, p in (policies or {}).items():
        policy = F.when(F.col("rule_id") == rule, p).otherwise(policy)
    ranges = diffs.groupBy("file").agg(F.flatten(F.collect_list("ranges")).alias("_ranges"))
    return violations.join(ranges, "file", "left").filter(in_ranges(F.col("line"), F.col("end_line"), F.col("_ranges"), policy)).drop("_ranges").select(*violations.columns)

def translate_line(line: Column, hunks: Column, strict: bool = False) -> Column:
    """The new number of an old line by hunks (os, ol, ns, nl); null if the line is gone or there are no hunks.

    A pure insertion "-s,0" counts as before line s; with `strict` as after it, as diffs mean it.
    """
    zero = F.struct(F.lit(0).alias("shift"), F.lit(None).cast("int").alias("to"), F.lit(False).alias("done"))

    def over(s: Column, h: Column) -> Column:
        first = F.when((h["ol"] == 0) & F.lit(strict), h["os"] + 1).otherwise(h["os"])
        inside = (line >= first) & (line < first + h["ol"])
        at = line - first
        return (
            F.when(s["done"], s)
            .when(line < first, F.struct(s["shift"], (line + s["shift"]).cast("int").alias("to"), F.lit(True).alias("done")))
            .when(inside, F.struct(s["shift"], F.when(at < h["nl"], h["ns"] + at).cast("int").alias("to"), F.lit(True).alias("done")))
            .otherwise(F.struct((s["shift"] + h["nl"] - h["ol"]).alias("shift"), s["to"], s["done"]))
        )

    ordered = F.array_sort(F.transform(hunks, lambda h: F.struct(h["os"].alias("os"), h["ol"].alias("ol"), h["ns"].alias("ns"), h["nl"].alias("nl"))))
    found = F.aggregate(ordered, zero, over, lambda s: F.when(s["done"], s["to"]).otherwise((line + s["shift"]).cast("int")))
    return F.when(F.size(hunks) > 0, found)

def translated(violations: DataFrame, diffs: DataFrame, strict: bool = False) -> DataFrame:
    hunks = diffs.groupBy("file").agg(F.flatten(F.collect_list("hunks")).alias("_hunks"))
    return violations.join(hunks, "file", "left").withColumn("line", translate_line(F.col("line"), F.col("_hunks"), strict)).drop("_hunks")

KEY = ["file", "rule_id", "line"]

def semantic_difference(new: DataFrame, old: DataFrame, diffs: DataFrame, strict: bool = False) -> DataFrame:
    """New violations that the old version, moved to new lines, does not have."""
    return new.join(translated(old, diffs, strict).select(*KEY), KEY, "left_anti")

def baseline_exact(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    return violations.join(baseline.select(*KEY), KEY, "left_anti")

def baseline_mapped(violations: DataFrame, baseline: DataFrame, diffs: DataFrame, strict: bool = False) -> DataFrame:
    return baseline_exact(violations, translated(baseline, diffs, strict))

def ordered(violations: DataFrame) -> DataFrame:
    tail = ["emit_ord"] if "emit_ord" in violations.columns else []
    return violations.orderBy("file", "line", "rule_id", *tail)

def console_order(violations: DataFrame) -> DataFrame:
    return violations.orderBy(sev_rank(F.col("severity")).desc(), "file", "line")

def places(rows: DataFrame) -> DataFrame:
    """Sorted `rows` with place: 1, 2, 3 and so on in their order. Each range of the order counts its own
    rows; the counts of the ranges before it are added up."""
    held = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    held = held.persist()  # ranges may fall otherwise when sorted again
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = held.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return held.join(F.broadcast(sizes), "_part").select(*rows.columns, (F.col("_before") + F.col("_at") + 1).alias("place"))

def count_by_severity(violations: DataFrame) -> DataFrame:
    """One row: critical, major, minor, info and total."""
    return violations.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in reversed(SEVERITIES)], F.count("*").alias("total"))

def count_by_rule(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule_id").agg(F.count("*").alias("n"))

def first_per_rule(violations: DataFrame) -> DataFrame:
    """(rule_id, level) of each rule's first violation in report order."""
    place = F.struct("file", "line", "message")
    return violations.groupBy("rule_id").agg(F.min_by(sarif_level(F.col("severity")), place).alias("level"))

DEFAULT_GATE = {"max_critical": 0, "max_major": 0, "max_minor": None, "max_info": None}

def gate(counts: DataFrame, limits: dict[str, int | None] | None = None) -> DataFrame:
    """failures (texts, worst severity first), passed and exit_code from counts by severity."""
    limits = DEFAULT_GATE | (limits or {})
    tests = [
        F.when(F.col(s) > F.lit(limits[f"max_{s}"]), F.concat(F.lit(f"{s}: "), F.col(s).cast("string"), F.lit(f" > {limits[f'max_{s}']}"))) for s in reversed(SEVERITIES) if limits[f"max_{s}"] is not None
    ]
    failures = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return counts.select("*", failures.alias("failures")).withColumns({"passed": F.size("failures") == 0, "exit_code": F.when(F.size("failures") == 0, 0).otherwise(1)})

def scan_stats(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("files_scanned"), F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"))

