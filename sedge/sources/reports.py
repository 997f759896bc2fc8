"""Sinks: console, JSON, SARIF and CSV reports, and baselines.

A report is a head, items and a tail. Items are rendered by Spark, a row of text each, in the order of
the report. To a file or folder they go from the tasks that hold them (see `documents`); to a terminal
they stream one partition at a time. Only counts come to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_escape, location, rfc3339, sarif_level
from ..operators import violations as V
from .documents import write_document

NAME, VERSION = "sedge", "0.1.0"
COLORS = {"critical": "\033[31m", "major": "\033[31m", "minor": "\033[33m", "info": "\033[36m", "gray": "\033[90m", "green": "\033[32m", "bold": "\033[1m", "reset": "\033[0m"}


def stats_of(violations: DataFrame, files: int, errors: int) -> dict:
    counts = V.count_by_severity(violations).first().asDict()
    total = counts.pop("total")
    by_rule = {r["rule_id"]: r["n"] for r in V.count_by_rule(violations).collect()}  # as many as there are rules
    return {"files_scanned": files, "parse_errors": errors, "total_violations": total, "by_severity": counts, "by_rule": dict(sorted(by_rule.items()))}


@dataclass
class Report:
    """`items` has one text column, sorted; the document is head, items with separators between them, tail."""

    items: DataFrame
    head: str = ""
    separator: str = "\n"
    tail: str = ""

    def stream(self, out: TextIO) -> None:
        out.write(self.head)
        for i, row in enumerate(self.items.toLocalIterator()):
            out.write((self.separator if i else "") + row[0])
        out.write(self.tail)

    def save(self, path: str, single: bool = True) -> None:
        write_document(self.items, path, self.head, self.separator, self.tail, single)


def painter(color: bool):
    return (lambda name, s: f"{COLORS[name]}{s}{COLORS['reset']}") if color else (lambda name, s: s)


def console(violations: DataFrame, stats: dict, color: bool = True) -> Report:
    paint = painter(color)
    rule = paint("gray", "═" * 60)
    head = f"{rule}\n{paint('bold', f' {NAME} report')}\n{rule}\n\n{paint('bold', 'Files')} checked: {stats['files_scanned']}\n\n"
    tail = ""
    if not stats["total_violations"]:
        head += paint("green", "✓ No violations found") + "\n\n"
    else:
        head += paint("bold", "── Violations ──") + "\n" + paint("gray", "─" * 60) + "\n"
        tail = "\n\n"
    parts = [paint(s, f"{n} {s}(s)") for s, n in stats["by_severity"].items() if n]
    if stats["parse_errors"]:
        parts.append(paint("major", f"{stats['parse_errors']} parse error(s)"))
    tail += paint("gray", "─" * 60) + f"\n{paint('bold', 'Summary')}: " + (" ".join(parts) if parts else paint("green", "All checks passed")) + "\n"
    return Report(console_items(violations, color), head, "\n", tail)


def console_items(violations: DataFrame, color: bool = True) -> DataFrame:
    def painted(name: str | Column, text: Column) -> Column:
        if not color:
            return text
        start = F.lit(COLORS[name]) if isinstance(name, str) else F.create_map(*[F.lit(x) for k in ("critical", "major", "minor", "info") for x in (k, COLORS[k])])[name]
        return F.concat(start, text, F.lit(COLORS["reset"]))

    tag = painted(F.col("severity"), F.concat(F.lit("["), F.upper("severity"), F.lit("]")))
    place = painted("bold", F.concat("file", location(F.col("line"), F.col("end_line"))))
    mark = painted("gray", F.concat(F.lit("(rule: "), "rule_id", F.lit(")")))
    return V.console_order(violations).select(F.concat(F.lit("  "), tag, F.lit(" "), place, F.lit(" "), mark, F.lit("\n        "), "message").alias("value"))


def json_items(violations: DataFrame) -> DataFrame:
    return V.ordered(violations).select(F.to_json(F.struct("rule_id", "severity", "file", "line", "end_line", "message")).alias("value"))


def as_json(violations: DataFrame, stats: dict) -> Report:
    now = violations.sparkSession.range(1).select(rfc3339(F.current_timestamp())).first()[0]
    info = {"timestamp": now, "files_scanned": stats["files_scanned"], "parse_errors": stats["parse_errors"], "duration_ms": stats.get("duration_ms")}
    shown = {k: v for k, v in stats.items() if k != "duration_ms"}
    head = f'{{"version": "1.0", "scan_info": {json.dumps(info)}, "violations": [\n'
    return Report(json_items(violations), head, ",\n", f'\n], "stats": {json.dumps(shown, ensure_ascii=False)}}}\n')


def sarif_items(violations: DataFrame) -> DataFrame:
    text = lambda c: F.struct(F.col(c).alias("text"))
    region = F.struct(F.col("line").alias("startLine"), F.coalesce("end_line", "line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), text("message").alias("message"), F.array(place).alias("locations"))
    return V.ordered(violations).select(F.to_json(result).alias("value"))


def as_sarif(violations: DataFrame, stats: dict) -> Report:
    # as many rows as there are rules
    rules = [{"id": r["rule_id"], "name": r["rule_id"], "shortDescription": {"text": r["rule_id"]}, "defaultConfiguration": {"level": r["level"]}} for r in sorted(V.first_per_rule(violations).collect())]
    driver = {"name": NAME, "version": VERSION, "rules": rules}
    head = f'{{"version": "2.1.0", "$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/Schemata/sarif-schema-2.1.0.json", "runs": [{{"tool": {{"driver": {json.dumps(driver)}}}, "results": [\n'
    return Report(sarif_items(violations), head, ",\n", "\n]}]}\n")


def csv_items(violations: DataFrame) -> DataFrame:
    end = F.coalesce(F.col("end_line").cast("string"), F.lit(""))
    return V.ordered(violations).select(F.concat_ws(",", "rule_id", "severity", "file", F.col("line").cast("string"), end, csv_escape(F.col("message"))).alias("value"))


def as_csv(violations: DataFrame, stats: dict) -> Report:
    return Report(csv_items(violations), "rule_id,severity,file,line,end_line,message\n", "\n", "\n" if stats["total_violations"] else "")


def baseline_items(violations: DataFrame) -> DataFrame:
    return V.ordered(violations).select(F.to_json(F.struct("file", "line", "rule_id")).alias("value"))


def write_baseline(violations: DataFrame, path: str, single: bool = True) -> None:
    Report(baseline_items(violations), "[\n", ",\n", "\n]\n").save(path, single)


FORMATS = {"console": console, "json": as_json, "sarif": as_sarif, "csv": as_csv}


def report(format_: str, violations: DataFrame, stats: dict) -> Report:
    if format_ not in FORMATS:
        raise ValueError(f"unknown format {format_!r}; one of {', '.join(FORMATS)}")
    return FORMATS[format_](violations, stats)
