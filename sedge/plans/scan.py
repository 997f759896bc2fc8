"""A scan from files to violations, and the command line around it."""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patterns, rules, scripts, violations
from ..operators.patterns import PatternRule
from ..operators.scripts import Script
from ..operators.shipped import SHIPPED
from ..schemas import SEVERITIES, VISITED, parse_severity
from ..sources import config, diffs, files, reports


def run_all(parsed: DataFrame, pattern_rules: list[PatternRule], functions: list[str], params: dict[str, dict] | None = None, scripted: DataFrame | None = None, script_ids: tuple[str, ...] = ()) -> DataFrame:
    """Violations of all rules over parsed files, with emit_ord: in a file, rules come in their order, and
    what one rule finds in the order in which its walker visits. `scripted` is what scripts have found."""
    nodes, imports = files.nodes_of(parsed), files.imports_of(parsed)
    made = (patterns.match_patterns(nodes, imports, pattern_rules), rules.run_rules(nodes, imports, functions, params), None if scripted is None else scripts.violations_of(scripted))
    both = patterns.union([x for x in made if x is not None])
    if both is None:
        both = parsed.sparkSession.createDataFrame([], VISITED)
    order = F.array_position(F.array(*[F.lit(x) for x in [*(r.id for r in pattern_rules), *functions, *script_ids]] or [F.lit("")]), F.col("rule_id"))
    return both.withColumn("emit_ord", F.struct(order.alias("rule"), "visit")).drop("visit")


def run_texts(sources: DataFrame, pattern_rules: list[PatternRule], functions: list[str], params: dict[str, dict] | None = None, partitions: int | None = None) -> DataFrame:
    """As run_all, over (file, text): each different text is parsed and looked at once, and what is found there goes
    to all files that hold it. This is for rules to which a file's name means nothing, as to those of this library."""
    named, texts = files.by_content(sources)
    # kept while the rules read it several times, as a scan does
    parsed = files.parse_files(texts.withColumnRenamed("key", "file"), partitions=partitions).cache()
    found = run_all(parsed, pattern_rules, functions, params).withColumnRenamed("file", "key")
    columns = [F.col("file") if c == "key" else F.col(c) for c in found.columns]
    # many files in few bytes are not to be broadcast; of one text, tasks hold what was found there, while its files pass by
    return named.hint("merge").join(found, "key").select(columns)


class Scan(NamedTuple):
    """Parsed files, violations, and where scripts failed (file, rule_id, error)."""

    parsed: DataFrame
    rows: DataFrame
    errors: DataFrame


def scan(spark: SparkSession, root: str, pattern_rules: list[PatternRule], functions: list[str], *, rule_scripts: list[Script] = (), params: dict | None = None, excludes: tuple[str, ...] = files.DEFAULT_EXCLUDES, includes: tuple[str, ...] = (), encoding: str = "auto", cache: str | None = None, diff: DataFrame | None = None, by_line: bool = True) -> Scan:
    """With a diff only changed files are read and, `by_line`, changed lines kept."""
    found = files.java_files(spark, root, excludes, includes, names_in(diff) if diff is not None else None)
    parsed = (files.parse_cached(found, cache, encoding) if cache else files.parse_files(found, encoding)).cache()
    scripted = scripts.run_scripts(parsed, list(rule_scripts)).cache() if rule_scripts else None
    rows = run_all(parsed, pattern_rules, functions, params, scripted, tuple(s.id for s in rule_scripts))
    if diff is not None and by_line:
        policies = {r.id: r.span_policy for r in [*pattern_rules, *rule_scripts] if r.span_policy != "anchor"} | rules.SPAN_POLICIES
        rows = violations.filter_by_diff(rows, diff, policies)
    errors = spark.createDataFrame([], "file string, rule_id string, error string") if scripted is None else scripts.errors_of(scripted)
    return Scan(parsed, rows, errors)


def names_in(diff: DataFrame) -> list[str]:
    """The names of a diff's Java files."""
    return sorted(r["file"] for r in diff.filter(F.endswith("file", F.lit(".java"))).select("file").distinct().collect())


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog=reports.NAME)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path")
    for name in ("rules-file", "rules-dir", "config", "diff", "baseline", "baseline-out", "gate-config", "output", "cache"):
        s.add_argument(f"--{name}")
    s.add_argument("-x", "--exclude", action="append")
    s.add_argument("--include", action="append", default=[])
    s.add_argument("--encoding", default="auto")
    s.add_argument("--format", default="console", choices=list(reports.FORMATS))
    s.add_argument("--diff-file", help="a diff without context lines, instead of asking git")
    s.add_argument("--diff-root", default="", help="the folder of PATH in the names of --diff-file")
    s.add_argument("--parts", action="store_true", help="the output is a folder of parts, which tasks write; their names give the order")
    s.add_argument("--gate", action="store_true")
    s.add_argument("--min-severity")
    s.add_argument("--disable", action="append", default=[])
    s.add_argument("--enable", action="append", default=[])
    s.add_argument("--tolerance", type=int, default=5)
    s.add_argument("--semantic-diff", action="store_true")
    r = sub.add_parser("rules")
    r.add_argument("--rules-file")
    r.add_argument("--rules-dir")
    sub.add_parser("version")
    return p.parse_args(argv)


def rules_of(a: argparse.Namespace, project: config.Project) -> tuple[list[PatternRule], list[Script], list[config.Entry]]:
    """The rules of the catalog named on the command line or in the settings; else the shipped ones and
    those of a folder."""
    path = getattr(a, "rules_file", None) or project.rules.get("rules_file")
    if path:
        found, made, entries = config.loaded(config.rule_catalog(path), str(Path(path).parent))
        # the catalog's severity is laid over functions that have no fixed one
        for e in entries:
            e.params = {"severity": e.severity if e.severity in SEVERITIES else "minor"} | e.params
        return found, made, entries
    found, made = config.rule_directory(a.rules_dir) if getattr(a, "rules_dir", None) else ([], [])
    own = {r.id for r in [*found, *made]}
    return [*(r for r in SHIPPED if r.id not in own), *found], made, [config.Entry(i, script_path=f"builtin:{i}", severity=rules.SEVERITY.get(i, "major")) for i in rules.REGISTRY if i not in own]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """0: passed, 1: the gate failed, 2: an error."""
    a = arguments(argv if argv is not None else sys.argv[1:])
    out = out or sys.stdout
    if a.command == "version":
        out.write(f"{reports.NAME} {reports.VERSION}\n")
        return 0
    try:
        spark = spark or SparkSession.builder.appName(reports.NAME).getOrCreate()
        project = config.Project.read(a.config) if getattr(a, "config", None) else config.Project()
        found, made, entries = rules_of(a, project)
        table = config.rules_table(spark, found, made, entries)
        if a.command == "rules":
            for r in table.orderBy("id").collect():
                out.write(f"{r['id']}\t{r['severity']}\t{'on' if r['enabled'] else 'off'}\t{r['name'] or ''}\n")
            return 0
        return run_scan(a, spark, project, found, made, entries, table, out)
    except (ValueError, OSError) as e:
        sys.stderr.write(f"error: {e}\n")
        return 2


def run_scan(a: argparse.Namespace, spark: SparkSession, project: config.Project, found: list[PatternRule], made: list[Script], entries: list[config.Entry], table: DataFrame, out) -> int:
    began = time.monotonic()
    if a.semantic_diff and not a.diff:
        raise ValueError("--semantic-diff needs --diff")
    settings = project.rules
    least = parse_severity(a.min_severity or settings.get("min_severity", "info"))
    kept = {r["id"] for r in violations.select_rules(table, (*a.disable, *settings.get("disable", [])), tuple(a.enable or settings.get("enable", [])), least).collect()}
    found, made, functions = [r for r in found if r.id in kept], [r for r in made if r.id in kept], [e.id for e in entries if e.id in kept]
    params = {e.id: e.params for e in entries}
    root = a.path if "://" in a.path else os.path.realpath(a.path)
    excludes = tuple(a.exclude or files.DEFAULT_EXCLUDES) + tuple(project.scan.get("exclude", []))
    options = {"params": params, "excludes": excludes, "includes": tuple(a.include or project.scan.get("include", [])), "encoding": files.effective_encoding(a.encoding, project.scan.get("encoding")), "cache": a.cache}
    diff = None
    if a.diff_file:
        diff = diffs.rebased(diffs.diff_files(diffs.diff_lines(spark, a.diff_file)), a.diff_root).cache()
    elif a.diff:
        top = diffs.git(root, "rev-parse", "--show-toplevel").strip()
        diff = diffs.diff_table(spark, diffs.get_diff(root, a.diff), top, root)
    if a.semantic_diff:
        parsed, rows, errors = scan(spark, root, found, functions, rule_scripts=made, **options, diff=diff, by_line=False)
        old = files.parse_files(diffs.old_sources(root, diffs.old_ref(root, a.diff), diff.filter(F.endswith("file", F.lit(".java"))).select("file").distinct()), options["encoding"])
        before = scripts.run_scripts(old, made) if made else None
        rows = violations.semantic_difference(rows, run_all(old, found, functions, params, before, tuple(s.id for s in made)), diff)
    else:
        parsed, rows, errors = scan(spark, root, found, functions, rule_scripts=made, **options, diff=diff)
    if a.baseline:
        base = diffs.read_baseline(spark, a.baseline)
        rows = violations.baseline_mapped(rows, base, diff) if diff is not None else violations.baseline_tolerant(rows, base, a.tolerance)
    rows = rows.cache()
    if a.baseline_out:
        reports.write_baseline(rows, a.baseline_out)
    n = violations.scan_stats(parsed).first()
    if n["parse_errors"]:
        for r in parsed.filter("parse_error is not null").select("file", "parse_error").toLocalIterator():
            sys.stderr.write(f"warning: {r['file']}: {r['parse_error']}\n")
    for r in errors.toLocalIterator() if made else ():
        sys.stderr.write(f"warning: rule {r['rule_id']} failed on {r['file']}: {r['error']}\n")
    stats = reports.stats_of(rows, n["files_scanned"], n["parse_errors"])
    stats["duration_ms"] = int((time.monotonic() - began) * 1000)
    made = reports.report(a.format, rows, stats)
    if a.output:
        made.save(a.output, single=not a.parts)
    else:
        made.stream(out)
    if not a.gate and not a.gate_config:
        return 0
    limits = config.read_yaml(Path(a.gate_config).read_text(encoding="utf-8")) if a.gate_config else project.gate
    result = violations.gate(violations.count_by_severity(rows), limits).first()
    for text in result["failures"]:
        sys.stderr.write(f"gate: {text}\n")
    return result["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
