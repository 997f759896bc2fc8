"""Queries over what goes into and out of a scan: reports and baselines as documents, diffs, rule catalogs,
rule scripts, trees and counts of failures; each over the driver's tables or text written from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .java_cases import DEEP, FILE, key, nested_text, parsed
from .java_queries import encoded
from .operators import scripts, violations
from .operators.catalog import overridden, problems
from .sources import diffs, listing, reports, trees
from .sources.scratch import scratch_folder


def found(spark: SparkSession, d: str) -> DataFrame:
    """Violations made of the line items; every second has an end line."""
    line, flag = F.col("l_linenumber").cast("int"), F.col("l_returnflag")
    severity = F.when(flag == "R", "critical").when(flag == "A", "major").otherwise("minor")
    message = F.concat(F.lit('part "'), F.col("l_partkey").cast("string"), F.lit('", '), "l_linestatus", F.lit("\\"))
    return spark.read.parquet(f"{d}/lineitem.parquet").select(flag.alias("rule_id"), severity.alias("severity"), F.concat(F.lit("src/"), F.col("l_orderkey").cast("string")).alias("file"), line.alias("line"), F.when(F.col("l_suppkey") % 2 == 0, line + 2).alias("end_line"), message.alias("message"))


def items_of(spark: SparkSession, made: reports.Report, name: str) -> DataFrame:
    """The items of a report that was written as a document of parts, read from the parts that hold items."""
    folder = scratch_folder(spark, name)
    made.save(folder, single=False)
    return spark.read.text(f"{folder}/*-items").select(F.rtrim("value", F.lit(",")).alias("value"))


def json_report(spark: SparkSession, d: str) -> DataFrame:
    rows = found(spark, d)
    stats = {"files_scanned": 0, "parse_errors": 0}
    schema = "rule_id string, severity string, file string, line int, end_line int, message string"
    return items_of(spark, reports.as_json(rows, stats), "json").select(F.from_json("value", schema).alias("v")).select("v.*")


def sarif_report(spark: SparkSession, d: str) -> DataFrame:
    place = "locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int>>>>"
    rows = items_of(spark, reports.as_sarif(found(spark, d), {}), "sarif").select(F.from_json("value", f"ruleId string, level string, message struct<text: string>, {place}").alias("v"))
    at = F.col("v.locations")[0]["physicalLocation"]
    return rows.select(F.col("v.ruleId").alias("rule"), "v.level", F.col("v.message.text").alias("text"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("first_line"), at["region"]["endLine"].alias("last_line"))


def baseline_export(spark: SparkSession, d: str) -> DataFrame:
    """A baseline written and read again, with the order in which it lists its entries."""
    folder = scratch_folder(spark, "baseline")
    reports.write_baseline(found(spark, d), folder)
    return diffs.read_baseline(spark, folder).select("file", "line", "rule_id")


def csv_report(spark: SparkSession, d: str) -> DataFrame:
    return items_of(spark, reports.as_csv(found(spark, d), {"total_violations": 1}), "csv")


def console_report(spark: SparkSession, d: str) -> DataFrame:
    """Each violation on the console is two lines: where, and what."""
    return reports.console_items(found(spark, d), color=False).select(F.split("value", "\n").alias("lines")).select(F.col("lines")[0].alias("place"), F.col("lines")[1].alias("message"))


#: Folders that files are written to, and those that a scan leaves out.
FOLDERS = ("src/a", "src/target/x", "src/b", ".git", "target", "src/targets")
LEFT_OUT = ("target", ".git")


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each row (file, content) below `folder`, in tasks; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = listing.opened(folder)
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                system.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("file")], names=["file"])

    return rows.select("file", "content").mapInArrow(run, "file string").count()


def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """A file for every part, in UTF-8 or GBK, some in folders that are left out; what a scan lists and decodes."""
    name = F.concat(F.element_at(F.array(*map(F.lit, FOLDERS)), (key() % len(FOLDERS) + 1).cast("int")), F.lit("/P"), key().cast("string"), F.when(key() % 11 == 0, ".txt").otherwise(".java"))
    rows = spark.read.parquet(f"{d}/part.parquet").select(name.alias("file"), encoded(F.concat(F.lit("class P { /* 注释 "), "p_name", F.lit(" */ }")), F.when(key() % 2 == 0, "utf-8").otherwise("gb18030")).alias("content"))
    folder = scratch_folder(spark, "files")
    write_files(rows, folder)
    return listing.source_files(spark, folder, LEFT_OUT, ("/src/",), encoding="auto").select("file", F.md5("text").alias("digest"))


def diff_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a diff: a head for each order, a hunk for each of its line items, added lines that look like
    heads. Blocks end anywhere, also between a head and its hunks."""
    o = F.col("o_orderkey")
    text = lambda at, value: F.struct((o * 200 + at).alias("at"), value.alias("value"))
    name = F.concat(F.lit("f"), o.cast("string"), F.lit(".java"))
    new, gone = o % 5 == 0, o % 5 == 1
    heads = F.array(
        text(F.lit(0), F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name)),
        text(F.lit(1), F.when(new, "new file mode 100644").when(gone, "deleted file mode 100644").otherwise("old mode 100644")),
        text(F.lit(2), F.when(new, "--- /dev/null").otherwise(F.concat(F.lit("--- a/"), name))),
        text(F.lit(3), F.when(gone, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), name))),
    )
    head = spark.read.parquet(f"{d}/orders.parquet").select(F.inline(heads))
    i, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    hunk = F.concat(F.lit("@@ -"), (i * 10).cast("string"), F.when(q % 3 == 1, "").otherwise(F.concat(F.lit(","), (q % 3).cast("string"))), F.lit(" +"), (i * 11).cast("string"), F.lit(","), (q % 4).cast("string"), F.lit(" @@ void m()"))
    at = lambda k, value: F.struct((F.col("l_orderkey") * 200 + i * 10 + k).alias("at"), value.alias("value"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    hunks = lines.select(F.inline(F.array(at(0, hunk), at(1, F.lit("+++ b/added line")), at(2, F.lit("--- a/removed line")))))
    return head.unionByName(hunks).select((F.col("at") / 1_003).cast("long").alias("block"), "at", "value")


def diff_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = diffs.diff_files(diff_text(spark, d))
    joined = lambda c, *names: F.array_join(F.transform(c, lambda h: F.concat_ws(",", *[h[n].cast("string") for n in names])), ";")
    return rows.select("file", "kind", "is_new", joined("ranges", "start", "end").alias("ranges"), joined("hunks", "os", "ol", "ns", "nl").alias("hunks"))


def diff_rebase(spark: SparkSession, d: str) -> DataFrame:
    """Names below one folder, counted from there."""
    names = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_orderkey", F.concat("l_linestatus", F.lit("/"), F.col("l_orderkey").cast("string")).alias("file"))
    return diffs.rebased(names, "/F/").select("l_partkey", "l_orderkey", "file")


def rule_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rules made of the parts: a kind of pattern, the keys it matches, a severity."""
    kinds = F.element_at(F.array(*map(F.lit, ("Import", "MethodCall", "Loop", "FieldDeclaration"))), (key() % 4 + 1).cast("int"))
    keys = F.when(key() % 3 == 0, F.array(F.lit("name"))).when(key() % 3 == 1, F.array(F.lit("package"), F.lit("colour"))).otherwise(F.array().cast("array<string>"))
    severity = F.element_at(F.array(*map(F.lit, ("minor", " MAJOR ", "warning"))), (key() % 5 % 3 + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select(key().cast("string").alias("id"), F.col("p_name").alias("title"), kinds.alias("pattern"), keys.alias("keys"), severity.alias("severity"), (key() % 2 == 0).alias("enabled"))


def rule_problems(spark: SparkSession, d: str) -> DataFrame:
    return rule_rows(spark, d).select("id", F.array_join(problems(F.col("pattern"), F.col("keys"), F.col("severity")), "; ").alias("problems"))


def rule_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Rules with the entries of a catalog laid over them, one for every third part."""
    rules = rule_rows(spark, d).select("id", "title", "severity", "enabled", (key_of("id") % 7 == 0).alias("builtin"))
    entries = spark.read.parquet(f"{d}/part.parquet").filter(key() % 3 == 0).select(key().cast("string").alias("id"), F.col("p_brand").alias("title"), F.when(key() % 2 == 0, "critical").otherwise("odd").alias("severity"), (key() % 4 != 0).alias("enabled"))
    return overridden(rules, entries)


def key_of(c: str):
    return F.col(c).cast("long")


def broken_text():
    """One class; every seventh file ends too early."""
    return F.concat(F.lit("class C { void m() { "), F.repeat(F.lit("run(); "), (key() % 5).cast("int")), F.when(key() % 7 == 0, "").otherwise("} }"))


def parse_error_counts(spark: SparkSession, d: str) -> DataFrame:
    return violations.scan_stats(parsed(spark, d, broken_text()))


#: Reports methods of many statements; the first without a place. It never ends on a class that has four of them.
COUNTING = """#! rule: S1
#! severity: major
#! params: most=2

def check(ast, config):
    out = []
    for m in ast["types"][0]["members"]:
        n = len(m["body"]["statements"])
        while n == 4:
            pass
        if n > config["most"]:
            out.append({"line": m["line"], "message": f"{n} statements"})
        elif n:
            out.append({})
    return out
"""


def scripted(spark: SparkSession, d: str) -> DataFrame:
    from .sources.config import read_script

    return scripts.run_scripts(parsed(spark, d, broken_text()), [read_script(COUNTING)], scripts.Limits(steps=10_000))


def script_rule(spark: SparkSession, d: str) -> DataFrame:
    return scripts.violations_of(scripted(spark, d)).select("file", "rule_id", "severity", "line", "message")


def script_errors(spark: SparkSession, d: str) -> DataFrame:
    return scripts.errors_of(scripted(spark, d))


def ast_trees(spark: SparkSession, d: str) -> DataFrame:
    """Trees of nested classes as VARIANT: values at paths, and the number of nodes."""
    rows = trees.trees(parsed(spark, d, nested_text())).withColumn("v", F.parse_json("tree"))
    first = "$.types[0].members[0]"
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    return rows.select(
        "file",
        F.regexp_count("tree", F.lit('"kind": ')).alias("n_kinds"),
        get(f"{first}.parameters[0].param_type").alias("parameter"),
        get(f"{first}.body.statements[0].expr.arguments[0].arguments[0].name").alias("inner"),
        get("$.types[0].members[1].members[1].name").alias("third"),
        get("$.types[0].members[1].members[1].members[1].members[0].line", "int").alias("fourth_line"),
    )


SEVERITY = "CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'major' ELSE 'minor' END"
MESSAGE = "'part \"' || l_partkey || '\", ' || l_linestatus || '\\'"
LINE = "CAST(l_linenumber AS INTEGER)"
END = f"CASE WHEN l_suppkey % 2 = 0 THEN {LINE} + 2 END"
PATH = "'src/' || l_orderkey"
NUMBER = "CAST(l_quantity AS INTEGER)"

QUERIES = {
    "json_report": json_report,
    "sarif_report": sarif_report,
    "csv_report": csv_report,
    "console_report": console_report,
    "baseline_export": baseline_export,
    "file_listing": file_listing,
    "diff_rows": diff_rows,
    "diff_rebase": diff_rebase,
    "rule_problems": rule_problems,
    "rule_overrides": rule_overrides,
    "parse_error_counts": parse_error_counts,
    "script_rule": script_rule,
    "script_errors": script_errors,
    "ast_trees": ast_trees,
}
ORACLES = {
    "json_report": f"SELECT l_returnflag AS rule_id, {SEVERITY} AS severity, {PATH} AS file, {LINE} AS line, {END} AS end_line, {MESSAGE} AS message FROM lineitem",
    "sarif_report": f"SELECT l_returnflag AS rule, CASE l_returnflag WHEN 'N' THEN 'warning' ELSE 'error' END AS level, {MESSAGE} AS text, {PATH} AS uri, {LINE} AS first_line, coalesce({END}, {LINE}) AS last_line FROM lineitem",
    "csv_report": f"SELECT concat_ws(',', l_returnflag, {SEVERITY}, {PATH}, l_linenumber, coalesce(CAST({END} AS VARCHAR), ''), '\"' || replace({MESSAGE}, '\"', '\"\"') || '\"') AS value FROM lineitem",
    "console_report": f"SELECT '  [' || upper({SEVERITY}) || '] ' || {PATH} || ':' || l_linenumber || coalesce('-' || {END}, '') || ' (rule: ' || l_returnflag || ')' AS place, '        ' || {MESSAGE} AS message FROM lineitem",
    "file_listing": f"SELECT folder || '/P' || p_partkey || '.java' AS file, md5('class P {{ /* 注释 ' || p_name || ' */ }}') AS digest FROM (SELECT *, {list(FOLDERS)}[p_partkey % {len(FOLDERS)} + 1] AS folder FROM part) WHERE p_partkey % 11 > 0 AND folder IN ('src/a', 'src/b', 'src/targets')",
    "baseline_export": f"SELECT {PATH} AS file, {LINE} AS line, l_returnflag AS rule_id FROM lineitem",
    "diff_rows": f"""
WITH hunks AS (
    SELECT l_orderkey, l_linenumber, l_linenumber * 10 AS os, {NUMBER} % 3 AS ol, l_linenumber * 11 AS ns, {NUMBER} % 4 AS nl FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)
), files AS (
    SELECT l_orderkey, coalesce(string_agg(ns || ',' || (ns + nl - 1), ';' ORDER BY l_linenumber) FILTER (nl > 0), '') AS ranges, string_agg(os || ',' || ol || ',' || ns || ',' || nl, ';' ORDER BY l_linenumber) AS hunks
    FROM hunks GROUP BY l_orderkey
)
SELECT 'f' || o_orderkey || '.java' AS file, CASE o_orderkey % 5 WHEN 0 THEN 'Added' WHEN 1 THEN 'Deleted' ELSE 'Modified' END AS kind, o_orderkey % 5 = 0 AS is_new, coalesce(ranges, '') AS ranges, coalesce(hunks, '') AS hunks
FROM orders LEFT JOIN files ON l_orderkey = o_orderkey""",
    "diff_rebase": "SELECT l_partkey, l_orderkey, CAST(l_orderkey AS VARCHAR) AS file FROM lineitem WHERE l_linestatus = 'F'",
    "rule_problems": """
SELECT CAST(p_partkey AS VARCHAR) AS id, concat_ws('; ',
    CASE WHEN p_partkey % 5 % 3 = 2 THEN 'unknown severity ''warning''' END,
    CASE WHEN p_partkey % 4 = 2 THEN 'unknown pattern type ''Loop'''
         WHEN p_partkey % 3 = 0 AND p_partkey % 4 IN (0, 1) THEN 'unknown key ''name'''
         WHEN p_partkey % 3 = 1 AND p_partkey % 4 = 0 THEN 'unknown key ''colour'''
         WHEN p_partkey % 3 = 1 THEN 'unknown key ''package''; unknown key ''colour''' END) AS problems
FROM part""",
    "rule_overrides": """
SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 > 0 THEN p_brand ELSE p_name END AS title,
       CASE WHEN p_partkey % 3 > 0 THEN [' MAJOR ', 'warning', 'minor'][(p_partkey % 5 % 3 + 2) % 3 + 1] WHEN p_partkey % 2 = 0 THEN 'critical' WHEN p_partkey % 7 = 0 THEN [' MAJOR ', 'warning', 'minor'][(p_partkey % 5 % 3 + 2) % 3 + 1] ELSE 'minor' END AS severity,
       CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 <> 0 ELSE p_partkey % 2 = 0 END AS enabled, p_partkey % 7 = 0 AS builtin
FROM part""",
    "parse_error_counts": "SELECT count(*) AS files_scanned, count(*) FILTER (p_partkey % 7 = 0) AS parse_errors FROM part",
    "script_rule": f"SELECT {FILE}, 'S1' AS rule_id, 'major' AS severity, CAST(CASE WHEN p_partkey % 5 = 3 THEN 1 ELSE 0 END AS INTEGER) AS line, CASE WHEN p_partkey % 5 = 3 THEN '3 statements' ELSE 'violation' END AS message FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 5 BETWEEN 1 AND 3",
    "script_errors": f"SELECT {FILE}, 'S1' AS rule_id, 'OverBudget: more than 10000 steps' AS error FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 5 = 4",
    "ast_trees": f"SELECT {FILE}, CAST(7 * {DEEP} AS INTEGER) AS n_kinds, 'Map<String, Object>' AS parameter, 'p' AS inner, CASE WHEN {DEEP} >= 3 THEN 'N' END AS third, CAST(CASE WHEN {DEEP} >= 4 THEN 1 END AS INTEGER) AS fourth_line FROM part",
}
