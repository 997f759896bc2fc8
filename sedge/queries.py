"""The operators over the driver's tables, each with its SQL: documents are source files,
their lines places, part names the names that patterns match, events severities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flow_queries, java_cases, java_queries
from .functions import text as T
from .operators import violations as V
from .operators.patterns import PatternRule, condition, fused, union
from .schemas import sev_rank

RULES = [
    PatternRule("R1", "Line", {"text": "*the*"}, "line {line} of {file}", "minor"),
    PatternRule("R2", "Line", {"text": "^[A-Z].*[.]$"}, "a sentence", "info"),
    PatternRule("R3", "Line", {"text": ["Copyright*", "*License*", "*token = *"]}, "a notice", "major"),
]
SEVERITY = "CASE event_type WHEN 'click' THEN 'info' WHEN 'view' THEN 'info' WHEN 'signup' THEN 'minor' WHEN 'purchase' THEN 'major' WHEN 'error' THEN 'critical' END"
LINES_SQL = "SELECT CAST(doc_id AS VARCHAR) AS file, CAST(i AS INTEGER) AS line, string_split(text, chr(10))[i] AS text FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)"
VIOLATIONS_SQL = "SELECT CAST(l_orderkey AS VARCHAR) AS file, CAST(l_linenumber AS INTEGER) AS line, l_returnflag AS rule_id, CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'major' ELSE 'minor' END AS severity, CAST(l_suppkey % 5 AS INTEGER) AS span, l_partkey FROM lineitem"
DIFFS_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS file, CAST(1 + o_orderkey % 4 AS INTEGER) AS a, CAST(2 + o_orderkey % 4 AS INTEGER) AS b FROM orders WHERE o_orderkey % 3 = 0"


def lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    return docs.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).select("file", (F.col("i") + 1).alias("line"), "text")


def found(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    flag = F.col("l_returnflag")
    severity = F.when(flag == "R", "critical").when(flag == "A", "major").otherwise("minor")
    return rows.select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").cast("int").alias("line"), flag.alias("rule_id"), severity.alias("severity"), (F.col("l_suppkey") % 5).cast("int").alias("span"), "l_partkey")


def diffs(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = spark.read.parquet(f"{d}/orders.parquet").filter(key % 3 == 0)
    a, b = (1 + key % 4).cast("int"), (2 + key % 4).cast("int")
    return orders.select(
        key.cast("string").alias("file"),
        F.array(F.struct(a.alias("start"), b.alias("end"))).alias("ranges"),
        # two hunks: one line replaced by two at line 1, line 4 removed
        F.array(F.struct(F.lit(1).alias("os"), F.lit(1).alias("ol"), F.lit(1).alias("ns"), F.lit(2).alias("nl")), F.struct(F.lit(4).alias("os"), F.lit(1).alias("ol"), F.lit(4).alias("ns"), F.lit(0).alias("nl"))).alias("hunks"),
    )


def baseline(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).filter("l_partkey % 4 = 0").select("file", (F.col("line") + 1).alias("line"), "rule_id")


def names(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")


def line_rules(spark: SparkSession, d: str, some: list[PatternRule]) -> DataFrame:
    rows = lines(spark, d)
    shown = {"file": F.col("file")}
    return fused(rows, [(r, condition(r, {"text": F.col("text")}), shown) for r in some], F.col("line")).select("rule_id", "severity", "file", "line", "message")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return V.gate(V.count_by_severity(line_rules(spark, d, RULES)), {"max_major": 5}).select("critical", "major", "minor", "info", "total", F.array_join("failures", "; ").alias("failures"), "exit_code")


def pattern(column: str, wanted):
    return lambda s, d: names(s, d).filter(T.value_match(wanted, F.col(column))).select("p_partkey", column)


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.expr(SEVERITY).alias("severity"), F.col("event_type").alias("rule_id"))


LINE_RULES_SQL = f"""
SELECT 'R1' AS rule_id, 'minor' AS severity, file, line, 'line ' || line || ' of ' || file AS message FROM ({LINES_SQL}) WHERE contains(text, 'the')
UNION ALL SELECT 'R2', 'info', file, line, 'a sentence' FROM ({LINES_SQL}) WHERE regexp_matches(text, '^[A-Z].*[.]$')
UNION ALL SELECT 'R3', 'major', file, line, 'a notice' FROM ({LINES_SQL}) WHERE starts_with(text, 'Copyright') OR contains(text, 'License') OR contains(text, 'token = ')"""
COUNTS = "count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'info') AS info, count(*) AS total"
MAPPED = "CASE WHEN d.file IS NULL THEN NULL WHEN v.line < 1 THEN v.line WHEN v.line = 1 THEN 1 WHEN v.line < 4 THEN v.line + 1 WHEN v.line = 4 THEN NULL ELSE v.line END"

# entries are line * 1000 + a number, as a line may be listed several times
TOLERANT = f"""
WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY file, rule_id ORDER BY l_partkey * 10 + line) AS i FROM ({VIOLATIONS_SQL})),
b AS (SELECT file, rule_id, list((line + 1) * 1000 + i ORDER BY line) AS free FROM v WHERE l_partkey % 4 = 0 GROUP BY file, rule_id),
s AS (
  SELECT DISTINCT v.file, v.rule_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS line, coalesce(b.free, CAST([] AS BIGINT[])) AS free, false AS kept
  FROM v LEFT JOIN b ON b.file = v.file AND b.rule_id = v.rule_id
  UNION ALL
  SELECT file, rule_id, i, line, CASE WHEN near IS NULL THEN free ELSE list_filter(free, lambda x: x <> near.x) END, near IS NULL
  FROM (SELECT v.file, v.rule_id, v.i, v.line, s.free, list_min(list_transform(list_filter(s.free, lambda x: abs(x // 1000 - v.line) <= 1), lambda x: {{'d': abs(x // 1000 - v.line), 'x': x}})) AS near
        FROM s JOIN v ON v.file = s.file AND v.rule_id = s.rule_id AND v.i = s.i + 1)
)
SELECT file, line, rule_id FROM s WHERE kept"""

QUERIES = {
    "flagship_rules_and_gate": flagship,
    "pattern_exact": pattern("p_brand", "Brand#11"),
    "pattern_glob": pattern("p_type", "*M*L*"),
    "pattern_regex": pattern("p_name", "^[a-m].+e"),
    "pattern_any_of": pattern("p_brand", ["Brand#1*", "*5", "^Brand.[23]4$"]),
    "pattern_conjunction": lambda s, d: names(s, d).filter(condition(PatternRule("x", "x", {"name": "*a*", "type": "ST*D"}, ""), {"name": F.col("p_name"), "type": F.col("p_type")})).select("p_partkey"),
    "modifier_exists": lambda s, d: names(s, d).filter(T.modifier_match(["red", "g*r"], F.split("p_name", " "))).select("p_partkey", "p_name"),
    "template_message": lambda s, d: names(s, d).select("p_partkey", T.message("{brand}: {name} {other}", {"brand": F.col("p_brand"), "name": F.col("p_name")}).alias("message")),
    "strip_generics": lambda s, d: names(s, d).select("p_partkey", T.strip_generics(F.concat("p_brand", F.lit("<x, y>"))).alias("base")),
    "rule_fused": lambda s, d: line_rules(s, d, RULES),
    "rule_union": lambda s, d: union([line_rules(s, d, [r]) for r in RULES]),
    "diff_file_semi": lambda s, d: V.changed_files(found(s, d), diffs(s, d)).select("file", "line", "rule_id"),
    "diff_anchor_filter": lambda s, d: V.filter_by_diff(found(s, d).withColumn("end_line", F.col("line") + F.col("span")), diffs(s, d)).select("file", "line", "rule_id"),
    "diff_intersect_filter": lambda s, d: V.filter_by_diff(found(s, d).withColumn("end_line", F.col("line") + F.col("span")), diffs(s, d), {"R": "intersect", "A": "intersect", "N": "intersect"}).select("file", "line", "rule_id"),
    "line_translate": lambda s, d: V.translated(found(s, d), diffs(s, d)).select("file", "line", "rule_id", "l_partkey"),
    "semantic_difference": lambda s, d: V.semantic_difference(found(s, d), found(s, d).filter("l_partkey % 2 = 0"), diffs(s, d)).select("file", "line", "rule_id", "l_partkey"),
    "baseline_exact": lambda s, d: V.baseline_exact(found(s, d), baseline(s, d)).select("file", "line", "rule_id", "l_partkey"),
    "baseline_mapped": lambda s, d: V.baseline_mapped(found(s, d), baseline(s, d), diffs(s, d)).select("file", "line", "rule_id", "l_partkey"),
    "baseline_tolerant": lambda s, d: V.baseline_tolerant(found(s, d).withColumn("emit_ord", F.col("l_partkey") * 10 + F.col("line")).select("file", "line", "rule_id", "emit_ord"), baseline(s, d).withColumn("ord", F.col("line")), 1).select("file", "line", "rule_id"),
    "order_violations": lambda s, d: V.places(V.ordered(found(s, d).select("file", "line", "rule_id"))),
    "order_console": lambda s, d: V.places(V.console_order(found(s, d).select("file", "line", "rule_id", "severity"))),
    "stats_by_severity": lambda s, d: V.count_by_severity(events(s, d)),
    "stats_by_rule": lambda s, d: V.count_by_rule(events(s, d)),
    "first_per_rule": lambda s, d: V.first_per_rule(found(s, d).withColumn("message", F.col("l_partkey").cast("string"))),
    "gate_result": lambda s, d: V.gate(V.count_by_severity(events(s, d)), {"max_critical": 3, "max_major": 10_000_000}).select("critical", F.array_join("failures", "; ").alias("failures"), "exit_code"),
    "csv_escape": lambda s, d: lines(s, d).select("file", "line", T.csv_escape(F.col("text")).alias("value")),
    "sarif_level": lambda s, d: events(s, d).groupBy(T.sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n")),
    "location_text": lambda s, d: found(s, d).select("file", T.location(F.col("line"), F.col("line") + F.col("span")).alias("place"), "l_partkey"),
}

ORACLES = {
    "baseline_tolerant": TOLERANT,
    "flagship_rules_and_gate": f"SELECT *, concat_ws('; ', CASE WHEN critical > 0 THEN 'critical: ' || critical || ' > 0' END, CASE WHEN major > 5 THEN 'major: ' || major || ' > 5' END) AS failures, CASE WHEN critical > 0 OR major > 5 THEN 1 ELSE 0 END AS exit_code FROM (SELECT {COUNTS} FROM ({LINE_RULES_SQL}))",
    "pattern_exact": "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#11'",
    "pattern_glob": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%M%L%'",
    "pattern_regex": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].+e')",
    "pattern_any_of": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE '%5' OR regexp_matches(p_brand, '^Brand.[23]4$')",
    "pattern_conjunction": "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type LIKE 'ST%D'",
    "modifier_exists": "SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: x = 'red' OR x LIKE 'g%r')) > 0",
    "template_message": "SELECT p_partkey, p_brand || ': ' || p_name || ' {other}' AS message FROM part",
    "strip_generics": "SELECT p_partkey, p_brand AS base FROM part",
    "rule_fused": LINE_RULES_SQL,
    "rule_union": LINE_RULES_SQL,
    "diff_file_semi": f"SELECT file, line, rule_id FROM ({VIOLATIONS_SQL}) WHERE file IN (SELECT file FROM ({DIFFS_SQL}))",
    "diff_anchor_filter": f"SELECT v.file, line, rule_id FROM ({VIOLATIONS_SQL}) v LEFT JOIN ({DIFFS_SQL}) d ON v.file = d.file WHERE d.file IS NULL OR line BETWEEN a AND b",
    "diff_intersect_filter": f"SELECT v.file, line, rule_id FROM ({VIOLATIONS_SQL}) v LEFT JOIN ({DIFFS_SQL}) d ON v.file = d.file WHERE d.file IS NULL OR (a <= line + span AND line <= b)",
    "line_translate": f"SELECT v.file, CAST({MAPPED} AS INTEGER) AS line, rule_id, l_partkey FROM ({VIOLATIONS_SQL}) v LEFT JOIN ({DIFFS_SQL}) d ON v.file = d.file",
    "semantic_difference": f"SELECT n.file, n.line, n.rule_id, n.l_partkey FROM ({VIOLATIONS_SQL}) n WHERE NOT EXISTS (SELECT 1 FROM (SELECT v.file, v.rule_id, {MAPPED} AS line FROM ({VIOLATIONS_SQL}) v LEFT JOIN ({DIFFS_SQL}) d ON v.file = d.file WHERE v.l_partkey % 2 = 0) o WHERE o.file = n.file AND o.rule_id = n.rule_id AND o.line = n.line)",
    "baseline_exact": f"SELECT n.file, n.line, n.rule_id, n.l_partkey FROM ({VIOLATIONS_SQL}) n WHERE NOT EXISTS (SELECT 1 FROM ({VIOLATIONS_SQL}) v WHERE v.l_partkey % 4 = 0 AND v.file = n.file AND v.rule_id = n.rule_id AND v.line + 1 = n.line)",
    "baseline_mapped": f"SELECT n.file, n.line, n.rule_id, n.l_partkey FROM ({VIOLATIONS_SQL}) n WHERE NOT EXISTS (SELECT 1 FROM (SELECT v.file, v.rule_id, {MAPPED} AS line FROM (SELECT file, line + 1 AS line, rule_id FROM ({VIOLATIONS_SQL}) WHERE l_partkey % 4 = 0) v LEFT JOIN ({DIFFS_SQL}) d ON v.file = d.file) o WHERE o.file = n.file AND o.rule_id = n.rule_id AND o.line = n.line)",
    "order_violations": f"SELECT file, line, rule_id, row_number() OVER (ORDER BY file, line, rule_id) AS place FROM ({VIOLATIONS_SQL})",
    "order_console": f"SELECT file, line, rule_id, severity, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 ELSE 3 END, file, line) AS place FROM ({VIOLATIONS_SQL})",
    "stats_by_severity": f"SELECT {COUNTS} FROM (SELECT {SEVERITY} AS severity FROM events)",
    "stats_by_rule": "SELECT event_type AS rule_id, count(*) AS n FROM events GROUP BY event_type",
    "first_per_rule": f"SELECT DISTINCT rule_id, CASE severity WHEN 'minor' THEN 'warning' ELSE 'error' END AS level FROM ({VIOLATIONS_SQL})",
    "gate_result": f"SELECT critical, CASE WHEN critical > 3 THEN 'critical: ' || critical || ' > 3' ELSE '' END AS failures, CASE WHEN critical > 3 THEN 1 ELSE 0 END AS exit_code FROM (SELECT {COUNTS} FROM (SELECT {SEVERITY} AS severity FROM events))",
    "csv_escape": f"SELECT file, line, CASE WHEN contains(text, ',') OR contains(text, '\"') OR contains(text, chr(10)) THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS value FROM ({LINES_SQL})",
    "sarif_level": f"SELECT CASE WHEN severity IN ('critical', 'major') THEN 'error' WHEN severity = 'minor' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM (SELECT {SEVERITY} AS severity FROM events) GROUP BY 1",
    "location_text": f"SELECT file, ':' || line || CASE WHEN span > 0 THEN '-' || (line + span) ELSE '' END AS place, l_partkey FROM ({VIOLATIONS_SQL})",
}

QUERIES |= java_queries.QUERIES | java_cases.QUERIES | flow_queries.QUERIES
ORACLES |= java_queries.ORACLES | java_cases.ORACLES | flow_queries.ORACLES
