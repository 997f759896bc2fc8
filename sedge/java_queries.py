"""Parsing and rules over Java text: one small file is written from every row of `part`, and what each
rule finds in it follows from the part's key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .operators import patterns, rules
from .operators.shipped import SHIPPED
from .operators.violations import select_rules
from .sources import files
from .sources.batches import by_slices
from .sources.scratch import scratch_folder

def key() -> Column:
    return F.col("p_partkey")


def every(n: int, text: str, other: str = "", rest: int = 0) -> Column:
    return F.when(key() % n == rest, text).otherwise(other)


def java_text() -> Column:
    parts = [
        F.concat(F.lit("package shop.p"), (key() % 3).cast("string"), F.lit(";")),
        every(2, "import java.util.*;", "import java.util.List;"),
        every(5, "import com.alibaba.fastjson.JSON;"),
        every(7, "import org.apache.commons.lang.StringUtils;", "import org.apache.commons.lang3.StringUtils;"),
        every(11, "import com.google.gson.Gson;"),
        F.concat(F.lit("@RestController public class "), every(13, "part", "Part"), F.lit(" {")),
        F.concat(F.lit("  static final int "), every(8, "most", "MOST"), F.lit(" = 1;")),
        F.concat(F.lit("  @GetMapping Object get("), every(3, "Map<String, Object> m", "String m"), F.lit(") { "), every(11, "Object z = new Gson(); "), F.lit("return m; }")),
        F.concat(F.lit("  void "), every(17, "Run", "run"), F.lit("() { "), every(2, 'System.out.println("x");', 'log.info("x");', 1), F.lit(" }")),
        F.concat(F.lit("  void tried() { try { run(); } catch (Exception e) { "), every(4, "", "log(e);"), F.lit(" } }")),
        F.concat(F.lit("  void loop() { while (true) { "), every(6, "run();", "break;"), F.lit(" } }")),
        F.concat(F.lit("  void read(Object o) { "), every(5, "Object j = JSON.parse(o);"), F.lit(" }")),
        F.lit("  void longest() {"),
        F.array_join(F.array_repeat(F.lit("    run();"), F.when(key() % 19 == 0, 60).otherwise(2)), "\n"),
        F.lit("  }"),
        F.lit("}"),
    ]
    return F.concat_ws("\n", *parts)


def java_sources(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select("p_partkey", F.concat(F.lit("P"), key().cast("string"), F.lit(".java")).alias("file"), java_text().alias("text"))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return files.parse_files(java_sources(spark, d).select("file", "text"), partitions=spark.sparkContext.defaultParallelism)


def java_parse(spark: SparkSession, d: str) -> DataFrame:
    methods = F.size(F.filter("nodes", lambda n: n["kind"] == "MethodDeclaration"))
    return parsed(spark, d).select("file", "package", F.col("parse_error").isNull().alias("parsed"), "n_lines", F.size("imports").alias("n_imports"), methods.alias("n_methods"))


def places(rows: DataFrame) -> DataFrame:
    return rows.select("rule_id", "severity", "file", "line")


def pattern_rule(rule_id: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = parsed(spark, d)
        return places(patterns.match_patterns(files.nodes_of(p), files.imports_of(p), [r for r in SHIPPED if r.id == rule_id]))

    return run


def function_rule(rule_id: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = parsed(spark, d)
        return places(rules.run_rules(files.nodes_of(p), files.imports_of(p), [rule_id]))

    return run


def java_scan(spark: SparkSession, d: str) -> DataFrame:
    """All shipped rules in one scan, with messages."""
    from .plans.scan import run_texts

    found = run_texts(java_sources(spark, d), SHIPPED, list(rules.REGISTRY), partitions=spark.sparkContext.defaultParallelism)
    return found.groupBy("rule_id").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@F.arrow_udf(BinaryType())
def encoded(text: pa.Array, charset: pa.Array) -> pa.Array:
    """Bytes of texts; what a charset does not have is left as GB18030, which has everything."""
    def one(t: str, c: str) -> bytes:
        try:
            return t.encode(c)
        except UnicodeEncodeError:
            return t.encode("gb18030")

    return by_slices(one, pa.binary(), text, charset)


def decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts as UTF-8 and with a byte order mark, decoded without being told which; as GBK, Shift-JIS and
    Windows-1252 by name, or as GBK where these lack a letter."""
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    charset = F.element_at(F.array(*map(F.lit, ("utf-8", "utf-8-sig", "gb18030", "cp932", "cp1252"))), (F.col("doc_id") % 5 + 1).cast("int"))
    known = docs.select("doc_id", "text", charset.alias("charset")).withColumn("raw", encoded("text", "charset"))
    told = F.when(F.startswith("charset", F.lit("utf")), "auto").when(F.col("raw") == encoded("text", F.lit("gb18030")), "gbk").when(F.col("charset") == "cp932", "shift-jis").otherwise("latin1")
    return known.select("doc_id", F.md5(files.decode_udf("raw", told).cast("binary")).alias("digest"))


def listed(spark: SparkSession, d: str) -> DataFrame:
    """Paths below no excluded folder."""
    pages = spark.read.parquet(f"{d}/pages.parquet").filter("url is not null")
    return files.kept_paths(pages.select("page_id", F.col("url").alias("file"), F.col("url").alias("path")), "top", ("en", "fr"), ()).select("page_id")


def included(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").filter("url is not null")
    return files.kept_paths(pages.select("page_id", F.col("url").alias("file"), F.col("url").alias("path")), "top", (), ("news", "blog")).select("page_id")


def cached(spark: SparkSession, d: str) -> DataFrame:
    """Files whose text occurs several times are parsed once, and found in the cache the second time."""
    folder = scratch_folder(spark, "cache")
    found = java_sources(spark, d).select("file", F.encode(F.regexp_replace("text", "p[0-2];", "p;"), "utf-8").alias("content"))
    files.parse_cached(found, folder)
    again = files.parse_cached(found, folder)
    return again.groupBy("package").agg(F.count("*").alias("n"))


def selected(spark: SparkSession, d: str) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, ("info", "minor", "major", "critical"))), (F.col("p_size") % 4 + 1).cast("int"))
    table = spark.read.parquet(f"{d}/part.parquet").select(key().cast("string").alias("id"), severity.alias("severity"), (key() % 5 != 0).alias("enabled"))
    return select_rules(table, disabled=("1", "2", "3"), min_severity="major").select("id", "severity")


FILE = "'P' || p_partkey || '.java'"


def hits(rule: str, severity: str, line: int, where: str) -> str:
    return f"SELECT '{rule}' AS rule_id, '{severity}' AS severity, {FILE} AS file, CAST({line} AS INTEGER) AS line FROM part WHERE {where}"


#: (severity, line, the parts with a hit) of each rule.
HITS = {
    "J001": ("minor", 9, "p_partkey % 2 = 1"),
    "J003": ("minor", 2, "p_partkey % 2 = 0"),
    "J004": ("minor", 6, "p_partkey % 13 = 0"),
    "J005": ("minor", 9, "p_partkey % 17 = 0"),
    "J006": ("minor", 13, "p_partkey % 19 = 0"),
    "J007": ("minor", 7, "p_partkey % 8 = 0"),
    "J008": ("major", 10, "p_partkey % 4 = 0"),
    "J009": ("major", 11, "p_partkey % 6 = 0"),
    "J010": ("major", 3, "p_partkey % 5 = 0"),
    "J011": ("minor", 4, "p_partkey % 7 = 0"),
    "J012": ("major", 12, "p_partkey % 5 = 0"),
    "J013": ("major", 8, "p_partkey % 3 = 0"),
    "J014": ("major", 5, "p_partkey % 11 = 0"),
    "J015": ("major", 8, "p_partkey % 11 = 0"),
}

QUERIES = {
    **{f"java_{r.id}": pattern_rule(r.id) for r in SHIPPED},
    **{f"java_{r}": function_rule(r) for r in rules.REGISTRY},
    "java_parse": java_parse,
    "java_scan": java_scan,
    "java_decode": decoded,
    "file_exclude_dirs": listed,
    "file_include_parts": included,
    "cache_dedup": cached,
    "min_severity_rules": selected,
}
ORACLES = {
    **{f"java_{r}": hits(r, *v) for r, v in HITS.items()},
    "java_parse": f"SELECT {FILE} AS file, 'shop.p' || (p_partkey % 3) AS package, true AS parsed, CAST(CASE WHEN p_partkey % 19 = 0 THEN 75 ELSE 17 END AS INTEGER) AS n_lines, CAST(2 + (p_partkey % 5 = 0)::INT + (p_partkey % 11 = 0)::INT AS INTEGER) AS n_imports, CAST(6 AS INTEGER) AS n_methods FROM part",
    "java_scan": "SELECT rule_id, count(*) AS n, min(line) AS first_line FROM (" + " UNION ALL ".join(hits(r, *v) for r, v in HITS.items()) + ") GROUP BY rule_id",
    "java_decode": "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
    "file_exclude_dirs": "SELECT page_id FROM pages WHERE url IS NOT NULL AND NOT list_has_any(string_split(url, '/')[1:-2], ['en', 'fr'])",
    "file_include_parts": "SELECT page_id FROM pages WHERE contains(url, 'news') OR contains(url, 'blog')",
    "cache_dedup": "SELECT 'shop.p' AS package, count(*) AS n FROM part",
    "min_severity_rules": "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_size % 4 WHEN 2 THEN 'major' ELSE 'critical' END AS severity FROM part WHERE p_size % 4 >= 2 AND p_partkey % 5 <> 0 AND p_partkey NOT IN (1, 2, 3)",
}
