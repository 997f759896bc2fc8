"""Queries over Java text that is written from `part` and holds the hard cases: every edge that some walker
does not follow, all ways in which a loop may or may not end, nested types, and several hits whose
order counts. Each file holds one case, which the part's key picks; what is found is listed beside the case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import rules
from .operators.matching import baseline_tolerant
from .operators.patterns import CALL_BLOCKED, CATCH_BLOCKED, LOOP_BLOCKED, USE_BLOCKED, PatternRule, match_patterns, reachable
from .operators.structure import contained, merged, subtree_counts
from .plans.scan import run_all
from .sources import files

STATEMENTS = "mark(); try { go(); } catch (E e) { }"
#: A member, and how many calls of mark() the walkers of calls, loops and uses reach, and how many catch clauses theirs.
EDGES = [
    (f"void a() {{ {STATEMENTS} }}", 1, 1, 1, 1),
    (f"T() {{ {STATEMENTS} }}", 1, 1, 1, 1),
    ("Object f = mark();", 0, 1, 1, 0),
    (f"{{ {STATEMENTS} }}", 0, 1, 1, 0),
    (f"class N {{ void a() {{ {STATEMENTS} }} }}", 1, 1, 1, 1),
    (f"interface N {{ default void a() {{ {STATEMENTS} }} }}", 0, 1, 1, 1),
    (f"enum N {{ A; void a() {{ {STATEMENTS} }} }}", 0, 1, 1, 1),
    (f"@interface N {{ class M {{ void a() {{ {STATEMENTS} }} }} }}", 0, 1, 1, 1),
    (f"enum N {{ A {{ void a() {{ {STATEMENTS} }} }}; }}", 0, 0, 0, 0),
    (f"void a() {{ for (int k : ks) {{ {STATEMENTS} }} }}", 1, 1, 1, 0),
    (f"void a() {{ switch (q) {{ case 1: {STATEMENTS} }} }}", 1, 1, 1, 0),
    (f"void a() {{ if (q) {{ {STATEMENTS} }} else {{ {STATEMENTS} }} }}", 2, 2, 2, 2),
    (f"void a() {{ while (q) {{ {STATEMENTS} }} do {{ {STATEMENTS} }} while (q); for (;;) {{ {STATEMENTS} }} }}", 3, 3, 3, 3),
    (f"void a() {{ try {{ {STATEMENTS} }} catch (E e) {{ {STATEMENTS} }} finally {{ {STATEMENTS} }} }}", 3, 3, 3, 4),
    (f"void a() {{ synchronized (mark()) {{ {STATEMENTS} }} }}", 2, 2, 2, 1),
    ("void a() { for (int k : mark()) { } if (mark()) { } while (mark()) { } do { } while (mark()); switch (mark()) { case 1: go(); } }", 5, 5, 5, 0),
    ("void a() { for (mark(); mark(); mark()) { } for (int i = mark(); ; ) { break; } }", 4, 4, 4, 0),
    ("Object a() { if (q) { throw mark(); } return mark(); }", 2, 2, 2, 0),
    ("void a() { int v = mark(); go(mark(), 1 + mark(), !mark(), (T) mark(), (mark()), mark().f, new T(mark())); v = mark(); }", 9, 9, 9, 0),
    ("void a() { try (T t = mark()) { go(); } finally { } }", 0, 0, 0, 0),
    ("void a() { z[mark()] = q ? mark() : mark(); }", 3, 3, 0, 0),
    ("void a() { x = new int[] { mark(), mark(), }; y = new int[][] { { mark() } }; z = new int[mark()]; }", 0, 2, 0, 0),
    ("void a() { x = mark() instanceof T; }", 0, 1, 1, 0),
    ("void a() { x = () -> mark(); }", 0, 1, 0, 0),
    (f"void a() {{ x = () -> {{ {STATEMENTS} }}; }}", 0, 1, 0, 0),
    ("void a() { mark().go(); }", 0, 0, 0, 0),
]
#: A method's body, and how many of its loops may never end.
LOOPS = [
    ("while (true) { run(); }", 1),
    ("while (true) { break; }", 0),
    ("for (;;) { run(); }", 1),
    ("for (int i = 0; i < 10; ) { run(); }", 1),
    ("for (int i = 0; i < 10; ) { i++; }", 0),
    ("for (int i = 0; i < 10; i = i) { run(); }", 1),
    ("for (int i = 0; i < 10; i += 0) { run(); }", 1),
    ("for (int i = 0; i < 10; i *= 1) { run(); }", 1),
    ("for (int i = 0; i < 10; i--) { run(); }", 1),
    ("for (int i = 0; i < 10; i++) { run(); }", 0),
    ("for (int i = 10; i > 0; i++) { run(); }", 1),
    ("for (int i = 0; 10 > i; i = i - 1) { run(); }", 1),
    ("for (int i = 0; i < 10; i--) { return; }", 0),
    ("while (done) { run(); }", 1),
    ("while (done) { done = next(); }", 0),
    ("while (done) { flags[0] = done; }", 1),
    ("while (flags[0]) { run(); }", 0),
    ("while (this.done) { run(); }", 0),
    ("done = next(); while (done) { run(); }", 0),
    ("boolean go = true; while (go) { run(); }", 1),
    ("boolean go = true; while (go) { run(); } go = false;", 0),
    ("while (ON) { run(); }", 1),
    ("while (OFF) { run(); }", 0),
    ("while (!OFF && ON) { run(); }", 1),
    ("while (1 < 2) { run(); }", 1),
    ("do { run(); } while (true);", 1),
    ("while (true) { while (x < 3) { break; } }", 1),
    ("while (true) { for (int k : ks) { break; } }", 1),
    ("while (true) { for (int k : ks) { return; } }", 0),
    ("while (true) { go(() -> { return; }); }", 1),
    ("while (true) { while (true) { throw new E(); } }", 0),
    ("while (true) { (n)++; while (true) { run(); } }", 2),
    ("go(() -> { while (true) { run(); } });", 1),
    ("boolean go = true; run(() -> { while (go) { go(); } });", 1),
]


def key() -> Column:
    return F.col("p_partkey")


def picked(texts: list[str]) -> Column:
    """The text whose place is the key's remainder."""
    return F.element_at(F.array(*map(F.lit, texts)), (key() % len(texts) + 1).cast("int"))


def parsed(spark: SparkSession, d: str, text: Column) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    sources = part.select(F.concat(F.lit("P"), key().cast("string"), F.lit(".java")).alias("file"), text.alias("text"))
    return files.parse_files(sources, partitions=spark.sparkContext.defaultParallelism)


def reachability(spark: SparkSession, d: str) -> DataFrame:
    """What each walker reaches of one member."""
    rows = parsed(spark, d, F.concat(F.lit("class T { "), picked([m for m, *_ in EDGES]), F.lit(" }"))).select("file", "parse_error", F.inline("nodes"))
    marked, catch = (F.col("kind") == "MethodCallExpr") & (F.col("name") == "mark"), F.col("kind") == "CatchClause"
    walks = {"calls": marked & reachable(CALL_BLOCKED), "loops": marked & reachable(LOOP_BLOCKED), "uses": marked & reachable(USE_BLOCKED), "catches": catch & reachable(CATCH_BLOCKED)}
    return rows.groupBy("file").agg(*[F.count_if(c).alias(n) for n, c in walks.items()])


def endless(spark: SparkSession, d: str) -> DataFrame:
    """Loops that may never end, of all kinds, with those that do."""
    head, tail = "class T {\n  static final boolean ON = true, OFF = false;\n  boolean done; boolean[] flags;\n  void m() {\n    ", "\n  }\n}"
    p = parsed(spark, d, F.concat(F.lit(head), picked([m for m, _ in LOOPS]), F.lit(tail)))
    found = rules.run_rules(files.nodes_of(p), files.imports_of(p), ["J009"])
    return found.groupBy("file", "rule_id", "line").agg(F.count("*").alias("n"))


def nested_text() -> Column:
    """Controllers in one another, one to four deep; every second file has a plain class as the second of them."""
    deep, at = (key() % 4 + 1).cast("int"), F.lit("@RestController class N { @GetMapping Object m(Map<String, Object> p) { return go(go(p)); } ")
    plain = F.lit("class N { @GetMapping Object m(Map<String, Object> p) { return go(go(p)); } ")
    inner = F.when(key() % 8 < 4, F.repeat(at, deep - 1)).otherwise(F.concat(F.when(deep > 1, plain).otherwise(""), F.repeat(at, F.greatest(deep - 2, F.lit(0)))))
    return F.concat(at, inner, F.repeat(F.lit("} "), deep))


def nested_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many calls stand below each class, at any depth."""
    nodes = files.nodes_of(parsed(spark, d, nested_text()))
    classes = nodes.filter("kind = 'ClassDeclaration'")
    counts = subtree_counts(classes, nodes.filter("kind = 'MethodCallExpr'"))
    return counts.join(merged(classes.select("file", "nid", "depth")), ["file", "nid"]).select("file", "depth", "n_below")


def nested_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every class with every method below it."""
    nodes = files.nodes_of(parsed(spark, d, nested_text())).select("file", "nid", "end_nid", "depth", "kind")
    pairs = contained(nodes.filter("kind = 'ClassDeclaration'"), nodes.filter("kind = 'MethodDeclaration'"))
    return pairs.select("descendant.file", F.col("ancestor.depth").alias("class_depth"), F.col("descendant.depth").alias("method_depth"))


def nested_controllers(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints of controllers below nothing but controllers."""
    p = parsed(spark, d, nested_text())
    return rules.run_rules(files.nodes_of(p), files.imports_of(p), ["J013"]).groupBy("file").agg(F.count("*").alias("n"))


#: Uses on one line, in the order of the text; walkers come to the last before the middle one.
USES = "try { x = new JSON(); } catch (E e) { x = new JSONArray(); } finally { x = new JSONObject(); }"
VISITED_USES = ("JSON", "JSONObject", "JSONArray")


def emission_order(spark: SparkSession, d: str) -> DataFrame:
    """What a baseline of none to three entries leaves of three uses on one line (by name), and of two loops, of which
    the first in the text is visited last (by line): which ones it takes depends on the order of visits."""
    text = F.concat(
        F.lit("import com.alibaba.fastjson.JSON;\nimport com.alibaba.fastjson.JSONArray;\nimport com.alibaba.fastjson.JSONObject;\nclass T { void m() {\n"), F.lit(USES),
        F.lit("\nif (go(() -> {\nwhile (true) { run(); } })) {\nwhile (true) { run(); } } } }"),
    )
    p = parsed(spark, d, text)
    found = run_all(p, [], ["J012", "J009"])
    part = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("P"), key().cast("string"), F.lit(".java")).alias("file"), key())
    uses = part.select("file", F.explode(F.sequence(F.lit(0), (key() % 4).cast("int"))).alias("ord")).filter("ord > 0").select("file", F.lit(5).alias("line"), F.lit("J012").alias("rule_id"), "ord")
    loops = part.filter(key() % 3 > 0).select("file", F.lit(7).alias("line"), F.lit("J009").alias("rule_id"), F.lit(9).alias("ord"))
    left = baseline_tolerant(found, uses.unionByName(loops), 1)
    return left.select("file", "rule_id", "line", F.regexp_extract("message", "JSON[A-Za-z]*", 0).alias("name"))


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Annotations on types, fields, methods and constructors, in nested classes too, but not in other nested types."""
    text = F.concat(
        F.lit("@Deprecated class T {\n@Deprecated int f;\n@Deprecated T() { }\n"), F.when(key() % 2 == 0, F.lit("@Deprecated ")).otherwise(F.lit("@Other ")), F.lit("void m() { }\n"),
        F.lit("class N {\n@a.b.Deprecated void m(@Deprecated int p) { @Deprecated int local; }\n}\ninterface I {\n@Deprecated void m();\n}\n}"),
    )
    p = parsed(spark, d, text)
    rule = PatternRule("A1", "Annotation", {"name": ["Deprecated", "*.Deprecated"]}, "{name} at {line}")
    return match_patterns(files.nodes_of(p), files.imports_of(p), [rule]).select("file", "line", "message")


FILE = "'P' || p_partkey || '.java' AS file"


def values(rows: list[tuple], columns: str) -> str:
    return f"(VALUES {', '.join(str((i, *r)) for i, r in enumerate(rows))}) AS cases({columns})"


DEEP = "(p_partkey % 4 + 1)"

QUERIES = {
    "reachability_filter": reachability,
    "endless_loops": endless,
    "nested_subtree_count": nested_counts,
    "nested_pairs": nested_pairs,
    "nested_controllers": nested_controllers,
    "emission_order": emission_order,
    "pattern_annotation": annotated,
}
ORACLES = {
    "reachability_filter": f"SELECT {FILE}, calls, loops, uses, catches FROM part JOIN {values([r[1:] for r in EDGES], 'i, calls, loops, uses, catches')} ON i = p_partkey % {len(EDGES)}",
    "endless_loops": f"SELECT {FILE}, 'J009' AS rule_id, CAST(5 AS INTEGER) AS line, n FROM part JOIN {values([r[1:] for r in LOOPS], 'i, n')} ON i = p_partkey % {len(LOOPS)} WHERE n > 0",
    "nested_subtree_count": f"SELECT {FILE}, CAST(x AS INTEGER) AS depth, 2 * ({DEEP} - x + 1) AS n_below FROM (SELECT p_partkey, unnest(range(1, {DEEP} + 1)) AS x FROM part)",
    "nested_pairs": f"SELECT {FILE}, CAST(x AS INTEGER) AS class_depth, CAST(y + 1 AS INTEGER) AS method_depth FROM (SELECT p_partkey, x, unnest(range(x, {DEEP} + 1)) AS y FROM (SELECT p_partkey, unnest(range(1, {DEEP} + 1)) AS x FROM part))",
    "nested_controllers": f"SELECT {FILE}, CASE WHEN p_partkey % 8 < 4 THEN {DEEP} ELSE 1 END AS n FROM part",
    "emission_order": f"""
SELECT {FILE}, 'J012' AS rule_id, CAST(5 AS INTEGER) AS line, name FROM part JOIN {values([(n,) for n in VISITED_USES], 'i, name')} ON i >= p_partkey % 4
UNION ALL SELECT {FILE}, 'J009', CAST(7 AS INTEGER), '' FROM part
UNION ALL SELECT {FILE}, 'J009', CAST(8 AS INTEGER), '' FROM part WHERE p_partkey % 3 = 0""",
    "pattern_annotation": f"SELECT {FILE}, CAST(x AS INTEGER) AS line, CASE x WHEN 6 THEN 'a.b.Deprecated' ELSE 'Deprecated' END || ' at ' || x AS message FROM (SELECT p_partkey, unnest([1, 2, 3, 4, 6]) AS x FROM part) WHERE x <> 4 OR p_partkey % 2 = 0",
}
