"""Diffs, line translation, baselines, order, counts, gates and reports, against plain loops."""

import io
import json
import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.operators import violations as V
from sedge.operators.matching import FreeEntries
from sedge.plans import scan
from sedge.schemas import VIOLATIONS, parse_severity
from sedge.sources import diffs, documents, reports

ROWS = [("A", "major", "x.java", 3, None, 'say "hi", now'), ("A", "major", "x.java", 9, 12, "m"), ("B", "info", "y.java", 1, None, "n"), ("C", "minor", "a.java", 7, 7, "line\nbreak")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, VIOLATIONS)


def test_functions(spark):
    values = ["abc", "a.c", "axc", "foo\n", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    cases = {"*": values, "a.c": ["a.c"], "a.*": ["a.c"], "a*": ["abc", "a.c", "axc"], "*c": ["abc", "a.c", "axc"], "*b*": ["abc"], "^a.c$": ["abc", "a.c", "axc"], "foo$": [], "[": [], ".*": []}
    for pattern, want in cases.items():
        got = [r["v"] for r in df.filter(T.pattern_match(pattern, F.col("v"))).collect()]
        assert got == want, pattern
    assert parse_severity(" Major ") == "major"
    with pytest.raises(ValueError):
        parse_severity("warning")
    one = df.limit(1).select(T.message("{a} {b} {c}", {"a": F.lit("{b}"), "b": F.lit("x")}).alias("m"), T.rfc3339(F.lit("2024-02-29 01:02:03.5").cast("timestamp")).alias("t"), T.strip_generics(F.lit("Map<K, V>")).alias("g")).first()
    assert tuple(one) == ("x x {c}", "2024-02-29T01:02:03.500000000Z", "Map")


def new_line(line, hunks):
    shift = 0
    for os, ol, ns, nl in sorted(hunks):
        if line < os:
            return line + shift
        if line < os + ol:
            return ns + line - os if line - os < nl else None
        shift += nl - ol
    return line + shift if hunks else None


def test_translation(spark):
    random.seed(1)
    cases = []
    for i in range(200):
        at, shift, hunks = 1, 0, []
        for _ in range(random.randint(0, 4)):
            at += random.randint(0, 5)
            ol, nl = random.randint(0, 3), random.randint(0, 3)
            hunks.append((at, ol, at + shift, nl))
            shift += nl - ol
            at += ol + 1
        cases.append((i, random.randint(1, 20), hunks))
    df = spark.createDataFrame(cases, "i int, line int, hunks array<struct<os:int,ol:int,ns:int,nl:int>>")
    got = {r["i"]: r["to"] for r in df.select("i", V.translate_line(F.col("line"), F.col("hunks")).alias("to")).collect()}
    assert got == {i: new_line(line, hunks) for i, line, hunks in cases}


def test_real_diff(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    git("init", "-q")
    old = [f"l{i}" for i in range(1, 21)]
    (tmp_path / "a.txt").write_text("\n".join(old) + "\n")
    git("add", ".")
    git("commit", "-qm", "1")
    new = [*old[:3], "in1", "in2", *old[3:8], *old[10:15], "changed", *old[16:]]
    (tmp_path / "a.txt").write_text("\n".join(new) + "\n")
    (tmp_path / "b.txt").write_text("x\n")
    git("add", ".")
    git("commit", "-qm", "2")
    table = diffs.diff_table(spark, diffs.get_diff(str(tmp_path), "HEAD~1..HEAD")).cache()
    found = {r["file"]: r for r in table.collect()}
    assert found["b.txt"]["is_new"] and found["b.txt"]["kind"] == "Added" and [tuple(r) for r in found["a.txt"]["ranges"]] == [(4, 5), (16, 16)]
    lines = spark.createDataFrame([("A", "info", "a.txt", i, None, "m") for i in range(1, 21)], VIOLATIONS)
    got = {r["message"]: r["line"] for r in V.translated(lines.withColumn("message", F.col("line").cast("string")), table, strict=True).collect()}
    assert all(got[str(i + 1)] == (new.index(t) + 1 if t in new else 16 if i == 15 else None) for i, t in enumerate(old))
    assert diffs.old_ref(str(tmp_path), "HEAD~1..HEAD") == "HEAD~1"
    old_rows = diffs.old_sources(str(tmp_path), "HEAD~1", spark.createDataFrame([("b.txt",), ("no such file",), ("a.txt",), (None,)], "file string")).collect()
    assert [(r["file"], bytes(r["content"]).decode()) for r in old_rows] == [("a.txt", "\n".join(old) + "\n")]
    kept = V.semantic_difference(lines, lines.filter("line > 10"), table, strict=True).collect()
    moved = {got[str(i)] for i in range(11, 21)}
    assert {r["line"] for r in kept} == set(range(1, 21)) - moved


def made_diff(n):
    """About n lines of a diff, with heads of all kinds and added lines that look like heads."""
    random.seed(n)
    out, size = ["a line before all", "+++ b/none"], 0
    for i in range(10**9):
        if size > n:
            return out
        kind = random.choice(["change", "change", "new", "gone", "mode", "binary"])
        out.append(f"diff --git a/f{i}.java b/f{i}.java")
        out += {"new": ["new file mode 100644"], "gone": ["deleted file mode 100644"], "mode": ["old mode 100644", "new mode 100755"]}.get(kind, [])
        out.append("index 1234567..89abcde 100644")
        if kind == "binary":
            out.append(f"Binary files a/f{i}.java and b/f{i}.java differ")
        elif kind != "mode":
            name = f'"b/f {i}.java"' if i % 7 == 0 else f"b/f{i}.java\t"
            out += ["--- /dev/null" if kind == "new" else f"--- a/f{i}.java", "+++ /dev/null" if kind == "gone" else f"+++ {name}"]
            for h in range(random.choice([1, 2, 40])):
                gone, added = random.randint(0, 3), random.randint(0, 3)
                out.append(f"@@ -{h * 10 + 1}{f',{gone}' if gone != 1 else ''} +{h * 11 + 1}{f',{added}' if added != 1 else ''} @@ class A {{")
                out += ["--- removed", "-x", "-y"][:gone] + ["+++ added", "+@@ -1 +1 @@", "+z"][:added]
        size = len(out)


def test_diff_as_a_scan_over_blocks(spark, tmp_path):
    for n, split in ((10, "1g"), (5_000, "4k"), (1_000_000, "2m")):
        lines = made_diff(n)
        path = tmp_path / f"d{n}.diff"
        path.write_text("\n".join(lines) + "\n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            rows = diffs.diff_files(diffs.diff_lines(spark, str(path)))
            assert n < 100 or diffs.diff_lines(spark, str(path)).select("block").distinct().count() > 3
            got = sorted((r["file"], r["kind"], r["is_new"], [tuple(x) for x in r["ranges"]], [tuple(x) for x in r["hunks"]]) for r in rows.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == sorted(diffs.parse_diff("\n".join(lines)))
    moved = diffs.rebased(spark.createDataFrame([("app/A.java",), ("application/B.java",)], "file string"), "/app/")
    assert [r[0] for r in moved.collect()] == ["A.java"]


def test_range_filter(spark, rows):
    table = spark.createDataFrame([("x.java", "Modified", False, [(10, 11)], []), ("a.java", "Modified", False, [], [])], "file string, kind string, is_new boolean, ranges array<struct<start:int,end:int>>, hunks array<struct<os:int,ol:int,ns:int,nl:int>>")
    pick = lambda p: sorted((r["file"], r["line"]) for r in V.filter_by_diff(rows, table, p).collect())
    assert pick({}) == [("a.java", 7), ("y.java", 1)] and pick({"A": "intersect"}) == [("a.java", 7), ("x.java", 9), ("y.java", 1)]


def naive(rows, base, tolerance):
    free, out = list(base), []
    for f, rule, line, o in sorted(rows, key=lambda r: r[3]):
        near = [(abs(b[1] - line), i) for i, b in enumerate(free) if b and (b[0], b[2]) == (f, rule) and abs(b[1] - line) <= tolerance]
        if near:
            free[min(near)[1]] = None
        else:
            out.append((f, rule, line, o))
    return sorted(out)


def test_tolerant_baseline(spark):
    random.seed(4)
    rows = [(random.choice("ab"), random.choice("xy"), random.randint(1, 30), i) for i in range(60)]
    base = [(random.choice("ab"), random.randint(1, 30), random.choice("xy")) for _ in range(40)]
    v = spark.createDataFrame(rows, "file string, rule_id string, line int, emit_ord int")
    b = spark.createDataFrame([(*x, i) for i, x in enumerate(base)], "file string, line int, rule_id string, ord int")
    assert sorted(map(tuple, V.baseline_tolerant(v, b, 2).collect())) == naive(rows, base, 2)


def test_tolerant_baseline_against_a_rescan(spark):
    for seed in range(30):
        random.seed(seed)
        rows = [(random.choice("ab"), "x", random.randint(1, 12), i) for i in range(40)]
        base = [(random.choice("ab"), random.randint(1, 12), "x") for _ in range(30)]
        for tolerance in (0, 1, 5, 100):
            free = {f: FreeEntries(sorted((b[1], i) for i, b in enumerate(base) if b[0] == f)) for f in "ab"}
            assert sorted(r for r in rows if not free[r[0]].take(r[2], tolerance)) == naive(rows, base, tolerance)


def test_tolerant_baseline_of_one_long_cluster(spark):
    n = 100_000
    line = (F.pmod(F.xxhash64("id"), F.lit(n)) + 1).cast("int").alias("line")
    v = spark.range(n).select(F.lit("A.java").alias("file"), F.lit("R").alias("rule_id"), line, F.struct(F.lit(1), F.array(F.col("id"))).alias("emit_ord"))
    b = spark.range(n).select(F.lit("A.java").alias("file"), (F.col("id") + 3).cast("int").alias("line"), F.lit("R").alias("rule_id"), F.col("id").alias("ord"))
    began = time.time()
    left = V.baseline_tolerant(v, b, 5).count()
    assert time.time() - began < 10
    free = FreeEntries([(i + 3, i) for i in range(n)])
    assert left == sum(not free.take(r["line"], 5) for r in v.orderBy("emit_ord").select("line").toLocalIterator())


def test_gate_and_counts(rows):
    counts = V.count_by_severity(rows)
    assert tuple(counts.first()) == (0, 2, 1, 1, 4)
    assert V.gate(counts).first()["failures"] == ["major: 2 > 0"] and V.gate(counts, {"max_major": 2}).first()["exit_code"] == 0
    assert {r["rule_id"]: r["level"] for r in V.first_per_rule(rows).collect()} == {"A": "error", "B": "note", "C": "warning"}
    assert [r["file"] for r in V.console_order(rows).collect()] == ["x.java", "x.java", "a.java", "y.java"]


def text_of(made):
    out = io.StringIO()
    made.stream(out)
    return out.getvalue()


def test_reports(rows):
    stats = reports.stats_of(rows, 3, 1)
    assert text_of(reports.report("csv", rows, stats)) == 'rule_id,severity,file,line,end_line,message\nC,minor,a.java,7,7,"line\nbreak"\nA,major,x.java,3,,"say ""hi"", now"\nA,major,x.java,9,12,m\nB,info,y.java,1,,n\n'
    shown = text_of(reports.console(rows, stats, color=False))
    assert "[MAJOR] x.java:9-12 (rule: A)" in shown and "2 major(s) 1 minor(s) 1 info(s) 1 parse error(s)" in shown
    with pytest.raises(ValueError):
        reports.report("pdf", rows, stats)


@pytest.mark.parametrize("format_", list(reports.FORMATS))
def test_documents_that_tasks_write(spark, rows, tmp_path, format_):
    many = rows.crossJoin(spark.range(50)).withColumn("line", (F.col("line") + F.col("id") * 3).cast("int")).drop("id")
    for some in (many, rows.limit(0)):
        made = reports.report(format_, some, reports.stats_of(some, 3, 1))
        want = text_of(made)
        one, parts = str(tmp_path / "one"), tmp_path / "parts"
        for _ in range(2):  # a second run replaces the first
            made.save(one)
            made.save(str(parts), single=False)
        same = (lambda t: {**json.loads(t), "scan_info": None}) if format_ == "json" else lambda t: t
        assert same(open(one, encoding="utf-8").read()) == same(want)
        assert same("".join(p.read_text(encoding="utf-8") for p in sorted(parts.iterdir()) if not p.name.startswith("."))) == same(want)
        assert sorted(p.name for p in tmp_path.iterdir()) == ["one", "parts"]
    doc = text_of(reports.report("sarif", many, reports.stats_of(many, 3, 1)))
    assert len(json.loads(doc)["runs"][0]["results"]) == 200


def test_documents_of_failed_tasks_leave_nothing(spark, tmp_path):
    bad = spark.range(8, numPartitions=4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise("x").alias("value"))
    with pytest.raises(Exception):
        documents.write_document(bad, str(tmp_path / "doc"))
    assert not list(tmp_path.iterdir())


def test_baseline_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "base.json")
    reports.write_baseline(rows, path)
    assert sorted((r["file"], r["line"], r["rule_id"]) for r in diffs.read_baseline(spark, path).collect()) == sorted((r[2], r[3], r[0]) for r in ROWS)


def test_empty_scan(spark):
    from sedge.sources import files

    none = files.parse_files(spark.createDataFrame([], "file string, text string"))
    assert scan.run_all(none, [], []).count() == 0


def test_baseline_in_lines_is_read_in_parts(spark, tmp_path):
    """A document of one entry per line is split; others give the same entries in the same order."""
    entries = [{"file": f"a{i % 7} ]}},[{{ \"ü\".java", "line": i, "rule_id": "R"} for i in range(3_000)] + [{"line": 7}, {"file": None, "more": {"x": [1]}}]
    forms = {
        "lines": "[\n" + ",\n".join(json.dumps(e) for e in entries) + "\n]\n", "pairs": "[\n" + ",\n".join(json.dumps(entries[i : i + 2])[1:-1] for i in range(0, len(entries), 2)) + "\n]",
        "one line": json.dumps(entries), "indented": json.dumps(entries, indent=2), "brackets inside": json.dumps(entries).replace("}, {", "},\n{"),
    }
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name, text in forms.items():
            (tmp_path / name).write_text(text)
            read = diffs.read_baseline(spark, str(tmp_path / name))
            assert [(r["file"], r["line"], r["rule_id"]) for r in read.orderBy("ord").collect()] == [(e.get("file") or "", e.get("line", 0), e.get("rule_id", "")) for e in entries], name
            if name == "lines":
                assert read.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in (("none", "[\n\n]\n"), ("none in a line", "[]")):
        (tmp_path / name).write_text(text)
        assert diffs.read_baseline(spark, str(tmp_path / name)).count() == 0
