"""Parsing, patterns and rules over small Java sources."""

import io
import json
import subprocess
import sys

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from sedge.operators import patterns, rules, scripts
from sedge.operators.patterns import PatternRule
from sedge.plans import scan
from sedge.sources import config, files, listing, trees
from sedge.sources.batches import by_slices, slices
from sedge.sources.java import parse_source

HERE = __file__.rpartition("/")[0]
RULES = [
    PatternRule("J001", "MethodCall", {"callee": ["System.out", "System.err"], "method": ["print", "println", "printf"]}, "use a logger, not {callee}.{method} (line {line})"),
    PatternRule("J003", "Import", {"is_wildcard": "true"}, "no wildcards"),
    PatternRule("J004", "ClassDeclaration", {"name": "^[a-z]"}, "class name"),
    PatternRule("J005", "MethodDeclaration", {"name": "^[A-Z]"}, "method {name}"),
    PatternRule("J007", "FieldDeclaration", {"modifier": "final", "name": "[a-z]"}, "{modifier} {field_type} {name}"),
    PatternRule("J010", "Import", {"package": "com.alibaba.fastjson*"}, "no fastjson"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return files.parse_files(files.java_files(spark, f"{HERE}/java")).cache()


def lines(df, rule):
    return sorted(r["line"] for r in df.filter(f"rule_id = '{rule}'").collect())


def test_patterns(parsed):
    out = patterns.match_patterns(files.nodes_of(parsed), files.imports_of(parsed), RULES).cache()
    assert {r.id: lines(out, r.id) for r in RULES} == {"J001": [34], "J003": [3], "J004": [], "J005": [38], "J007": [9], "J010": [4]}
    shown = {r["rule_id"]: r["message"] for r in out.collect()}
    assert shown["J001"] == "use a logger, not System.out.println (line 34)" and shown["J007"] == "static, final int badName" and shown["J005"] == "method Upper"


def test_rules(parsed):
    out = rules.run_rules(files.nodes_of(parsed), files.imports_of(parsed), list(rules.REGISTRY), {"J006": {"max_lines": 3}}).cache()
    assert lines(out, "J009") == [13, 16, 22, 25, 28, 31, 36]
    assert lines(out, "J008") == [39]  # the one in a switch is not seen
    assert lines(out, "J011") == [5] and lines(out, "J012") == [34] and lines(out, "J006") == [33, 38]
    assert {r["end_line"] for r in out.filter("rule_id = 'J009' and line = 13").collect()} == {13}


def test_uses_and_controllers(spark):
    text = """import com.google.gson.Gson; import com.alibaba.fastjson.*;
@RestController class A {
  @GetMapping Object a(Map<String, Object> m, java.util.HashMap<A, B> n, MultiValueMap<A, B> o) { return new Gson().toJson(m); }
  void plain(Map m) { Object x = (com.alibaba.fastjson.JSONObject) m; Object y = a ? new Gson() : null; Object z = new Gson(); }
  class B { @PostMapping void b(Map m) { } }
  @Controller class C { @PostMapping void c(Map m) { } }
}"""
    p = files.parse_files(spark.createDataFrame([("A.java", text)], "file string, text string")).cache()
    out = rules.run_rules(files.nodes_of(p), files.imports_of(p), ["J012", "J013", "J015"]).cache()
    assert (lines(out, "J012"), lines(out, "J013"), lines(out, "J015")) == ([4], [3, 3, 6], [4])


def test_function_rule(parsed):
    rule = rules.function_rule("X1", "info", lambda f: [{"line": len(f["imports"]), "message": f["file"]}])
    assert [tuple(r) for r in rule(files.nodes_of(parsed), files.imports_of(parsed), {}).collect()] == [("X1", "info", "Loops.java", 3, None, "Loops.java", [0])]
    bad = rules.function_rule("X2", "info", lambda f: 1 / 0)
    assert bad(files.nodes_of(parsed), files.imports_of(parsed), {}).count() == 0


def test_parser():
    p = parse_source("class A { int f = 1, g[] = {2}; <T> void m(final int... x) { a().b(c -> c + 1).d(); int[] z = new int[3]; if (q instanceof B b && x < 3 && y >= 2) x >>>= 2; String s = \"\"\"\n \"hi\" \"\"\"; } }")
    assert p["parse_error"] is None
    by = [(n[6], n[9], n[10], n[13]) for n in p["nodes"]]
    assert ("MethodCallExpr", "d", "a().b(c -> c + 1)", None) in by and ("AssignExpr", None, None, ">>>=") in by and sum(k == "FieldDeclaration" for k, *_ in by) == 2
    for n in p["nodes"]:
        assert n[0] <= n[1] and (n[2] < 0 or p["nodes"][n[2]][1] >= n[1])
    assert parse_source("class A { void m( }")["parse_error"] and parse_source("record R(int a) { }")["parse_error"] and parse_source("")["nodes"][0][6] == "CompilationUnit"
    deep = parse_source("class A { int f = " + "(" * 5000 + "1" + ")" * 5000 + "; }")
    assert deep["parse_error"]


def test_decoding():
    for text, name in (("中文", "utf-8"), ("中文字符", "gbk"), ("plain", "ascii")):
        assert files.decode_source(text.encode(name)) == text
    assert files.decode_source(b"\xef\xbb\xbfx") == "x" and files.decode_source("é".encode("latin1"), "latin1") == "é" and files.decode_source(b"x\xff", "nonsense") == "x�"
    assert files.effective_encoding("auto", "gbk") == "gbk" and files.effective_encoding("big5", "gbk") == "big5" and files.effective_encoding() == "auto"


def test_listing_and_cache(spark, tmp_path):
    for name in ("a/B.java", "a/target/C.java", "a/c d/D.java", "a/E.txt", "a/F.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class X { }" if name != "a/F.java" else "class X {")
    found = files.java_files(spark, str(tmp_path))
    assert sorted(r["file"] for r in found.collect()) == ["a/B.java", "a/F.java", "a/c d/D.java"]
    assert [r["file"] for r in files.java_files(spark, str(tmp_path), (), ("target",)).collect()] == ["a/target/C.java"]
    cache = str(tmp_path / "cache")
    for _ in range(2):
        out = files.parse_cached(found, cache).collect()
        assert sorted(r["file"] for r in out) == ["a/B.java", "a/F.java", "a/c d/D.java"] and sum(r["parse_error"] is not None for r in out) == 1
        assert spark.read.parquet(cache).count() == 2


def test_cache_goes_with_the_parser_and_mends_itself(spark, tmp_path, monkeypatch):
    from pathlib import Path

    cache = tmp_path / "cache"
    rows = spark.createDataFrame([(f"F{i}.java", f"class C{i} {{ }}".encode()) for i in range(6)], "file string, content binary").repartition(3)
    names = lambda: sorted(r["nodes"][1]["name"] for r in files.parse_cached(rows, str(cache)).collect())
    want = [f"C{i}" for i in range(6)]
    assert names() == want
    (own,) = cache.iterdir()
    parts = sorted(own.glob("*.parquet"))
    parts[0].write_bytes(b"no parquet")
    for crc in own.glob(".*.crc"):
        crc.unlink()
    assert names() == want and len(list(own.glob("*.parquet"))) > len(parts)  # what was in the broken file is parsed again
    count = len(list(own.glob("*.parquet")))
    assert names() == want
    read = Path.read_bytes
    monkeypatch.setattr(Path, "read_bytes", lambda self: read(self) + (b"# changed" if self.name == "java.py" else b""))
    assert names() == want
    (new,) = (p for p in cache.iterdir())
    assert new.name != own.name and not own.exists() and count


class Watched(fs.FileSystemHandler):
    """A local file system that notes what is listed and opened."""

    def __init__(self):
        self.local, self.listed, self.read = fs.LocalFileSystem(), [], []

    def get_type_name(self):
        return "watched"

    def get_file_info(self, paths):
        return self.local.get_file_info(paths)

    def get_file_info_selector(self, selector):
        self.listed.append(selector.base_dir)
        return self.local.get_file_info(selector)

    def open_input_stream(self, path):
        self.read.append(path)
        return pa.PythonFile(open(path, "rb"))

    def normalize_path(self, path):
        return path

    create_dir = delete_dir = delete_dir_contents = delete_root_dir_contents = delete_file = move = copy_file = open_input_file = open_output_stream = open_append_stream = None


Watched.__abstractmethods__ = frozenset()


def test_excluded_folders_are_never_opened(tmp_path):
    for name in ("a/B.java", "target/deep/C.java", "a/.git/D.java", "a/b/E.java", "a/b/F.txt", "G.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class X { }" * (len(name)))
    watched = Watched()
    options = {"path": str(tmp_path), "excludes": json.dumps(["target", ".git"]), "partitionBytes": "150000"}
    reader = listing.FilesReader(options, (fs.PyFileSystem(watched), str(tmp_path)))
    parts = reader.partitions()
    assert sorted(watched.listed) == sorted(str(tmp_path / x) for x in ("", "a", "a/b")) and not watched.read
    assert [len(p.names) for p in parts] == [1, 1, 1] and sorted(n for p in parts for n in p.names) == ["G.java", "a/B.java", "a/b/E.java"]
    got = [n for p in parts for b in reader.read(p) for n in b.column("file").to_pylist()]
    assert sorted(got) == ["G.java", "a/B.java", "a/b/E.java"] and len(watched.read) == 3
    only = listing.FilesReader(options | {"only": json.dumps(["a/B.java", "a/.git/D.java", "no.java", "a/b/F.txt"])}, (fs.PyFileSystem(watched), str(tmp_path)))
    assert [p.names for p in only.partitions()] == [["a/B.java"]] and len(watched.listed) == 3
    assert listing.FilesReader(options, (fs.LocalFileSystem(), str(tmp_path / "target"))).partitions()[0].names == []
    with pytest.raises(FileNotFoundError):
        listing.FilesReader(options, (fs.LocalFileSystem(), str(tmp_path / "gone"))).partitions()


def test_source_files_with_a_charset(spark, tmp_path):
    for name, charset in (("A.java", "gbk"), ("B.java", "utf-8"), ("c/C.java", "gbk")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes("class 中文 { }".encode(charset))
    for root in (str(tmp_path), f"file://{tmp_path}"):
        rows = listing.source_files(spark, root, encoding="auto").collect()
        assert sorted(r["file"] for r in rows) == ["A.java", "B.java", "c/C.java"] and {r["text"] for r in rows} == {"class 中文 { }"}
    assert listing.source_files(spark, str(tmp_path), includes=("c/",)).count() == 1
    with pytest.raises(Exception, match="gone"):
        listing.source_files(spark, str(tmp_path / "gone")).count()


def test_catalog(tmp_path):
    (tmp_path / "r.yml").write_text("id: Y1\nseverity: warning\npattern:\n  type: Import\n  match_fields:\n    package:\n      - \"a.b*\"   # one\n      - 'c'\nmessage: \"no {package}\"\n")
    (tmp_path / "bad.yml").write_text("id: Y2\npattern:\n  type: Import\n  match_fields:\n    color: red\n")
    (tmp_path / "c.toml").write_text('[[rules]]\nid = "Z1"\nscript_path = "r.yml"\nseverity = "major"\n[[rules]]\nid = "J008"\nscript_path = "builtin:J008"\nseverity = "warning"\n')
    text = (tmp_path / "r.yml").read_text()
    assert config.plain_yaml(text) == config.read_yaml(text)
    with pytest.warns(UserWarning):
        assert config.rule_directory(str(tmp_path)) == ([], [])  # warning is no severity, color no key
    found, _, entries = config.loaded(config.rule_catalog(str(tmp_path / "c.toml")), str(tmp_path))
    assert (found[0].id, found[0].severity, found[0].fields) == ("Z1", "major", {"package": ["a.b*", "c"]}) and entries[0].id == "J008"
    (tmp_path / "d.toml").write_text('[[rules]]\nid = "A"\n[[rules]]\nid = "A"\n')
    with pytest.raises(ValueError):
        config.rule_catalog(str(tmp_path / "d.toml"))
    head = config.script_header("//! rule: S1\n//! severity: odd\n//! enabled: off\n//! params: a=1, b=2.5, c=true, d=x\nlet y = 1;\n")
    assert head["id"] == "S1" and head["severity"] == "minor" and not head["enabled"] and head["params"] == {"a": 1, "b": 2.5, "c": True, "d": "x"}


SCRIPT = """#! rule: S1
#! title: no short methods
#! severity: major
#! params: least=2

def walk(members, config):
    out = []
    for m in members:
        if m["kind"] == "ClassDeclaration":
            out += walk(m["members"], config)
        elif m["kind"] == "MethodDeclaration" and m["body"] and len(m["body"]["statements"]) < config["least"]:
            out.append({"line": m["line"], "message": "short: " + m["name"], "end_line": m["end_line"]})
    return out

def check(ast, config):
    return [x for t in ast["types"] for x in walk(t["members"], config)]
"""
BAD = {
    "S2": "def check(ast, config):\n    return [{}, {'line': '7'}]",
    "S3": "def check(ast, config):\n    while 'B' == ast['types'][0]['name']:\n        pass\n    return []",
    "S4": "def f(n):\n    return f(n + 1)\n\ndef check(ast, config):\n    try:\n        f(0)\n    except Exception:\n        return []",
    "S5": "def check(ast, config):\n    x = 'x'\n    while True:\n        x = x + x\n",
    "S6": "def check(ast, config):\n    return [{}] * 10_001",
    "S7": "def check(ast, config):\n    return 1 / 0",
    "S8": "def check(ast, config):\n    return None",
    "S9": "import no_such_module\n\ndef check(ast, config):\n    return []",
    "S10": "x = 1",
}


def test_scripts_have_budgets_and_their_errors_are_rows(spark):
    p = files.parse_files(spark.createDataFrame([("A.java", "class A { void m() { } }"), ("B.java", "class B { }"), ("C.java", "class {")], "file string, text string"))
    some = [config.read_script(SCRIPT), *(scripts.Script(k, v) for k, v in BAD.items())]
    found = scripts.run_scripts(p, some, scripts.Limits(steps=20_000)).cache()
    good = sorted((r["rule_id"], r["severity"], r["file"], r["line"], r["end_line"], r["message"], r["visit"]) for r in scripts.violations_of(found).collect())
    assert good == sorted([("S1", "major", "A.java", 1, 1, "short: m", [0])] + [("S2", "minor", f, line, None, "violation", [i]) for f in ("A.java", "B.java") for i, line in enumerate((0, 7))])
    errors = {(r["rule_id"], r["file"]): r["error"] for r in scripts.errors_of(found).collect()}
    assert set(errors) == {("S3", "B.java")} | {(f"S{i}", f) for i in range(4, 11) for f in ("A.java", "B.java")}
    starts = {"S3": "OverBudget: more than 20000 steps", "S4": "OverBudget: more than 512 calls", "S5": "OverBudget: a text", "S6": "OverBudget: a list", "S7": "ZeroDivisionError", "S8": "TypeError", "S9": "ModuleNotFoundError", "S10": "ValueError"}
    assert all(e.startswith(starts[rule]) for (rule, _), e in errors.items())
    assert "no_such_module" not in {k for k in sys.modules}


def test_trees(spark):
    text = "package p; import a.B; class A { int f = 1; class N { } void m(int q) { if (q > 1) { go(q); } else return; for (;;) { } try { } catch (E e) { } finally { go(); } } }"
    p = files.parse_files(spark.createDataFrame([("A.java", text), ("B.java", "class {"), ("C.java", "")], "file string, text string"))
    got = {r["file"]: json.loads(r["tree"]) for r in trees.trees(p).collect()}
    assert set(got) == {"A.java", "C.java"} and got["C.java"]["types"] == []
    a = got["A.java"]
    assert a["package"] == "p" and a["imports"][0]["package"] == "a.B" and a["source_file"] == "A.java" and "kind" not in a
    f, n, m = a["types"][0]["members"]
    assert f["initializer"] == {"kind": "LiteralExpr", "value": "1", "line": 1} and n["kind"] == "ClassDeclaration" and m["parameters"] == [{"param_type": "int", "name": "q"}]
    if_, for_, try_ = m["body"]["statements"]
    assert if_["then_stmt"]["statements"][0]["expr"]["arguments"][0]["name"] == "q" and if_["else_stmt"]["expr"] is None and for_["condition"] is None and for_["update"] == []
    assert try_["catch_clauses"][0]["exception_name"] == "e" and try_["finally_body"]["statements"][0]["expr"]["method_name"] == "go"


def test_a_scan_with_scripts_of_a_folder(spark, tmp_path, capsys):
    folder = tmp_path / "rules"
    folder.mkdir()
    (folder / "short.py").write_text(SCRIPT)
    (folder / "bad.py").write_text("#! rule: S7\n" + BAD["S7"])
    (folder / "helper.py").write_text("x = 1")  # no head: no rule
    (folder / "twice.py").write_text(SCRIPT)
    (folder / "broken.py").write_text("#! rule: S8\ndef check(:")
    (tmp_path / "A.java").write_text("class A {\n  void m() { }\n}")
    out = io.StringIO()
    with pytest.warns(UserWarning, match="taken|SyntaxError"):
        assert scan.main(["scan", str(tmp_path), "--rules-dir", str(folder), "--enable", "S1", "--enable", "S7", "--format", "json"], spark, out) == 0
    doc = json.loads(out.getvalue())
    assert [(v["rule_id"], v["line"], v["end_line"], v["message"]) for v in doc["violations"]] == [("S1", 2, 2, "short: m")] and doc["scan_info"]["duration_ms"] > 0
    assert "warning: rule S7 failed on A.java: ZeroDivisionError" in capsys.readouterr().err
    (tmp_path / "catalog.toml").write_text('[[rules]]\nid = "Z"\nname = "mine"\nscript_path = "rules/short.py"\nseverity = "info"\nparams = { least = 0 }\n')
    out = io.StringIO()
    assert scan.main(["scan", str(tmp_path), "--rules-file", str(tmp_path / "catalog.toml"), "--format", "csv"], spark, out) == 0
    assert out.getvalue().count("\n") == 1  # no method has fewer than no statements
    (tmp_path / "c.diff").write_text("diff --git a/src/A.java b/src/A.java\n--- a/src/A.java\n+++ b/src/A.java\n@@ -1,0 +2,1 @@\n+x\n")
    for diff_root, n in (("src", 1), ("other", 0)):
        out = io.StringIO()
        args = ["scan", str(tmp_path), "--rules-dir", str(folder), "--enable", "S1", "--format", "csv", "--diff-file", str(tmp_path / "c.diff"), "--diff-root", diff_root]
        with pytest.warns(UserWarning):
            assert scan.main(args, spark, out) == 0
        assert out.getvalue().count("\n") == n + 1


def test_command_line(spark, tmp_path):
    out = io.StringIO()
    assert scan.main(["scan", f"{HERE}/java", "--format", "json", "--enable", "J008", "--enable", "J009"], spark, out) == 0
    doc = json.loads(out.getvalue())
    assert doc["stats"]["by_rule"] == {"J008": 1, "J009": 7} and doc["scan_info"]["files_scanned"] == 1 and doc["violations"][0]["line"] == 13
    (tmp_path / "gate.yml").write_text("max_critical: 0\nmax_major: 2\n")
    base, sarif = str(tmp_path / "base.json"), str(tmp_path / "out.sarif")
    args = ["scan", f"{HERE}/java", "--enable", "J009", "--gate-config", str(tmp_path / "gate.yml")]
    assert scan.main([*args, "--baseline-out", base, "--format", "sarif", "--output", sarif], spark, io.StringIO()) == 1
    results = json.load(open(sarif))["runs"][0]
    assert len(results["results"]) == 7 and results["tool"]["driver"]["rules"][0]["defaultConfiguration"]["level"] == "error"
    out = io.StringIO()
    assert scan.main([*args, "--baseline", base], spark, out) == 0 and "All checks passed" in out.getvalue()
    assert scan.main(["scan", f"{HERE}/java", "--semantic-diff"], spark, io.StringIO()) == 2
    out = io.StringIO()
    assert scan.main(["rules"], spark, out) == 0 and "J009\tmajor\ton" in out.getvalue()


def test_changed_files_of_a_subfolder(spark, tmp_path, capsys):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    git("init", "-q")
    folder = tmp_path / "app/src"
    folder.mkdir(parents=True)
    body = "class A {\n  // %s\n  void m() { try { go(); } catch (Exception e) { } }\n\n%s}\n"
    for name in ("A.java", "b [1] c.java", "Same.java"):
        (folder / name).write_bytes((body % ("\u6ce8", "")).encode("gb18030"))
    (tmp_path / "notes.txt").write_text("x\n")
    git("add", ".")
    git("commit", "-qm", "1")
    more = "  void n() { try { go(); } catch (Exception e) { } }\n"
    for name in ("A.java", "b [1] c.java"):
        (folder / name).write_bytes((body % ("\u6ce8", more)).encode("gb18030"))
    (folder / "New.java").write_text("class N {")
    (tmp_path / "notes.txt").write_text("y\n")
    git("add", ".")
    git("commit", "-qm", "2")
    for extra in ((), ("--semantic-diff",)):
        out = io.StringIO()
        assert scan.main(["scan", str(folder), "--diff", "HEAD~1..HEAD", "--encoding", "gbk", "--format", "json", "--enable", "J008", *extra], spark, out) == 0
        doc = json.loads(out.getvalue())
        assert [(v["file"], v["line"]) for v in doc["violations"]] == [("A.java", 5), ("b [1] c.java", 5)]
        assert doc["scan_info"]["files_scanned"] == 3 and doc["scan_info"]["parse_errors"] == 1  # Same.java is not read
        assert "warning: New.java: " in capsys.readouterr().err
    assert files.java_files(spark, str(folder), only=["Gone.java", "A.txt"]).count() == 0


def arrow_schema(spark):
    return files.to_arrow_schema(files.StructType.fromDDL(files.PARSED))


def test_parsing_holds_a_part_of_a_batch(spark):
    """Rows of one batch are parsed and handed on in parts, long files by themselves."""
    texts = [f"class C{i % 5} {{ void m() {{ {'run(); ' * (i % 3)}}} }}" for i in range(700)] + [f"class D {{ {'int f = 1; ' * 30_000}}}", None, "class {"]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.java" for i in range(len(texts))]), pa.array(texts)], names=["file", "text"])
    parts = list(files.parse_batches(iter([batch]), arrow_schema(spark)))
    assert len(parts) >= 4 and max(p.num_rows for p in parts) <= files.SLICE_FILES
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["file"] for r in rows] == batch.column("file").to_pylist()
    for r, text in zip(rows, texts, strict=True):
        unit = parse_source(text or "")
        assert [tuple(n.values())[:3] for n in r["nodes"]] == [tuple(n[:3]) for n in unit["nodes"]] and r["parse_error"] == unit["parse_error"]
    assert not list(files.parse_batches(iter([batch.slice(0, 0)]), arrow_schema(spark)))


def test_tasks_that_parse_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 1_000)
    rows = spark.range(300).selectExpr("concat('P', id, '.java') as file", "concat('class C { int f', id, '; }') as text")
    for frame in (rows, rows.selectExpr("file", "encode(text, 'utf-8') as content")):
        p = files.parse_files(frame, partitions=2)
        assert p.rdd.getNumPartitions() == 7 and p.filter("size(nodes) = 3 and parse_error is null").count() == 300
    assert files.parse_files(rows.limit(0), partitions=2).count() == 0


def test_trees_come_in_parts(spark, monkeypatch):
    """Several files a batch, and no more nodes at once than asked."""
    monkeypatch.setattr(trees, "SLICE_NODES", 10)
    seen = []
    monkeypatch.setattr(trees, "trees_of", lambda b, real=trees.trees_of: seen.append(b.num_rows) or real(b))
    texts = [f"class C{i} {{ int f = {i}; String s; }}" for i in range(9)] + [f"class D {{ {'int f; ' * 30}}}", ""]
    batch = next(files.parse_batches(iter([pa.RecordBatch.from_arrays([pa.array([f"{i}.java" for i in range(11)]), pa.array(texts)], names=["file", "text"])]), arrow_schema(spark)))
    made = [r for b in trees.tree_batches(iter([batch])) for r in b.to_pylist()]
    assert seen == [2, 2, 2, 2, 1, 1, 1]
    assert made == [{"file": r["file"], "tree": json.dumps(trees.tree_of(r["file"], r["package"], r["imports"], r["nodes"]), ensure_ascii=False)} for r in batch.to_pylist()]


def test_by_slices():
    held = []

    def one(t, n):
        held.append(t)
        return None if t is None else t.decode() * n

    made = by_slices(one, pa.string(), pa.array([b"ab", None, b"", b"abcdef", b"c"]), pa.array([1, 2, 3, 1, 2]), most=3)
    assert made.to_pylist() == ["ab", None, "", "abcdef", "cc"] and len(held) == 5
    assert by_slices(one, pa.string(), pa.array([], pa.binary()), pa.array([], pa.int32())).to_pylist() == []
    assert list(slices(pa.array([2, None, 0, 6, 1]), 3)) == [(0, 3), (3, 4), (4, 5)] and list(slices(pa.array([0] * 5), 3, 2)) == [(0, 2), (2, 4), (4, 5)]


def test_equal_texts_are_looked_at_once(spark):
    """What is found in a text goes to every file that holds it, as if each had been parsed by itself."""
    bad = "import a.b.*;\nclass a { void M() { System.out.println(); while (true) { } }\nvoid n() { try { } catch (E e) { } } }"
    texts = [bad, "class B { void m() { while (true) { run(); } } }", bad + "\n", "class {", "", None]
    rows = spark.createDataFrame([(f"P{i}.java", texts[i % 6]) for i in range(60)] + [("P0.java", bad)], "file string, text string")
    named, once = files.by_content(rows)
    assert named.count() == 61 and sorted(r["text"] for r in once.collect()) == sorted({t or "" for t in texts})
    ids = list(rules.REGISTRY)
    each = scan.run_all(files.parse_files(rows.dropDuplicates()), RULES, ids)
    both = scan.run_texts(rows, RULES, ids, partitions=2)
    assert both.schema == each.schema
    found = [str(r) for r in each.collect()]
    assert len(found) == 130 and sorted(found) == sorted(str(r) for r in scan.run_texts(rows.dropDuplicates(), RULES, ids).collect())
    # a file that is listed twice counts twice
    assert both.count() == len(found) + sum("file='P0.java'" in r for r in found)


def test_java_scan_parses_each_text_once(spark, monkeypatch):
    from sedge import java_queries

    sizes = []
    monkeypatch.setattr(files, "parse_files", lambda f, *a, real=files.parse_files, **k: sizes.append(f.count()) or real(f, *a, **k))
    part = spark.range(0, 3_000).select((F.col("id") * 38_798_760 + F.col("id") % 3).alias("p_partkey"))
    monkeypatch.setattr(java_queries, "java_sources", lambda s, d: part.select(F.concat(F.lit("P"), "p_partkey").alias("file"), java_queries.java_text().alias("text")))
    found = java_queries.java_scan(spark, "")
    counts = {r["rule_id"]: r["n"] for r in found.collect()}
    assert sizes == [3] and counts["J010"] == 1_000 and counts["J013"] == 1_000
    # files, which may be many, meet what was found in tasks
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin", 1)[0]


def test_what_comes_of_nodes_is_not_broadcast(spark):
    """Spark sizes nodes by the texts' table; many rows of every file would go through the driver."""
    text = "import com.alibaba.fastjson.JSON;\nimport org.json.JSONObject;\nclass A { static final boolean ON = true; boolean done; void m() { boolean go = true;\nwhile (go) { x = new JSON(); }\nwhile (ON) { y = new JSONObject(); }\nfor (int i = 0; i < 3; i--) { }\nwhile (done) { } } }"
    p = files.parse_files(spark.createDataFrame([(f"P{i}.java", text) for i in range(5)], "file string, text string"))
    for rule, lines in (("J009", (4, 5, 6, 7)), ("J012", (4,)), ("J015", (5,))):
        found = rules.run_rules(files.nodes_of(p), files.imports_of(p), [rule])
        assert sorted((r["file"], r["line"]) for r in found.collect()) == [(f"P{i}.java", n) for i in range(5) for n in lines], rule
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString(), rule
