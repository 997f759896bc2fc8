"""Rule catalogs, rule files and project settings, read on the driver."""

from __future__ import annotations

import re
import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import param_value, parse_flag
from ..operators.patterns import PatternRule
from ..operators.scripts import MARK, Script
from ..schemas import SEVERITIES


def read_yaml(text: str) -> dict:
    """The part of YAML that rule files use: nested maps, lists of scalars, quotes and comments."""
    try:
        import yaml
    except ImportError:
        return plain_yaml(text)
    return yaml.safe_load(text) or {}


def scalar(text: str):
    text = text.strip()
    if m := re.match(r"""^(?:"((?:\\.|[^"\\])*)"|'((?:''|[^'])*)')\s*(?:#.*)?$""", text):
        return m[1].replace('\\"', '"').replace("\\\\", "\\").replace("\\n", "\n") if m[1] is not None else m[2].replace("''", "'")
    text = re.sub(r"\s+#.*$", "", text)
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("", "~", "null"):
        return None
    return param_value(text)


def plain_yaml(text: str) -> dict:
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, indent: int):
        if i < len(lines) and lines[i][1].startswith("- "):
            out: list = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
                out.append(scalar(lines[i][1][2:]))
                i += 1
            return out, i
        made: dict = {}
        while i < len(lines) and lines[i][0] == indent:
            key, _, rest = lines[i][1].partition(":")
            i += 1
            if rest.strip() and not rest.strip().startswith("#"):
                made[key.strip().strip("\"'")] = scalar(rest)
            elif i < len(lines) and (lines[i][0] > indent or lines[i][1].startswith("- ") and lines[i][0] == indent):
                made[key.strip().strip("\"'")], i = block(i, lines[i][0])
            else:
                made[key.strip().strip("\"'")] = None
        return made, i

    return block(0, lines[0][0])[0] if lines else {}


def script_header(text: str, mark: str = "//!") -> dict:
    """Metadata of a rule script: lines of `mark` and `key: value` on top. `rule` or `id` is required; an unknown severity reads as minor."""
    found: dict = {"severity": "minor", "enabled": True, "params": {}, "span_policy": "anchor"}
    for line in text.removeprefix("\ufeff").splitlines():
        if not line.startswith(mark):
            if line.strip():
                break
            continue
        key, _, value = line[len(mark) :].strip().partition(":")
        key, value = key.strip(), value.strip()
        if key in ("rule", "id"):
            found["id"] = value
        elif key == "severity":
            found["severity"] = value.lower() if value.lower() in SEVERITIES else "minor"
        elif key == "enabled":
            found["enabled"] = parse_flag(value)
        elif key.startswith("params."):
            found["params"][key[7:]] = param_value(value)
        elif key == "params":
            found["params"] |= {k.strip(): param_value(v.strip()) for k, _, v in (p.partition("=") for p in value.split(",")) if k.strip()}
        elif key in ("title", "category"):
            found[key] = value
    if not found.get("id"):
        raise ValueError("a rule script needs a rule or id line")
    return found


def read_script(text: str) -> Script:
    """A rule script in Python, its metadata in `#!` lines on top."""
    head = script_header(text, MARK)
    return Script(head["id"], text, head["severity"], head["enabled"], head.get("title", ""), head["span_policy"], head["params"])


def rule_directory(path: str) -> tuple[list[PatternRule], list[Script]]:
    """The valid rules of a folder: patterns of .yml and .yaml files, and scripts of .py files that have a head. What is
    not valid, and scripts in other languages, is warned of and left out; so is a script whose id is taken."""
    out, scripts = [], []
    for f in sorted(Path(path).glob("*.rhai")):
        warnings.warn(f"{f}: scripts of this language are not run", stacklevel=2)
    for f in sorted(Path(path).glob("*.y*ml")):
        try:
            doc = read_yaml(f.read_text(encoding="utf-8"))
            rule = PatternRule.from_yaml(doc)
            problems = rule.problems(str(doc.get("severity", "minor")))
        except (KeyError, TypeError, ValueError, IndexError) as e:
            problems = [repr(e)]
        if problems:
            warnings.warn(f"{f}: {'; '.join(problems)}", stacklevel=2)
        else:
            out.append(rule)
    for f in sorted(Path(path).glob("*.py")):
        text = f.read_text(encoding="utf-8")
        if text.removeprefix("\ufeff").startswith(MARK):
            try:
                script = read_script(text)
                script.compiled()
                if script.id in {r.id for r in [*out, *scripts]}:
                    raise ValueError(f"the id {script.id} is taken")
                scripts.append(script)
            except Exception as e:
                warnings.warn(f"{f}: {e!r}", stacklevel=2)
    return out, scripts


@dataclass
class Entry:
    """A row of a rule catalog."""

    id: str
    name: str = ""
    script_path: str = ""
    severity: str = "info"
    enabled: bool = True
    group: str | None = None
    description: str | None = None
    applies_to: list[str] = field(default_factory=lambda: ["java"])
    params: dict = field(default_factory=dict)


def rule_catalog(path: str) -> list[Entry]:
    """The [[rules]] of a TOML file, none if there is no file; an id twice is an error."""
    if not Path(path).exists():
        return []
    rows = [Entry(**{k: v for k, v in r.items() if k in Entry.__dataclass_fields__}) for r in tomllib.loads(Path(path).read_text(encoding="utf-8")).get("rules", [])]
    ids = [r.id for r in rows]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"duplicate rule ids: {', '.join(twice)}")
    return rows


def loaded(entries: list[Entry], folder: str) -> tuple[list[PatternRule], list[Script], list[Entry]]:
    """Pattern rules and scripts with the catalog's id, severity, enabled flag and params laid over them, and the
    entries of registered rules. Paths count from `folder`, where the catalog is."""
    patterns, scripts, functions = [], [], []
    for e in entries:
        severity = e.severity.strip().lower()
        severity = severity if severity in SEVERITIES else "minor"
        if e.script_path.endswith((".yml", ".yaml")):
            rule = PatternRule.from_yaml(read_yaml((Path(folder) / e.script_path).read_text(encoding="utf-8")))
            rule.id, rule.enabled, rule.severity = e.id, e.enabled, severity
            rule.params = rule.params | e.params
            patterns.append(rule)
        elif e.script_path.endswith(".py"):
            text = (Path(folder) / e.script_path).read_text(encoding="utf-8")
            script = read_script(text) if text.startswith(MARK) else Script(e.id, text)
            script.id, script.enabled, script.severity, script.title = e.id, e.enabled, severity, e.name or script.title
            script.params = script.params | e.params
            scripts.append(script)
        else:
            functions.append(e)
    return patterns, scripts, functions


def rules_table(spark: SparkSession, patterns: list[PatternRule], scripts: list[Script], functions: list[Entry]) -> DataFrame:
    rows = [(r.id, r.title, r.severity, r.enabled) for r in [*patterns, *scripts]]
    rows += [(e.id, e.name, e.severity if e.severity in SEVERITIES else "major" if e.script_path.startswith("builtin:") else "minor", e.enabled) for e in functions]
    return spark.createDataFrame(rows, "id string, name string, severity string, enabled boolean")


@dataclass
class Project:
    """Settings of a project: [rules], [scan] and [gate] of a TOML file."""

    rules: dict = field(default_factory=dict)
    scan: dict = field(default_factory=dict)
    gate: dict | None = None

    @classmethod
    def read(cls, path: str) -> Project:
        if not Path(path).exists():
            return cls()
        d = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        if "gate" in d and (missing := {"max_critical", "max_major", "max_minor", "max_info"} - set(d["gate"])):
            raise ValueError(f"[gate] lacks {', '.join(sorted(missing))}")
        return cls(d.get("rules", {}), d.get("scan", {}), d.get("gate"))
