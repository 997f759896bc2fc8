"""Declarative patterns over syntax nodes.

A walker follows some edges of the tree only. Nodes carry the edges from the root, so what a walker
reaches is a filter, not a recursion. All rules of one kind share one scan: each row
gets an array of the rules it meets.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_of, flag_match, message, modifier_match, value_match
from ..schemas import SEVERITIES
from .structure import visit_key

# Edges that walkers do not follow, and edges on the way to declarations.
ALWAYS_BLOCKED = ("EnumDeclaration.constants", "SwitchStmt.labels", "TryStmt.resources", "ArrayCreationExpr.dimensions")
CALL_BLOCKED = (
    *ALWAYS_BLOCKED, "FieldDeclaration.initializer", "InitializerDeclaration.body", "ForEachStmt.variable", "ArrayCreationExpr.initializer", "InstanceOfExpr.expression", "LambdaExpr.body",
    *(f"{k}Declaration.nested_{n}" for k in ("Class", "Interface", "Enum", "Annotation") for n in ("interface", "enum", "annotation")),
)
CATCH_BLOCKED = (*ALWAYS_BLOCKED, "FieldDeclaration.initializer", "InitializerDeclaration.body", "ForEachStmt.body", "SwitchCase.statements", "LambdaExpr.body")
USE_BLOCKED = (
    *ALWAYS_BLOCKED, "ConditionalExpr.condition", "ConditionalExpr.then", "ConditionalExpr.else", "ArrayAccessExpr.array", "ArrayAccessExpr.index",
    "ArrayCreationExpr.initializer", "LambdaExpr.body",
)
LOOP_BLOCKED = (*ALWAYS_BLOCKED, "ForEachStmt.variable")
NESTED_OTHER = tuple(f"{k}Declaration.nested_{n}" for k in ("Class", "Interface", "Enum", "Annotation") for n in ("interface", "enum", "annotation"))

KEYS = {
    "MethodCall": {"callee", "method", "method_name"},
    "Import": {"package", "is_wildcard", "is_static"},
    "Annotation": {"name", "type"},
    "ClassDeclaration": {"name", "modifier", "modifiers"},
    "MethodDeclaration": {"name", "return_type", "modifier", "modifiers"},
    "FieldDeclaration": {"name", "field_type", "type", "modifier", "modifiers"},
}


def reachable(blocked: tuple[str, ...]) -> Column:
    return ~F.arrays_overlap("edge_path", F.array(*map(F.lit, blocked)))


@dataclass
class PatternRule:
    id: str
    pattern: str
    fields: dict[str, str | list[str]]
    message: str
    severity: str = "minor"
    title: str = ""
    enabled: bool = True
    span_policy: str = "anchor"
    params: dict = field(default_factory=dict)

    @classmethod
    def from_yaml(cls, d: dict) -> PatternRule:
        """A rule from a parsed YAML document; an unknown severity reads as minor."""
        p = d.get("pattern") or {}
        severity = str(d.get("severity", "minor")).strip().lower()
        fields = {k: [str(x) for x in v] if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in (p.get("match_fields") or {}).items()}
        return cls(d["id"], p.get("type", ""), fields, d.get("message", ""), severity if severity in SEVERITIES else "minor", d.get("title", ""), d.get("enabled", True), d.get("span_policy", "anchor"), d.get("params") or {})

    def problems(self, severity: str | None = None) -> list[str]:
        """What is wrong with the rule: unknown pattern kinds and keys, and a severity that is none."""
        out = [] if severity is None or severity.strip().lower() in SEVERITIES else [f"unknown severity {severity!r}"]
        if self.pattern not in KEYS:
            return [*out, f"unknown pattern type {self.pattern!r}"]
        return out + [f"unknown key {k!r}" for k in self.fields if k not in KEYS[self.pattern]]


def condition(rule: PatternRule, columns: dict[str, Column], flags: tuple[str, ...] = ()) -> Column:
    tests = []
    for k, wanted in sorted(rule.fields.items()):
        if k in flags:
            tests.append(flag_match(wanted, columns[k]))
        elif k in ("modifier", "modifiers"):
            tests.append(modifier_match(wanted, columns["modifier"]))
        elif k in columns:
            tests.append(value_match(wanted, columns[k]))
        else:
            tests.append(F.lit(False))
    return all_of(tests)


def fused(rows: DataFrame, rules: list[tuple[PatternRule, Column, dict[str, Column]]], line: Column, visit: Column | None = None) -> DataFrame:
    """Violations of several rules from one pass over `rows`, in the order of `visit` (else of lines)."""
    hits = [
        F.when(test, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), message(r.message, {**captured, "line": line}).alias("message")))
        for r, test, captured in rules
    ]
    # few rows are hit; only for these the order of visits is worked out
    rows = rows.filter(reduce(lambda a, b: a | b, [test for _, test, _ in rules]))
    found = rows.select("file", line.alias("line"), (F.array(line) if visit is None else visit).alias("visit"), F.explode(F.array_compact(F.array(*hits))).alias("v"))
    return found.select("v.rule_id", "v.severity", "file", "line", F.lit(None).cast("int").alias("end_line"), "v.message", "visit")


def match_patterns(nodes: DataFrame, imports: DataFrame, rules: list[PatternRule]) -> DataFrame | None:
    """Violations of the enabled rules; None without any. One scan per kind of pattern."""
    c = F.col
    by: dict[str, list[PatternRule]] = {}
    for r in rules:
        if r.enabled and r.pattern in KEYS:
            by.setdefault(r.pattern, []).append(r)
    out = []
    modifiers = F.array_join("modifiers", ", ")
    for kind, some in by.items():
        visit = visit_key()
        if kind == "MethodCall":
            rows = nodes.filter((c("kind") == "MethodCallExpr") & reachable(CALL_BLOCKED))
            fields = {"callee": c("callee"), "method": c("name"), "method_name": c("name")}
            made = [(r, condition(r, fields), {k: fields[k] for k in sorted(r.fields) if k in fields}) for r in some]
        elif kind == "Import":
            rows, visit = imports, F.array("ord")
            fields = {"package": c("package"), "is_wildcard": c("is_wildcard"), "is_static": c("is_static")}
            made = [(r, condition(r, fields, ("is_wildcard", "is_static")), {k: fields[k] for k in sorted(r.fields) if k in fields}) for r in some]
        elif kind == "Annotation":
            owners = nodes.filter(c("kind").endswith("Declaration") & reachable((*NESTED_OTHER, "ClassDeclaration.x")) & ~F.exists("edge_path", lambda e: e.contains(".body") | e.contains(".initializer")))
            rows = owners.select("file", visit.alias("owner"), F.posexplode("annotations").alias("at", "a")).select("file", c("a.line").alias("line"), c("a.name").alias("name"), F.concat("owner", F.array(F.lit(-1), "at")).alias("visit"))
            visit = c("visit")
            fields = {"name": c("name"), "type": c("name")}
            made = [(r, condition(r, fields), {"name": c("name"), "type": c("name")}) for r in some]
        else:
            top = reachable(NESTED_OTHER) & ~F.exists("edge_path", lambda e: e.contains(".body"))
            rows = nodes.filter((c("kind") == kind) & top)
            if kind == "ClassDeclaration":  # classes inside other types than classes are not seen
                rows = rows.filter(~F.exists("edge_path", lambda e: e.rlike("^(Interface|Enum|Annotation)Declaration")))
            else:
                rows = rows.filter(~F.exists(F.slice("edge_path", F.lit(2), F.greatest(F.size("edge_path") - 2, F.lit(0))), lambda e: ~e.startswith("ClassDeclaration.nested_class")))
            fields = {"name": c("name"), "return_type": c("type_name"), "field_type": c("type_name"), "type": c("type_name"), "modifier": c("modifiers")}
            shown = {"name": c("name"), "modifier": modifiers, "modifiers": modifiers}
            shown |= {"return_type": c("type_name")} if kind == "MethodDeclaration" else {"field_type": c("type_name"), "type": c("type_name")} if kind == "FieldDeclaration" else {}
            made = [(r, condition(r, fields), shown) for r in some]
        out.append(fused(rows, made, c("line"), visit))
    return union(out)


def union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out
