"""Rules that need more than a pattern, each a DataFrame over nodes and imports."""

from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_annotation, is_loose_map
from ..schemas import VISITED
from .loops import loop_violations
from .patterns import CATCH_BLOCKED, LOOP_BLOCKED, USE_BLOCKED, reachable, union
from .structure import USE_WALK, contained, merged, visit_key

Rule = Callable[[DataFrame, DataFrame, dict], DataFrame]

# Package prefixes, and the messages of the shipped rules.
FASTJSON = ("com.alibaba.fastjson",)
OTHER_JSON = ("com.google.gson", "org.json", "net.sf.json", "org.codehaus.jackson")
LONG_METHOD = ("方法长度 ", " 行，超过 ", " 行限制")
STRING_UTILS = ("StringUtils 应使用 org.apache.commons.lang3.StringUtils，不建议使用其它包（", "）")
FASTJSON_PATH = ("禁止使用 fastjson / fastjson2（", "），请改用 jackson（com.fasterxml.jackson）")
FASTJSON_NAME = ("禁止使用 fastjson（", "），请改用 jackson（com.fasterxml.jackson）")
JSON_PATH = ("禁止使用非 jackson（com.fasterxml.jackson）的 JSON 框架（", "），请改用 jackson；如必须使用请走部门审核确认")
JSON_NAME = ("禁止使用非 jackson 的 JSON 框架（", "），请改用 jackson（com.fasterxml.jackson）")
MAP_PARAMETER = ("HTTP 接口 '", "' 不允许使用 Map 传参（参数类型 ", "），应定义明确的请求参数对象（DTO）")
EMPTY_CATCH = "empty catch block: exception is silently swallowed"
ENDPOINTS = ("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping")


def rows(df: DataFrame, rule_id: str, severity: str, message: Column, visit: Column | None = None) -> DataFrame:
    """Violations at the rows of `df`, which are nodes unless they are given their own `visit`."""
    visit = visit_key() if visit is None else visit
    return df.select(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), "file", "line", F.lit(None).cast("int").alias("end_line"), message.alias("message"), visit.alias("visit"))


def long_method(nodes: DataFrame, imports: DataFrame, params: dict) -> DataFrame:
    """J006: methods of top-level types of more than max_lines lines."""
    most = int(params.get("max_lines", 50))
    n = F.col("end_line") - F.col("line")
    found = nodes.filter((F.col("kind") == "MethodDeclaration") & (F.col("depth") == 2) & (n > most))
    a, b, c = LONG_METHOD
    return rows(found, "J006", params.get("severity", "minor"), F.concat(F.lit(a), n.cast("string"), F.lit(f"{b}{most}{c}")))


def empty_catch(nodes: DataFrame, imports: DataFrame, params: dict) -> DataFrame:
    """J008: catch clauses whose block has no statement: the block directly follows and is the subtree's end."""
    found = nodes.filter((F.col("kind") == "CatchClause") & reachable(CATCH_BLOCKED) & (F.col("end_nid") == F.col("nid") + 1))
    return rows(found, "J008", "major", F.lit(EMPTY_CATCH))


def string_utils(nodes: DataFrame, imports: DataFrame, params: dict) -> DataFrame:
    """J011: StringUtils from elsewhere than commons-lang3."""
    p = F.col("package")
    found = imports.filter((p.endswith(".StringUtils") | p.endswith(".StringUtil")) & ~p.startswith("org.apache.commons.lang3."))
    return rows(found, "J011", params.get("severity", "minor"), F.concat(F.lit(STRING_UTILS[0]), p, F.lit(STRING_UTILS[1])), F.array("ord"))


def uses_of(nodes: DataFrame, imports: DataFrame, prefixes: tuple[str, ...], bare: tuple[str, ...], rule_id: str, severity: str, by_path: tuple[str, str], by_name: tuple[str, str]) -> DataFrame:
    """Places that use a library by its full name, or by a simple name imported from it. Imported names
    meet nodes of their file by an equi-join; the full name is a filter."""
    has = lambda t: F.coalesce(sum_or([t.contains(p) for p in prefixes]), F.lit(False))
    simple = F.substring_index(F.regexp_replace("package", r"\.\*$", ""), ".", -1)
    known = imports.filter(sum_or([F.col("package").startswith(p) for p in prefixes])).select("file", simple.alias("used")).filter(~F.col("used").isin(*bare)).distinct()
    named = {"MethodCallExpr": "callee", "ObjectCreationExpr": "class_name"}
    typed = ("CastExpr", "InstanceOfExpr", "MethodReferenceExpr")
    kinds = nodes.filter(F.col("kind").isin(*named, *typed) & reachable(USE_BLOCKED))
    target = F.when(F.col("kind") == "MethodCallExpr", F.col("callee")).when(F.col("kind") == "ObjectCreationExpr", F.col("class_name")).otherwise(F.col("type_name"))
    places = kinds.select("file", "line", "kind", "edge_path", "nid_path", target.alias("used")).filter("used is not null")
    path = rows(places.filter(has(F.col("used"))), rule_id, severity, F.concat(F.lit(by_path[0]), "used", F.lit(by_path[1])), visit_key(USE_WALK))
    name = places.filter(F.col("kind").isin(*named) & ~has(F.col("used"))).join(merged(known), ["file", "used"], "left_semi")
    return path.unionByName(rows(name, rule_id, severity, F.concat(F.lit(by_name[0]), "used", F.lit(by_name[1])), visit_key(USE_WALK)))


def sum_or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def fastjson_uses(nodes: DataFrame, imports: DataFrame, params: dict) -> DataFrame:
    """J012."""
    return uses_of(nodes, imports, FASTJSON, ("fastjson",), "J012", params.get("severity", "major"), FASTJSON_PATH, FASTJSON_NAME)


def other_json_uses(nodes: DataFrame, imports: DataFrame, params: dict) -> DataFrame:
    """J015."""
    return uses_of(nodes, imports, OTHER_JSON, ("gson", "json", "jackson"), "J015", params.get("severity", "major"), JSON_PATH, JSON_NAME)


def map_parameters(nodes: DataFrame, imports: DataFrame, params: dict) -> DataFrame:
    """J013: endpoint methods of controllers that take a loose map; a row per parameter. A nested
    type counts only beneath controllers, so all types around a method are controllers."""
    types = nodes.filter(F.col("kind").isin("ClassDeclaration", "InterfaceDeclaration") & F.coalesce(has_annotation(F.col("annotations"), "Controller"), F.lit(False)))
    methods = nodes.filter((F.col("kind") == "MethodDeclaration") & has_annotation(F.col("annotations"), *ENDPOINTS) & (F.size(F.filter("parameters", lambda p: is_loose_map(p["param_type"]))) > 0))
    methods = methods.filter(~F.exists("edge_path", lambda e: e.contains(".body") | e.rlike("nested_(enum|annotation)$")))
    shown = methods.select("file", "nid", "end_nid", "line", "name", "depth", "parameters", visit_key().alias("visit"))
    held = contained(types.select("file", "nid", "end_nid"), shown).groupBy("descendant").agg(F.count("*").alias("around")).filter(F.col("around") == F.col("descendant.depth") - 1)
    each = held.select("descendant.*").select("file", "line", "name", "visit", F.posexplode("parameters").alias("at", "p")).filter(is_loose_map(F.col("p.param_type")))
    a, b, c = MAP_PARAMETER
    text = F.concat(F.lit(a), "name", F.lit(b), "p.param_type", F.lit(c))
    return rows(each, "J013", params.get("severity", "major"), text, F.concat("visit", F.array(F.lit(-1), "at")))


def endless_loops(nodes: DataFrame, imports: DataFrame, params: dict) -> DataFrame:
    """J009: loops that may never end."""
    return loop_violations(nodes, reachable(LOOP_BLOCKED))


#: The registry: rules by id; others may be added with register().
REGISTRY: dict[str, Rule] = {"J006": long_method, "J008": empty_catch, "J009": endless_loops, "J011": string_utils, "J012": fastjson_uses, "J013": map_parameters, "J015": other_json_uses}
SPAN_POLICIES = {"J009": "intersect"}
SEVERITY = {"J006": "minor", "J011": "minor"}  # of those that are not major


def register(rule_id: str, rule: Rule, span_policy: str = "anchor") -> None:
    """Adds a rule: a function of (nodes, imports, params) to rows of the schema VISITED."""
    REGISTRY[rule_id] = rule
    SPAN_POLICIES[rule_id] = span_policy


def function_rule(rule_id: str, severity: str, check: Callable[[dict], list[dict]]) -> Rule:
    """A rule from a Python function that gets one file's {"file", "nodes", "imports"} and returns
    {"line", "message", "end_line"} dicts. An error leaves the file without rows of this rule."""

    def run(nodes: DataFrame, imports: DataFrame, params: dict) -> DataFrame:
        def per_file(key: tuple, n: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
            try:
                found = check({"file": key[0], "nodes": n.to_dict("records"), "imports": i.to_dict("records"), "config": params})
                made = [(rule_id, severity, key[0], int(v.get("line", 0)), v.get("end_line"), str(v.get("message", "violation")), [i]) for i, v in enumerate(found)]
            except Exception as e:  # one bad file must not end the scan
                sys.stderr.write(f"warning: {rule_id} failed on {key[0]}: {e!r}\n")
                made = []
            return pd.DataFrame(made, columns=["rule_id", "severity", "file", "line", "end_line", "message", "visit"]).astype({"line": "Int32", "end_line": "Int32"})

        return nodes.groupBy("file").cogroup(imports.groupBy("file")).applyInPandas(per_file, VISITED)

    return run


def run_rules(nodes: DataFrame, imports: DataFrame, ids: list[str], params: dict[str, dict] | None = None) -> DataFrame | None:
    return union([REGISTRY[i](nodes, imports, (params or {}).get(i, {})) for i in ids if i in REGISTRY])
