"""Whether a loop may never end.

What a loop's body, method and type do to the names of its condition, and whether its body can be left,
are counts of events between two places of the nested-set table: differences of ranks, for
all loops of all files at once. Only the constants in a loop's head are then evaluated row by row,
over literals and names known to be constant; anything else is unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import VISITED
from .structure import LOOP_WALK, around, counts_between, merged, parent_at, visit_key

# The messages, and how comparisons turn when their sides change places.
DEFINITE = "循环条件在编译期即可确定为 true（字面量或常量传播），且条件所用变量在循环体内不被修改，且无 break/return/throw 退出：该循环将永不终止（死循环）"
NO_UPDATE = "for 循环缺少更新表达式（update），循环变量 [{vars}] 在条件中使用且条件涉及的所有变量在循环体内均未被修改，且无 break/return/throw 退出：计数器不会推进，可能死循环"
IDLE_UPDATE = "for 循环的更新表达式对循环变量 [{vars}] 无实际效果（如 i = i / i = 0 / i += 0），条件永远不会因更新而变为 false，且无 break/return/throw 退出：可能死循环"
AWAY = "for 循环更新方向与条件矛盾：循环变量 `{name}` 初始值为 {init}，条件为 `{name} {op} {bound}`，但更新表达式使变量朝远离条件的方向变化（delta={delta}），可能死循环"
ONE_NAME = "while/do-while 的循环条件仅依赖变量 `{name}`，该变量在循环体内从未被修改且无 break/return/throw 退出：可能为事件循环误用或死循环（请确认存在外部修改或退出机制）"
FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
COMPARE = {"<": int.__lt__, ">": int.__gt__, "<=": int.__le__, ">=": int.__ge__, "==": int.__eq__, "!=": int.__ne__}
LOOPS = ("ForStmt", "WhileStmt", "DoStmt", "ForEachStmt")
HEADS = ("ForStmt.init", "ForStmt.condition", "ForStmt.update", "WhileStmt.condition", "DoStmt.condition")
METHODS = ("MethodDeclaration", "ConstructorDeclaration", "InitializerDeclaration")
LEAVING = ("ThrowStmt", "ReturnStmt", "BreakStmt")
TYPES = ("ClassDeclaration", "InterfaceDeclaration", "EnumDeclaration", "AnnotationDeclaration")


class Head:
    """The nodes of a loop's initialization, condition and updates."""

    def __init__(self, nodes: list[dict], loop: int):
        self.nodes = nodes
        self.loop = loop
        self.kids: dict[int, list[dict]] = {}
        for n in nodes:
            self.kids.setdefault(n["parent_nid"], []).append(n)

    def children(self, nid: int, slot: str) -> list[dict]:
        return [c for c in self.kids.get(nid, ()) if c["slot"] == slot]

    def child(self, n: dict, slot: str) -> dict | None:
        return next(iter(self.children(n["nid"], slot)), None)

    def part(self, slot: str) -> list[dict]:
        return self.children(self.loop, slot)

    def below(self, n: dict | None) -> list[dict]:
        return [x for x in self.nodes if n["nid"] <= x["nid"] <= n["end_nid"]] if n else []

    def bare(self, n: dict | None) -> dict | None:
        while n is not None and n["kind"] == "EnclosedExpr":
            n = self.child(n, "expression")
        return n

    def target(self, n: dict | None) -> str | None:
        """The name that an assignment or ++ changes."""
        n = self.bare(n)
        if n is None:
            return None
        if n["kind"] in ("NameExpr", "FieldAccessExpr"):
            return n["name"]
        return self.target(self.child(n, "array")) if n["kind"] == "ArrayAccessExpr" else None

    def changed(self, nodes: list[dict]) -> set[str]:
        out = set()
        for x in nodes:
            if x["kind"] == "AssignExpr":
                out.add(self.target(self.child(x, "target")))
            elif x["kind"] == "UnaryExpr" and x["op"] in ("++", "--"):
                out.add(self.target(self.child(x, "expression")))
        return out - {None}

    def integer(self, n: dict | None, env: dict) -> int | None:
        n = self.bare(n)
        if n is None:
            return None
        if n["kind"] == "LiteralExpr":
            return int(n["value"].rstrip("lL")) if re.fullmatch(r"\d+[lL]?", n["value"] or "") else None
        if n["kind"] == "NameExpr":
            v = env.get(n["name"])
            return v if isinstance(v, int) and not isinstance(v, bool) else None
        if n["kind"] == "UnaryExpr" and n["op"] == "-":
            v = self.integer(self.child(n, "expression"), env)
            return None if v is None else -v
        if n["kind"] == "BinaryExpr" and n["op"] in ("+", "-", "*", "/", "%"):
            a, b = (self.integer(self.child(n, s), env) for s in ("left", "right"))
            if a is None or b is None or n["op"] in "/%" and not b:
                return None
            whole = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if b else 0
            return {"+": a + b, "-": a - b, "*": a * b, "/": whole, "%": a - b * whole}[n["op"]]
        return None

    def truth(self, n: dict | None, env: dict) -> bool | None:
        n = self.bare(n)
        if n is None:
            return None
        if n["kind"] == "LiteralExpr":
            return {"true": True, "false": False}.get(n["value"])
        if n["kind"] == "NameExpr" or n["kind"] == "FieldAccessExpr" and (t := self.child(n, "target")) and t["kind"] == "ThisExpr":
            v = env.get(n["name"])
            return v if isinstance(v, bool) else None
        if n["kind"] == "UnaryExpr" and n["op"] == "!":
            v = self.truth(self.child(n, "expression"), env)
            return None if v is None else not v
        if n["kind"] == "BinaryExpr":
            left, right = self.child(n, "left"), self.child(n, "right")
            if n["op"] in ("&&", "||"):
                a, b = self.truth(left, env), self.truth(right, env)
                return None if a is None or b is None else a and b if n["op"] == "&&" else a or b
            if n["op"] in COMPARE:
                a, b = self.integer(left, env), self.integer(right, env)
                if a is not None and b is not None:
                    return COMPARE[n["op"]](a, b)
                a, b = self.truth(left, env), self.truth(right, env)
                if a is not None and b is not None and n["op"] in ("==", "!="):
                    return (a == b) == (n["op"] == "==")
        return None


def step(f: Head, u: dict, name: str, env: dict) -> int | None:
    """By how much an update moves a variable, if that is known."""
    u = f.bare(u)
    if u["kind"] == "UnaryExpr" and u["op"] in ("++", "--") and f.target(f.child(u, "expression")) == name:
        return 1 if u["op"] == "++" else -1
    if u["kind"] != "AssignExpr" or f.target(f.child(u, "target")) != name:
        return None
    value = f.bare(f.child(u, "value"))
    if u["op"] in ("+=", "-="):
        n = f.integer(value, {})
        return None if n is None else n if u["op"] == "+=" else -n
    if u["op"] == "=" and value["kind"] == "BinaryExpr" and value["op"] in ("+", "-"):
        left, n = f.bare(f.child(value, "left")), f.integer(f.child(value, "right"), {})
        if left["kind"] == "NameExpr" and left["name"] == name and n is not None:
            return n if value["op"] == "+" else -n
    return None


def idle(f: Head, u: dict, start: dict) -> bool:
    """Whether an update leaves its variable as it is, or always as it began."""
    u = f.bare(u)
    if u["kind"] != "AssignExpr":
        return False
    name, value = f.target(f.child(u, "target")), f.bare(f.child(u, "value"))
    n = f.integer(value, {})
    if u["op"] == "=":
        return value["kind"] == "NameExpr" and value["name"] == name or n is not None and start.get(name) == n
    return u["op"] in ("+=", "-=") and n == 0 or u["op"] in ("*=", "/=") and n == 1


def away(f: Head, cond: dict, start: dict, updates: list[dict]) -> str | None:
    """The message, if the condition compares a variable with a number and an update moves it the wrong way."""
    cond = f.bare(cond)
    if cond is None or cond["kind"] != "BinaryExpr" or cond["op"] not in FLIPPED:
        return None
    left, right, op = f.bare(f.child(cond, "left")), f.bare(f.child(cond, "right")), cond["op"]
    if left["kind"] != "NameExpr":
        left, right, op = right, left, FLIPPED[op]
    bound = f.integer(right, {})
    if left["kind"] != "NameExpr" or bound is None or left["name"] not in start or not COMPARE[op](start[left["name"]], bound):
        return None
    for u in updates:
        delta = step(f, u, left["name"], {})
        if delta and (delta < 0) == (op in ("<", "<=")):
            return AWAY.format(name=left["name"], init=start[left["name"]], op=op, bound=bound, delta=delta)
    return None


def judge(loop: dict) -> str | None:
    """The message, if a loop may never end. `loop` has kind, leaves (whether the body can be left),
    head (nodes) and names: of the condition's names, whether body or updates change them (mutated), whether
    the method assigns them anywhere (assigned), and the constant value known (or null)."""
    f = Head(loop["head"] or [], loop["nid"])
    is_for = loop["kind"] == "ForStmt"
    cond = next(iter(f.part("condition")), None)
    facts = {x["name"]: x for x in loop["names"] or []}
    env = {n: x["value"] for n, x in facts.items() if x["value"] is not None}
    mutated = any(x["mutated"] for x in facts.values())
    start: dict[str, int] = {}
    variables: list[str] = []
    updates = f.part("update") if is_for else []
    for init in f.part("init") if is_for else ():
        for v in f.children(init["nid"], "variables") if init["kind"] == "VariableDeclarationExpr" else ():
            variables.append(v["name"])
            n = f.integer(f.child(v, "initializer"), {})
            if n is not None:
                start[v["name"]] = n
    true = cond is None and is_for or f.truth(cond, {**start, **env}) is True
    if loop["leaves"]:
        return None
    if true and not mutated:
        return DEFINITE
    if is_for:
        used = [v for v in variables if v in facts]
        if not updates:
            return NO_UPDATE.format(vars=", ".join(used)) if used and not mutated else None
        if f.truth(cond, {**start, **env}) is not False:
            moved = [u for u in updates if f.changed(f.below(u)) & facts.keys()]
            if moved and all(idle(f, u, start) for u in moved):
                return IDLE_UPDATE.format(vars=", ".join(sorted({x for u in moved for x in f.changed(f.below(u)) & facts.keys()})))
        return away(f, cond, start, updates)
    if cond is not None and cond["kind"] == "NameExpr" and not (fact := facts[cond["name"]])["mutated"] and not fact["assigned"] and fact["value"] is None:
        return ONE_NAME.format(name=cond["name"])
    return None


def changes(n: DataFrame) -> DataFrame:
    """(file, name, nid) of every place that assigns a name: targets of assignments, ++ and --, through
    parentheses and array indexes."""
    inside = ("EnclosedExpr.expression", "ArrayAccessExpr.array")
    places = n.filter(F.col("kind").isin("NameExpr", "FieldAccessExpr") & F.col("name").isNotNull())
    places = places.withColumn("at", F.array_max(F.transform("edge_path", lambda e, i: F.when(~e.isin(*inside), i)))).withColumn("edge", F.get("edge_path", F.col("at")))
    places = places.select("file", "name", "nid", "edge", parent_at(F.col("at")).alias("by"))
    counting = n.filter((F.col("kind") == "UnaryExpr") & F.col("op").isin("++", "--")).select("file", F.col("nid").alias("by"))
    assigned = places.filter(F.col("edge") == "AssignExpr.target")
    counted = places.filter(F.col("edge") == "UnaryExpr.expression").join(merged(counting), ["file", "by"], "left_semi")
    return assigned.unionByName(counted.select(assigned.columns)).select("file", "name", "nid")


def exits(n: DataFrame, loops: DataFrame) -> DataFrame:
    """(file, nid) of the loops whose body can be left: by a throw or a labelled break, by a return that no lambda of
    the body holds, or by a break that no inner loop takes."""
    leaving = n.filter(F.col("kind").isin(*LEAVING))
    # what an event can leave: everything around it, what stands in the same lambda, or the innermost loop
    lambda_, loop_ = F.concat(F.lit("lambda "), F.coalesce(around("LambdaExpr").cast("string"), F.lit(""))), F.concat(F.lit("loop "), around(*LOOPS).cast("string"))
    reach = F.when(F.col("kind") == "ReturnStmt", lambda_).when((F.col("kind") == "BreakStmt") & F.col("label").isNull(), loop_).otherwise("all")
    events = leaving.select("file", reach.alias("reach"), "nid").filter("reach is not null")
    own = F.concat(F.lit("lambda "), F.coalesce(F.col("lambda").cast("string"), F.lit("")))
    asked = loops.select("file", F.col("nid").alias("loop"), F.explode(F.array(F.lit("all"), own, F.concat(F.lit("loop "), F.col("nid").cast("string")))).alias("reach"), F.col("body").alias("lo"), F.col("body_end").alias("hi"))
    return counts_between(asked, events, ["file", "reach"]).filter("n > 0").select("file", F.col("loop").alias("nid")).distinct()


def constants(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that hold true or false: (file, owner, name, value) of final fields, and (file, method, name,
    value) of local variables, of several with one name the last."""
    literal = n.filter((F.col("kind") == "LiteralExpr") & F.col("value").isin("true", "false") & (F.col("slot") == "initializer")).select("file", F.col("parent_nid").alias("nid"), (F.col("value") == "true").alias("value"))
    fields = n.filter((F.col("kind") == "FieldDeclaration") & (F.col("slot") == "members") & F.array_contains("modifiers", "final")).select("file", "nid", F.col("parent_nid").alias("owner"), "name")
    held = F.array_compact(F.transform("edge_path", lambda e, i: F.when(F.substring_index(e, ".", 1).isin(*METHODS), parent_at(i))))
    variables = n.filter(F.col("kind") == "Variable").select("file", "nid", "name", held.alias("held")).join(merged(literal), ["file", "nid"])
    variables = variables.select("file", "name", "nid", "value", F.explode("held").alias("method")).groupBy("file", "method", "name").agg(F.max_by("value", "nid").alias("value"))
    return fields.join(merged(literal), ["file", "nid"]).select("file", "owner", "name", "value"), variables


def loop_facts(nodes: DataFrame, reachable: Column) -> DataFrame:
    """One row per loop that walkers reach, as `judge` takes it, with its place."""
    # read by a dozen small steps: what is kept is a few columns of the nodes that any of them looks at
    looked_at = F.col("kind").isin(*LOOPS, *METHODS, *LEAVING, "NameExpr", "FieldAccessExpr", "UnaryExpr", "Variable", "FieldDeclaration") | F.exists("edge_path", lambda e: e.isin(*HEADS)) | F.col("slot").isin("body", "update", "initializer")
    n = nodes.filter(reachable & looked_at).select("file", "nid", "end_nid", "parent_nid", "slot", "kind", "line", "end_line", "name", "op", "value", "label", "modifiers", "edge_path", "nid_path").persist()
    found = n.filter(F.col("kind").isin(*LOOPS[:3])).select("file", "nid", "kind", "line", visit_key(LOOP_WALK).alias("visit"), around("LambdaExpr").alias("lambda"), around(*METHODS).alias("method"), around(*TYPES).alias("owner"))
    # a method counts if it stands inside the innermost type
    found = found.withColumn("method", F.when(F.col("method") > F.coalesce("owner", F.lit(-1)), F.col("method")))
    found = found.withColumn("in_lambda", F.coalesce(F.col("lambda") > F.coalesce("method", "owner", F.lit(-1)), F.lit(False)))
    is_body = F.col("slot") == "body"
    part = lambda c: F.max(F.when(is_body, F.col(c)))
    parts = n.filter(F.col("slot").isin("body", "update") & F.substring_index(F.element_at("edge_path", -1), ".", 1).isin(*LOOPS[:3])).groupBy("file", F.col("parent_nid").alias("nid"))
    parts = parts.agg(part("nid").alias("body"), part("end_nid").alias("body_end"), F.max(F.when(is_body & (F.col("kind") == "BlockStmt"), F.col("end_line"))).alias("end_line"), F.min("nid").alias("lo"))
    methods = n.filter(F.col("kind").isin(*METHODS)).select("file", F.col("nid").alias("method"), F.col("end_nid").alias("method_end"))
    loops = found.join(merged(parts), ["file", "nid"]).join(merged(methods), ["file", "method"], "left").persist()
    # the heads: a node may stand in those of several loops
    heads = F.explode(F.array_compact(F.transform("edge_path", lambda e, i: F.when(e.isin(*HEADS), F.struct(e.alias("edge"), parent_at(i).alias("loop")))))).alias("h")
    held = n.filter(F.exists("edge_path", lambda e: e.isin(*HEADS))).select("file", "nid", "end_nid", "parent_nid", "slot", "kind", "name", "op", "value", heads).persist()
    columns = ("nid", "end_nid", "parent_nid", "slot", "kind", "name", "op", "value")
    head = held.groupBy("file", F.col("h.loop").alias("nid")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("head"))
    used = held.filter(F.endswith("h.edge", F.lit(".condition")) & F.col("kind").isin("NameExpr", "FieldAccessExpr") & F.col("name").isNotNull()).select("file", F.col("h.loop").alias("nid"), "name").distinct()
    names = loops.select("file", "nid", "lo", "body_end", "method", "method_end", "owner", "in_lambda").join(merged(used), ["file", "nid"]).persist()
    # changes of a name in body and updates, and in the whole method, in one pass
    changed = changes(n)
    asked = names.select("file", "name", F.col("nid").alias("loop"), F.explode(F.array(F.struct(F.lit(True).alias("inner"), F.col("lo"), F.col("body_end").alias("hi")), F.struct(F.lit(False).alias("inner"), F.col("method").alias("lo"), F.col("method_end").alias("hi")))).alias("q"))
    counts = counts_between(asked.select("file", "name", "loop", "q.*").filter("lo is not null"), changed, ["file", "name"])
    counts = counts.groupBy("file", "name", F.col("loop").alias("nid")).agg(F.max(F.col("inner") & (F.col("n") > 0)).alias("mutated"), F.max(~F.col("inner") & (F.col("n") > 0)).alias("assigned"))
    fields, locals_ = constants(n)
    facts = names.join(merged(counts), ["file", "name", "nid"], "left").join(merged(fields.withColumnRenamed("value", "field")), ["file", "owner", "name"], "left").join(merged(locals_.withColumnRenamed("value", "local")), ["file", "method", "name"], "left")
    value = F.when(F.col("in_lambda"), F.lit(None)).otherwise(F.coalesce(F.when(F.col("assigned"), F.lit(None)).otherwise(F.col("local")), "field"))
    facts = facts.groupBy("file", "nid").agg(F.collect_list(F.struct("name", F.coalesce("mutated", F.lit(False)).alias("mutated"), F.coalesce("assigned", F.lit(False)).alias("assigned"), value.alias("value"))).alias("names"))
    left = exits(n, loops).withColumn("leaves", F.lit(True))
    rows = loops.join(merged(head), ["file", "nid"], "left").join(merged(facts), ["file", "nid"], "left").join(merged(left), ["file", "nid"], "left")
    return rows.select("file", "nid", "kind", "line", "end_line", "visit", F.coalesce("leaves", F.lit(False)).alias("leaves"), "head", "names")


def loop_violations(nodes: DataFrame, reachable: Column) -> DataFrame:
    """Loops that may never end, with the line on which a block body ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [judge(r) for r in batch.select(["nid", "kind", "leaves", "head", "names"]).to_pylist()]
            kept = batch.append_column("message", pa.array(texts, pa.string())).filter(pa.array([t is not None for t in texts], pa.bool_()))
            fixed = [pa.array([x] * kept.num_rows, pa.string()) for x in ("J009", "major")]
            yield pa.RecordBatch.from_arrays([*fixed, *(kept.column(c) for c in ("file", "line", "end_line", "message", "visit"))], names=["rule_id", "severity", "file", "line", "end_line", "message", "visit"])

    return loop_facts(nodes, reachable).mapInArrow(run, VISITED)
