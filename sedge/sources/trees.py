"""Syntax trees as nested JSON, one per file: the form in which rule scripts read them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

# The keys of each kind of node. A star marks a list; a column of the node, or a slot below it,
# stands before the key where they differ.
KEYS = {
    "CompilationUnit": "package imports* types* source_file",
    "ClassDeclaration": "name modifiers annotations members* line end_line",
    "InterfaceDeclaration": "name modifiers annotations members* line end_line",
    "EnumDeclaration": "name modifiers annotations constants* members* line end_line",
    "EnumConstant": "name annotations line",
    "AnnotationDeclaration": "name modifiers members* line end_line",
    "FieldDeclaration": "name modifiers annotations type_name:field_type initializer line",
    "MethodDeclaration": "name modifiers annotations type_name:return_type parameters body line end_line",
    "ConstructorDeclaration": "name modifiers annotations parameters body line end_line",
    "InitializerDeclaration": "body line",
    "BlockStmt": "line end_line statements*",
    "ExpressionStmt": "expression:expr line",
    "IfStmt": "condition then:then_stmt else:else_stmt line",
    "ForStmt": "init:initialization condition update* body line",
    "ForEachStmt": "variable iterable body line",
    "WhileStmt": "condition body line",
    "DoStmt": "body condition line",
    "TryStmt": "body:try_body catch_clauses* finally:finally_body line",
    "CatchClause": "type_name:exception_type name:exception_name body line",
    "ReturnStmt": "expression:expr line",
    "ThrowStmt": "expression:expr line",
    "BreakStmt": "label line",
    "ContinueStmt": "label line",
    "EmptyStmt": "line",
    "SwitchStmt": "selector cases* line",
    "SwitchCase": "statements* line",
    "SynchronizedStmt": "expression:expr body line",
    "UnknownStmt": "line",
    "MethodCallExpr": "callee name:method_name arguments* line",
    "FieldAccessExpr": "target name:field line",
    "NameExpr": "name line",
    "LiteralExpr": "value line",
    "BinaryExpr": "left op right line",
    "UnaryExpr": "expression:expr op line",
    "AssignExpr": "target op value line",
    "CastExpr": "type_name:cast_type expression:expr line",
    "ConditionalExpr": "condition then:then_expr else:else_expr line",
    "ArrayAccessExpr": "array index line",
    "ObjectCreationExpr": "class_name arguments* line",
    "ThisExpr": "line",
    "SuperExpr": "line",
    "InstanceOfExpr": "expression:expr type_name:check_type line",
    "LambdaExpr": "parameters body line",
    "EnclosedExpr": "expression:inner line",
    "VariableDeclarationExpr": "variables:declarations* line",
    "VariableDeclarationStmt": "variables:declarations* line",
    "Variable": "name initializer",
    "ArrayCreationExpr": "type_name:element_type initializer* line",
    "MethodReferenceExpr": "type_name:target line",
    "UnknownExpr": "value line",
}
#: Nodes that are parts of others and carry no kind.
NAMELESS = ("CompilationUnit", "EnumConstant", "CatchClause", "SwitchCase", "Variable")
COLUMNS = ("name", "callee", "class_name", "type_name", "op", "label", "line", "end_line", "modifiers", "annotations", "parameters")
#: What is read of a node.
READ = ("nid", "parent_nid", "slot", "kind", "value", *COLUMNS)
#: Nodes whose trees are made at once, at least those of one file.
SLICE_NODES = 10_000


def parts_of(keys: str) -> list[tuple[str, str, bool]]:
    """(column or slot, key, list or not) of each part of a kind."""
    out = []
    for part in keys.split():
        source, _, key = part.rstrip("*").partition(":")
        out.append((source, key or source, part.endswith("*")))
    return out


PARTS = {kind: parts_of(keys) for kind, keys in KEYS.items()}


def tree_of(file: str, package: str | None, imports: list[dict], nodes: list[dict]) -> dict | None:
    """The tree of a file's nodes, None without any. Nodes come by descending number, so that all below a
    node is built when its turn comes; what no kind lists is left out."""
    below: dict[int, dict[str, list]] = {}
    out = None
    for n in reversed(nodes):
        slots = below.pop(n["nid"], {})
        out = {} if n["kind"] in NAMELESS else {"kind": n["kind"]}
        for source, key, many in PARTS.get(n["kind"], ()):
            found = slots.get(source, ())
            if many:
                out[key] = list(reversed(found))
            elif found:
                out[key] = found[-1]
            else:
                out[key] = n[source] if source in COLUMNS or source == "value" and n["kind"] in ("LiteralExpr", "UnknownExpr") else None
        # nested types stand among the members, in their order
        slot = "members" if n["slot"].startswith("nested_") else n["slot"]
        below.setdefault(n["parent_nid"], {}).setdefault(slot, []).append(out)
    if out is not None:
        out |= {"package": package, "imports": imports, "source_file": file}
    return out


def trees(parsed: DataFrame) -> DataFrame:
    """(file, tree): the tree of each parsed file as JSON text; `parse_json` makes a VARIANT of it.
    Files that did not parse have none."""
    # the paths from the root make up most of a node and are not read here
    nodes = F.transform("nodes", lambda n: F.struct(*[n[c].alias(c) for c in READ]))
    return parsed.filter("parse_error is null").select("file", "package", "imports", nodes.alias("nodes")).mapInArrow(tree_batches, "file string, tree string")


def tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(pc.list_value_length(batch.column("nodes")), SLICE_NODES):
            yield trees_of(batch.slice(lo, hi - lo))


def trees_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(file, tree) of the files of a batch that have nodes."""
    nodes = batch.column("nodes")
    flat = nodes.flatten()
    rows = zip(*(flat.field(c).to_pylist() for c in READ), strict=True)
    made = []
    for file, package, imports, n in zip(*(batch.column(c).to_pylist() for c in ("file", "package", "imports")), pc.fill_null(pc.list_value_length(nodes), 0).to_pylist(), strict=True):
        tree = tree_of(file, package, imports, [dict(zip(READ, r, strict=True)) for r in islice(rows, n)])
        if tree is not None:
            made.append((file, json.dumps(tree, ensure_ascii=False)))
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.string()) for i in (0, 1)], names=["file", "tree"])
