"""Schemas of the tables that scans, rules and reports exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "file string, package string, parse_error string, n_lines int, imports array<struct<package:string,is_wildcard:boolean,is_static:boolean,line:int>>, nodes array<struct<{}>>"
NODE = (
    "nid int, end_nid int, parent_nid int, depth int, slot string, slot_ord int, kind string, line int, end_line int, name string, callee string, class_name string, "
    "type_name string, op string, value string, label string, modifiers array<string>, annotations array<struct<name:string,line:int>>, "
    "parameters array<struct<param_type:string,name:string>>, edge_path array<string>, nid_path array<int>"
)
PARSED = UNITS.format(", ".join(f.strip().replace(" ", ":", 1) for f in NODE.split(", ")))
VIOLATIONS = "rule_id string, severity string, file string, line int, end_line int, message string"
#: What rules return: visit sorts the rows of a rule and file in the order in which the rule finds them.
VISITED = f"{VIOLATIONS}, visit array<int>"
DIFFS = "file string, kind string, is_new boolean, ranges array<struct<start:int,end:int>>, hunks array<struct<os:int,ol:int,ns:int,nl:int>>"
BASELINE = "file string, line int, rule_id string"

SEVERITIES = ("info", "minor", "major", "critical")


def parse_severity(text: str) -> str:
    """A severity from text, trimmed and in any case; unknown names are an error."""
    name = text.strip().lower()
    if name not in SEVERITIES:
        raise ValueError(f"unknown severity: {text!r}")
    return name


def sev_rank(severity: Column) -> Column:
    """0 (info) to 3 (critical); null for anything else."""
    return F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])[F.lower(F.trim(severity))]
