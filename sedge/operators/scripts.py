"""Rule scripts: Python text with a head of metadata, run on the tree of each file by a table function.

A script defines `check(ast, config)` and returns a list of {"line", "message", "end_line"}. Scripts are
trusted local files, but may be wrong: each run on a file has a budget of steps, of call depth and
of sizes, and ends alone when it exceeds it. What fails comes back as rows (file, rule_id, error) beside
the violations.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.trees import trees

FOUND = "rule_id string, severity string, line int, end_line int, message string, visit array<int>, error string"
MARK = "#!"


@dataclass
class Limits:
    """Lines that a script may execute on a file, calls inside one another, and what it may hold."""

    steps: int = 2_000_000
    depth: int = 512
    text: int = 1_000_000
    items: int = 10_000


@dataclass
class Script:
    id: str
    source: str
    severity: str = "minor"
    enabled: bool = True
    title: str = ""
    span_policy: str = "anchor"
    params: dict = field(default_factory=dict)

    def compiled(self):
        """The script's check function; errors of the text show here."""
        names: dict = {"__name__": f"rule_{self.id}"}
        exec(compile(self.source, self.id, "exec"), names)
        if not callable(names.get("check")):
            raise ValueError("the script defines no check(ast, config)")
        return names["check"]


class OverBudget(BaseException):
    """Not an Exception, so that a script's own handlers let it pass."""


class Meter:
    """Counts lines, calls and sizes of what runs beneath `run`, in frames of the script."""

    def __init__(self, limits: Limits, name: str):
        self.limits, self.name, self.steps, self.depth = limits, name, 0, 0

    def run(self, check, *args):
        before = sys.gettrace()
        sys.settrace(self.enter)
        try:
            return check(*args)
        finally:
            sys.settrace(before)

    def enter(self, frame, event, arg):
        if frame.f_code.co_filename != self.name:
            return None
        self.depth += 1
        if self.depth > self.limits.depth:
            raise OverBudget(f"more than {self.limits.depth} calls inside one another")
        return self.inside

    def inside(self, frame, event, arg):
        if event == "return":
            self.depth -= 1
        elif event == "line":
            self.steps += 1
            if self.steps > self.limits.steps:
                raise OverBudget(f"more than {self.limits.steps} steps")
            if self.steps % 16 == 0:
                self.measure(frame.f_locals.values())
        return self.inside

    def measure(self, values) -> None:
        for v in values:
            if isinstance(v, (str, bytes)) and len(v) > self.limits.text:
                raise OverBudget(f"a text of more than {self.limits.text} characters")
            if isinstance(v, (list, tuple, set)) and len(v) > self.limits.items:
                raise OverBudget(f"a list of more than {self.limits.items} items")


def outcome(script: Script, check, ast: dict, limits: Limits) -> list[tuple]:
    """The rows of FOUND of one script on one file: its violations, or its error."""
    meter = Meter(limits, script.id)
    try:
        found = meter.run(check, ast, dict(script.params))
        if not isinstance(found, (list, tuple)):
            raise TypeError(f"check returned {type(found).__name__}, not a list")
        meter.measure([found])
        rows = []
        for i, v in enumerate(found):
            end, message = v.get("end_line"), str(v.get("message", "violation"))
            meter.measure([message])
            rows.append((script.id, script.severity, int(v.get("line", 0)), None if end is None else int(end), message, [i], None))
        return rows
    except (Exception, OverBudget) as e:
        return [(script.id, script.severity, None, None, None, None, f"{type(e).__name__}: {e}")]


def table_function(scripts: list[Script], limits: Limits):
    """A table function of (tree): all scripts on one file. Trees are read, and scripts compiled, once."""

    class RunScripts:
        def __init__(self):
            self.checks = []
            for s in scripts:
                try:
                    self.checks.append((s, s.compiled(), None))
                except Exception as e:
                    self.checks.append((s, None, f"{type(e).__name__}: {e}"))

        def eval(self, tree: str):
            for s, check, error in self.checks:
                if check is None:
                    yield s.id, s.severity, None, None, None, None, error
                else:
                    # a script may change its tree; the next one gets a new one
                    yield from outcome(s, check, json.loads(tree), limits)

    return F.udtf(RunScripts, returnType=FOUND)


def run_scripts(parsed: DataFrame, scripts: list[Script], limits: Limits | None = None) -> DataFrame:
    """(file, FOUND): what the scripts find in each parsed file, and where they fail."""
    run = table_function(scripts, limits or Limits())
    return trees(parsed).lateralJoin(run(F.col("tree").outer())).drop("tree")


def violations_of(found: DataFrame) -> DataFrame:
    return found.filter("error is null").select("rule_id", "severity", "file", "line", "end_line", "message", "visit")


def errors_of(found: DataFrame) -> DataFrame:
    """(file, rule_id, error)."""
    return found.filter("error is not null").select("file", "rule_id", "error")
