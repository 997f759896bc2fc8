"""Predicates and text functions of rules and reports, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def compiles(pattern: str) -> bool:
    """Whether a pattern is a regular expression without look-around or back-references."""
    if re.search(r"\(\?[=!<](?![A-Za-z])|\\[1-9]", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def java_regex(pattern: str) -> str:
    """The pattern with an unescaped $ as the very end of the text."""
    return re.sub(r"(\\.|\[(?:\\.|[^\]])*\])|\$", lambda m: m[1] or r"\z", pattern, flags=re.S)


def glob_match(pattern: str, value: Column) -> Column:
    """Equality without *; otherwise . is literal, * any run, and the rest stays a regular expression."""
    if "*" not in pattern:
        return value == F.lit(pattern)
    parts = pattern.split("*")
    if not re.search(r"[?(){}^$|+\[\]\\]", pattern):  # forms that push down to files
        if len(parts) == 2 and not parts[1]:
            return value.startswith(parts[0])
        if len(parts) == 2 and not parts[0]:
            return value.endswith(parts[1])
        if len(parts) == 3 and not parts[0] and not parts[2]:
            return value.contains(parts[1])
    regex = pattern.replace(".", r"\.").replace("*", ".*")
    if not compiles(regex):
        return value == F.lit(pattern)
    return value.rlike("^" + java_regex(regex) + r"\z")


def pattern_match(pattern: str, value: Column) -> Column:
    """"*" matches all; a pattern that starts with ^, ends with $ or holds [ + | \\ is searched for
    as a regular expression if it is one; else it is a glob. Null compares as empty."""
    value = F.coalesce(value, F.lit(""))
    if pattern == "*":
        return F.lit(True)
    if (pattern.startswith("^") or pattern.endswith("$") or any(c in pattern for c in "[+|\\")) and compiles(pattern):
        return value.rlike(java_regex(pattern))
    return glob_match(pattern, value)


def value_match(wanted: str | list[str], value: Column) -> Column:
    """Any of the patterns; plain strings become one IN."""
    wanted = [wanted] if isinstance(wanted, str) else wanted
    plain = [w for w in wanted if not any(c in w for c in "*[+|\\") and not w.startswith("^") and not w.endswith("$")]
    tests = [F.coalesce(value, F.lit("")).isin(plain)] if plain else []
    tests += [pattern_match(w, value) for w in wanted if w not in plain]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def modifier_match(wanted: str | list[str], modifiers: Column) -> Column:
    return F.exists(modifiers, lambda m: value_match(wanted, m))


def flag_match(wanted: str | list[str], flag: Column) -> Column:
    """A boolean field: true is wanted if the first value reads true in any case."""
    first = wanted if isinstance(wanted, str) else (wanted or [""])[0]
    return flag == F.lit(first.lower() == "true")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def message(template: str, captured: dict[str, Column]) -> Column:
    """The template with {key} replaced, one key after the other; unknown ones stay."""
    return reduce(lambda text, kv: F.replace(text, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), captured.items(), F.lit(template))


def strip_generics(type_name: Column) -> Column:
    return F.substring_index(type_name, "<", 1)


#: Parameter types that say nothing of a request's fields.
LOOSE_MAPS = ("Map", "HashMap", "LinkedHashMap", "TreeMap", "ConcurrentHashMap", "java.util.Map", "java.util.HashMap", "java.util.LinkedHashMap", "java.util.TreeMap", "java.util.concurrent.ConcurrentHashMap")


def is_loose_map(type_name: Column) -> Column:
    return strip_generics(type_name).isin(*LOOSE_MAPS)


def has_annotation(annotations: Column, *suffixes: str) -> Column:
    return F.exists(annotations, lambda a: reduce(lambda x, y: x | y, [a["name"].endswith(s) for s in suffixes]))


def csv_escape(value: Column) -> Column:
    return F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def rfc3339(at: Column) -> Column:
    """A timestamp as UTC text, with nine digits after the second if it has a fraction."""
    fraction = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", F.lit("Z")).otherwise(F.concat(F.lit("."), fraction, F.lit("000Z"))))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "major"), "error").when(severity == "minor", "warning").otherwise("note")


def location(line: Column, end_line: Column) -> Column:
    return F.concat(F.lit(":"), line.cast("string"), F.when(end_line > line, F.concat(F.lit("-"), end_line.cast("string"))).otherwise(""))


def parse_flag(text: str) -> bool:
    if text.strip().lower() in ("true", "yes", "on", "1"):
        return True
    if text.strip().lower() in ("false", "no", "off", "0"):
        return False
    raise ValueError(f"not a flag: {text!r}")


def param_value(text: str) -> int | float | bool | str:
    """A rule parameter: a whole number, a number, a flag or text."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text, text)


