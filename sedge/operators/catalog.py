"""Rules as rows: what is wrong with them, and the entries of a catalog laid over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITIES, sev_rank
from .patterns import KEYS


def problems(pattern: Column, keys: Column, severity: Column) -> Column:
    """An array of what `PatternRule.problems` says of a rule: an unknown severity, an unknown kind of
    pattern, keys that the kind does not have."""
    quoted = lambda what, c: F.concat(F.lit(f"{what} '"), c, F.lit("'"))
    known = F.create_map(*[x for kind, names in sorted(KEYS.items()) for x in (F.lit(kind), F.array(*map(F.lit, sorted(names))))])[pattern]
    unknown = F.transform(F.filter(keys, lambda k: ~F.array_contains(known, k)), lambda k: quoted("unknown key", k))
    kind = F.when(known.isNull(), F.array(quoted("unknown pattern type", pattern))).otherwise(unknown)
    return F.concat(F.when(sev_rank(severity).isNull(), F.array(quoted("unknown severity", severity))).otherwise(F.array().cast("array<string>")), kind)


def overridden(rules: DataFrame, entries: DataFrame) -> DataFrame:
    """`rules` (id, title, severity, enabled, builtin) with the `entries` of a catalog (id, title, severity, enabled; ids
    distinct) laid over them. A rule without an entry stays as it is. Of a built-in rule title and an unknown
    severity are not taken; of others an unknown severity reads as minor."""
    e = entries.select("id", F.col("title").alias("_title"), F.lower(F.trim("severity")).alias("_severity"), F.col("enabled").alias("_enabled"), F.lit(True).alias("_there"))
    known = F.col("_severity").isin(*SEVERITIES)
    severity = F.when(known, F.col("_severity")).when(F.col("_there") & ~F.col("builtin"), "minor").otherwise(F.col("severity"))
    title = F.when(F.col("_there") & ~F.col("builtin"), F.col("_title")).otherwise(F.col("title"))
    return rules.join(e, "id", "left").select("id", title.alias("title"), severity.alias("severity"), F.coalesce("_enabled", "enabled").alias("enabled"), "builtin")
