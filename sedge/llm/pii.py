"""Personal data by bootstrapped contextual extraction.

Emails, IP addresses, cards and phone numbers that regular expressions find are the seeds, and so are
digests of 40 hexadecimal digits, as seeds of secrets (which are found only where a context tells). The
words around them are lexical patterns; so are those around other identifier-like strings, the
candidates. Patterns and instances form a graph that Spark scores in rounds: a pattern is as good as
the share of its instances that are seeds or well-scored candidates of one kind, a candidate as
good as its best pattern. Patterns of high confidence then extract the candidates in them.

Only text functions of Spark touch the texts. The graph holds distinct (pattern, instance) pairs, so
copies of a document add nothing to it, and sums per pattern are combined before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_stats, quoted, staged

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Values of secrets to start from.
SECRET_SEED = "^[0-9a-f]{40}$"

# The patterns of the contract. Runs are possessive, and a match starts at a run's start or where
# the last match ended, which finds the same matches without reading a long run again and again.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    # chains of digits with single separators, those of 13 to 19 digits only
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these characters has no match of the kind.
GATE = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Identifier-like strings that are not base matches, with the kinds each may be.
CANDIDATES = {
    "number": (r"(?<![0-9A-Za-z+._-])[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])", ("card", "phone")),
    "address": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+[\x20]?(?:\(at\)|\[at\]|@)[\x20]?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+", ("email",)),
    "mixed": (r"(?<![0-9A-Za-z_+/-])(?=[A-Za-z_+/-]{0,127}+[0-9])[0-9A-Za-z_+/-]{16,128}+(?![0-9A-Za-z_+/-])", ("secret",)),
    "hextets": (r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}+(?![0-9A-Fa-f:])", ("ip",)),
}


def running_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array, in blocks so that long arrays are not copied at every step."""

    def plain(xs: Column) -> Column:
        zero = F.array().cast("array<long>")
        return F.aggregate(xs, zero, lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    inner = F.transform(blocks, plain)
    before = plain(F.concat(F.array(F.lit(0).cast("long")), F.transform(inner, lambda xs: F.try_element_at(xs, F.lit(-1)))))
    shifted = F.zip_with(inner, F.slice(before, F.lit(1), F.size(inner)), lambda xs, o: F.transform(xs, lambda x: x + o))
    return F.when(F.size(values) == 0, F.array().cast("array<long>")).otherwise(F.flatten(shifted))


PLACE = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds, for each name of `patterns` (a regular expression, and a string without which a text
    has no match), an array of (start, end, value, before, after): places in code points, end
    exclusive; before and after are up to 60 characters around, within the neighbouring matches."""
    none = F.array().cast("array<string>")
    some = {k: F.size(f"_m_{k}") > 0 for k in patterns}

    def all_matches(regex: str, gate: str) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0))
        return F.when(F.contains(F.col(text), F.lit(gate)), found).otherwise(none) if gate else found

    def place(k: str) -> Column:
        return F.transform(
            F.arrays_zip(F.col(f"_m_{k}").alias("m"), F.col(f"_e_{k}").alias("e"), F.col(f"_b_{k}").alias("b"), F.col(f"_a_{k}").alias("a")),
            lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), z["m"].alias("value"), z["b"].alias("before"), z["a"].alias("after")),
        )

    df = df.withColumns({f"_m_{k}": all_matches(*v) for k, v in patterns.items()})
    df = df.withColumns({f"_p_{k}": F.when(some[k], F.split(F.col(text), v[0], -1)) for k, v in patterns.items()})
    size = {k: F.size(f"_m_{k}") for k in patterns}
    lengths = {f"_l_{k}": F.zip_with(f"_m_{k}", F.slice(f"_p_{k}", F.lit(1), size[k]), lambda m, p: (F.length(m) + F.length(p)).cast("long")) for k in patterns}
    before = {f"_b_{k}": F.transform(F.slice(f"_p_{k}", F.lit(1), size[k]), lambda p: F.right(p, F.lit(60))) for k in patterns}
    after = {f"_a_{k}": F.transform(F.slice(f"_p_{k}", F.lit(2), size[k]), lambda p: F.left(p, F.lit(60))) for k in patterns}
    df = df.withColumns({n: F.when(F.col(f"_p_{n[3:]}").isNotNull(), c) for n, c in (lengths | before | after).items()})
    df = df.withColumns({f"_e_{k}": F.when(some[k], running_sums(F.col(f"_l_{k}"))) for k in patterns})
    df = df.withColumns({k: F.when(some[k], place(k)).otherwise(F.array().cast(PLACE)) for k in patterns})
    return df.drop(*[f"_{x}_{k}" for x in "mplbae" for k in patterns])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass the Luhn test."""
    ds = F.transform(F.split(F.reverse(digits(value)), ""), lambda c: c.cast("int"))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def validity(kind: str):
    return lambda m: valid(kind, m["value"])


def is_kind(kind: str):
    return lambda m: m["kind"] == kind


def spans_of(kind: str) -> Column:
    return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds one array of matches per kind, valid ones only."""
    df = with_matches(df, text, {k: (BASE[k], GATE[k]) for k in KINDS})
    return df.withColumns({k: F.filter(k, validity(k)) for k in KINDS if k != "email"})


def with_candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds `candidates`: matches of the looser patterns that overlap no base match, with their kinds."""
    df = with_matches(df, text, {f"_c_{name}": (pattern, ":" if name == "hextets" else "") for name, (pattern, _) in CANDIDATES.items()})

    def apart(c: Column) -> Column:
        return reduce(lambda x, y: x & y, [~F.exists(k, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) for k in KINDS])

    def labelled(name: str, kinds: tuple[str, ...]) -> Column:
        may_be = F.array(*map(F.lit, kinds))
        return F.transform(F.filter(f"_c_{name}", apart), lambda c: F.struct(*[c[x].alias(x) for x in ("start", "end", "value", "before", "after")], may_be.alias("kinds")))

    made = F.concat(*[labelled(name, kinds) for name, (_, kinds) in CANDIDATES.items()])
    return df.withColumn("candidates", made).drop(*[f"_c_{name}" for name in CANDIDATES])


def patterns_around(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: the word before with the one before it, with the word after, and alone."""
    words = lambda t: F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}:=#&]+"), lambda w: w != "")
    left, right = words(before), words(after)
    one, two, next_ = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.try_element_at(right, F.lit(1))
    made = F.array(F.concat(F.lit("2 "), two, F.lit(" "), one), F.concat(F.lit("b "), one, F.lit(" _ "), next_), F.concat(F.lit("1 "), one))
    return F.array_compact(made)


def graph_of(found: DataFrame) -> DataFrame:
    """(pattern, value, kind, seed), each once: kind of a seed, or each kind a candidate may be."""
    rows = []
    for kind in KINDS:
        one = found.filter(F.size(kind) > 0).select(F.explode(kind).alias("o"))
        rows.append(one.select("o.value", "o.before", "o.after", F.lit(kind).alias("kind"), F.lit(True).alias("seed")))
    one = found.filter(F.size("candidates") > 0).select(F.explode("candidates").alias("o"))
    rows.append(one.select("o.value", "o.before", "o.after", F.explode("o.kinds").alias("kind")).withColumn("seed", (F.col("kind") == "secret") & F.col("value").rlike(SECRET_SEED)))
    all_ = reduce(DataFrame.unionByName, rows)
    return all_.select(F.explode(patterns_around(F.col("before"), F.col("after"))).alias("pattern"), F.lower("value").alias("value"), "kind", "seed").groupBy("pattern", "value", "kind").agg(F.max("seed").alias("seed"))


def trusted_patterns(graph: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 10) -> DataFrame:
    """(pattern, kind, conf) of the patterns to extract by.

    conf is the score of the pattern's instances of the kind over the number of all its instances
    plus one; a trusted one has `support` different seeds at least, or, of a kind with few seeds, one in
    twenty of them (4 at least). Scores travel from patterns to candidates and back `rounds` times.
    """
    graph = staged(graph)
    totals = graph.groupBy("pattern").agg(F.count_distinct("value").alias("n"))
    known = graph.filter("seed").groupBy("kind").agg(F.count_distinct("value").alias("all"))  # a row per kind
    least = F.least(F.lit(support), F.greatest(F.lit(4), F.ceil(F.col("all") / 20)))
    seeds = graph.filter("seed").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).join(F.broadcast(known), "kind").filter(F.col("seeds") >= least).drop("all")
    base = staged(seeds.join(totals, "pattern"))
    # only candidates that stand in a supported pattern can gain a score
    open_ = staged(graph.filter("not seed").select("pattern", "kind", "value").join(base.select("pattern", "kind"), ["pattern", "kind"], "left_semi"))
    conf = base.select("pattern", "kind", (F.col("seeds") / (F.col("n") + 1)).alias("conf"))
    for _ in range(rounds):
        scores = open_.join(conf, ["pattern", "kind"]).groupBy("kind", "value").agg(F.max("conf").alias("score"))
        gained = open_.join(scores, ["kind", "value"]).groupBy("pattern", "kind").agg(F.sum(F.round("score", 6)).alias("gain"))
        conf = staged(
            base.join(gained, ["pattern", "kind"], "left").select("pattern", "kind", ((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("n") + 1)).alias("conf"))
        )
    return conf.filter(F.col("conf") >= confidence)


SPAN = "struct<kind:string,start:bigint,end:bigint>"


def find_personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), confidence: float = 0.8, support: int = 10) -> DataFrame:
    """`keep` plus `base` and `extra`: arrays of (kind, start, end), by kind as listed, then start.

    Positions count code points, end exclusive. `base` are the patterns' matches, `extra` what the
    learned contexts add; the two never overlap. Null and empty texts have none. Every row is
    read on its own: repeated rows get equal spans. An empty table gives no rows. `docs` may have
    columns named like the kinds or helpers if they are not in `keep`; those in `keep` come back as
    they are.
    """
    return with_spans(docs, keep, confidence, support).select("_own.*", "base", "extra")


def with_spans(docs: DataFrame, keep: tuple[str, ...], confidence: float = 0.8, support: int = 10) -> DataFrame:
    """The rows of `find_personal_data`, with `keep` as one struct `_own`."""
    own = docs.select(F.struct(*map(quoted, keep)).alias("_own"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    found = with_candidates(with_base(own, "_text"), "_text").drop("_text")
    found = staged(found.withColumn("_row", F.monotonically_increasing_id()))
    trusted = trusted_patterns(graph_of(found), confidence=confidence, support=support)
    places = found.filter(F.size("candidates") > 0).select("_row", F.explode("candidates").alias("c"))
    places = (
        places.select("_row", "c.start", "c.end", "c.kinds", F.explode(patterns_around(F.col("c.before"), F.col("c.after"))).alias("pattern"))
        .withColumn("kind", F.explode("kinds"))
        .withColumn("key", F.concat_ws(" ", "kind", "pattern"))
        .drop("kinds", "pattern")
    )
    judged = join_stats(places, trusted.select(F.concat_ws(" ", "kind", "pattern").alias("key"), "conf"), "key", "_row").filter("conf is not null")
    rank = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind"))
    best = judged.groupBy("_row", "start", "end").agg(F.max_by("kind", F.struct("conf", -rank)).alias("kind"))
    # spans of one document that overlap (two readings of one place): the first, longest one stays
    listed = best.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "kind"))).alias("s"))
    clear = F.aggregate(
        "s",
        F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct((-x["back"]).alias("at"), F.concat(s["spans"], F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end")))).alias("spans")),
        ).otherwise(s),
        lambda s: s["spans"],
    )
    extra = listed.select("_row", clear.alias("extra"))
    base = F.concat(*map(spans_of, KINDS))
    joined = join_stats(found.select("_row", "_own", base.alias("base")), extra, "_row", "_row")
    return joined.select("_own", "base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>")).alias("extra"))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed (secrets last), then start."""
    kinds = F.array(*map(F.lit, ALL_KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap share one replacement."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(s: Column, x: Column) -> Column:
        part = F.array(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["parts"], part)).otherwise(s["parts"]).alias("parts"))

    built = F.aggregate(order, zero, add, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, built).otherwise(text)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """`docs` with all personal data found in `text` masked; other columns and rows stay, whatever
    their names. An empty table stays empty."""
    found = with_spans(docs, tuple(docs.columns))
    hidden = masked(F.col("_own.text"), F.concat("base", "extra"))
    return found.select(*[hidden.alias(c) if c == "text" else F.col(f"_own.{quoted(c)}") for c in docs.columns])
