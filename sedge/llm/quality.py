"""Quality rules with risk-controlled thresholds.

Each rule rejects a document when a measure exceeds a cutoff. For each stratum the labelled good
documents are the holdout; a cutoff is certified when the exact binomial probability of seeing
so few of them rejected, were the true false-rejection rate `alpha`, is small. Cutoffs are fixed
in advance and tested from the loosest down, stopping at the first that fails (fixed-sequence
testing), and strata and rules share the error by Bonferroni, so with probability 1 - delta no
rule in any stratum rejects more than `alpha` of the good documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_stats, staged, words_of

SYMBOLS = "[#*$%&|<>]"

#: Cutoffs per measure, loosest first; a document is rejected when its measure is above.
CUTOFFS = {
    "symbol_share": [1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "repeat_share": [0.48, 0.46, 0.44, 0.42, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "word_length": [40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0],
}


def base_measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and
    n_lines (lines with a word), over whole texts; a null text has none of anything."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*keep, text.alias("_text"), words_of(F.col("text")).alias("_words"))
    step = step.withColumn("_lines", lines_of("_text"))
    grams = F.transform("_words", lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p")))
    step = step.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.slice(grams, F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0)))).alias("_grams"),
    )
    # a window's hash stands for its three words: two windows of a text collide once in 2^64
    twice = F.filter("_grams", lambda g, i: F.coalesce(g.h == F.get("_grams", i - 1).h, F.lit(False)) | F.coalesce(g.h == F.get("_grams", i + 1).h, F.lit(False)))
    step = step.select(*[c for c in step.columns if c != "_grams"], F.sort_array(F.transform(twice, lambda g: g.p)).alias("_at"))
    gaps = F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return step.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)).drop("_at")


def lines_of(text: str) -> Column:
    return F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def with_shares(measures: DataFrame) -> DataFrame:
    """The measures that the rules cut, as doubles; 0 where a document has no words."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return measures.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "word_length": share("word_chars", "n_words"),
        }
    )


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= k), exact but for terms below e^-400 of the largest.

    Terms are summed within 60 standard deviations of the mean, or up from as far below k when k is
    below the mean; a k further above leaves the probability at 1. log C(n, k) is a running sum of
    logs, so nothing overflows.
    """
    odds = F.lit(float(p / (1 - p)))
    wide = 60 * F.sqrt(n * p + 1)
    k = F.least(k, F.ceil(n * p + wide))
    first = F.greatest(F.lit(0), (F.least(k, F.floor(n * p)) - F.ceil(wide)).cast("int"))
    start = F.aggregate(
        F.sequence(F.lit(0), first),
        n * F.log(F.lit(1 - p)),
        lambda s, i: F.when(i > 0, s + F.log((n - i + 1) / i * odds)).otherwise(s),
    )
    zero = F.struct(start.alias("term"), start.alias("total"))

    def add(s, i):
        term = F.when(i > first, s.term + F.log((n - i + 1) / i * odds)).otherwise(s.term)
        top = F.greatest(s.total, term)
        total = F.when(i > first, top + F.log(F.exp(s.total - top) + F.exp(term - top))).otherwise(s.total)
        return F.struct(term.alias("term"), total.alias("total"))

    return F.aggregate(F.sequence(first, k.cast("int")), zero, add, lambda s: s.total)


def certified_cutoffs(labelled: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """(stratum, one column per measure: its cutoff, or null where none is certified).

    `labelled` has stratum, the measures and quality (1 good, 0 bad; null: unlabelled, ignored). A
    certified cutoff must also reject a larger share of the bad documents than of the good ones.
    Only counts per stratum, rule and cutoff leave the scan: one row per stratum, whatever the size.
    """
    names = [(m, j) for m, cuts in CUTOFFS.items() for j in range(len(cuts))]
    over = lambda m, j, q: F.sum(((F.col("quality") == q) & (F.col(m) > CUTOFFS[m][j])).cast("long"))
    counts = (
        labelled.filter("quality in (0, 1)")
        .groupBy("stratum")
        .agg(
            F.sum((F.col("quality") == 1).cast("long")).alias("n_good"),
            F.sum((F.col("quality") == 0).cast("long")).alias("n_bad"),
            F.array(*[F.struct(F.lit(m).alias("rule"), F.lit(j).alias("step"), F.lit(CUTOFFS[m][j]).alias("cutoff"), over(m, j, 1).alias("good"), over(m, j, 0).alias("bad")) for m, j in names]).alias("tests"),
        )
        .withColumn("strata", F.count("*").over(Window.partitionBy()))
    )
    tests = counts.select("stratum", "n_good", "n_bad", "strata", F.explode("tests").alias("t")).select("stratum", "n_good", "n_bad", "strata", "t.*")
    limit = F.log(F.lit(delta) / (F.col("strata") * len(CUTOFFS)))
    passes = (F.col("n_good") > 0) & (log_binomial_tail(F.col("n_good"), F.col("good"), alpha) <= limit)
    down = Window.partitionBy("stratum", "rule").orderBy("step")
    tests = tests.withColumn("ok", F.min(F.when(passes, 1).otherwise(0)).over(down)).withColumn(
        "useful", F.col("bad") * F.col("n_good") > F.col("good") * F.col("n_bad")
    )
    best = tests.filter("ok = 1 and useful").groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.min("cutoff"))
    return counts.select("stratum").join(best.select("stratum", *[F.col(m).alias(f"cut_{m}") for m in CUTOFFS]), "stratum", "left")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, the base measures, base_failed and kept, one row per document.

    Documents fail the base when they have under 50 words or more than half of their words in
    repeated windows; the others are kept unless a certified cutoff of their stratum rejects them.
    A null stratum is one of its own; without labels, or with too few to certify anything, only
    the base decides. Labels repeated for a document count once (the lowest quality); null labels
    are ignored. Empty tables give empty results.
    """
    # one pass over the texts: labels are joined to the narrow table of measures
    own = ["doc_id", *[c for c in keep if c != "doc_id"]]
    source = docs.withColumn("_stratum", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    measured = staged(with_shares(base_measures(source, [*own, "_stratum"])))
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = measured.join(marks, "doc_id").select(F.col("_stratum").alias("stratum"), *CUTOFFS, "quality")
    cutoffs = certified_cutoffs(labelled, alpha, delta).withColumnRenamed("stratum", "_stratum")
    judged = join_stats(measured, cutoffs, "_stratum", "doc_id")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.lit(False)
    for m in CUTOFFS:
        rejected = rejected | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    return judged.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", *[f"cut_{m}" for m in CUTOFFS])
