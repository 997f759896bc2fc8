"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a fresh
    temporary folder kept for the session, on one machine only (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sedge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage is cut, and losing an
    executor costs no recomputation. The shuffle files behind it go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text (maximal runs without white space); null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed != "", F.split(trimmed, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) that the parts decide, the same in every run and engine."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def boxed(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row as one struct `_row`, beside `columns` of it, so that no helper's name can clash."""
    return rows.select(F.struct(*[F.col(quoted(c)) for c in rows.columns]).alias("_row"), *[F.col(quoted(c)) for c in columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bounded(rows: DataFrame, count: int, most: int = 100_000) -> DataFrame:
    """`rows` (so many at most) for one side of a join: beyond `most` of them neither side is broadcast. Spark sizes
    a table by its files, and numbers that repeat take few bytes there but many in the driver."""
    return rows.hint("merge") if count > most else rows


def join_stats(rows: DataFrame, stats: DataFrame, key: str | list[str], salt_by: str | list[str], most: int = 100_000, salts: int = 64) -> DataFrame:
    """Left join of `rows` to `stats` (one row per key; null keys find nothing).

    `stats` is broadcast only when it is counted and has at most `most` rows; otherwise each key
    is spread over `salts` copies, so that a key with a third of all rows meets many tasks. The copies are
    merged, as Spark sizes them by the files of `stats` and would broadcast `salts` times as many rows.
    """
    stats = staged(stats)
    if stats.count() <= most:
        return rows.join(F.broadcast(stats), key, "left")
    salted = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.xxhash64(*([salt_by] if isinstance(salt_by, str) else salt_by))
    rows = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    return rows.join(salted.hint("merge"), [*([key] if isinstance(key, str) else key), "_salt"], "left").drop("_salt")
