"""Java files to tables: listing, charset decoding, parsing with a content-addressed cache."""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from ..schemas import PARSED
from .batches import by_slices, slices
from .charsets import decode_source, effective_encoding  # noqa: F401
from .listing import source_files

# Directories never scanned unless other ones are given.
DEFAULT_EXCLUDES = ("target", "build", ".git", "node_modules")
#: What is parsed at once: bytes of text (or one file) and files.
SLICE_BYTES, SLICE_FILES = 256_000, 256
#: Parsed forms kept of texts of up to so many characters.
KEPT_TEXTS, SHORT = 1_024, 1_000
#: Bytes of text that a task parses where files are dealt out.
TASK_BYTES = 1_000_000


def parser_fingerprint() -> str:
    """Names what decides the parsed form of a text: the parser's own source and the schema."""
    from . import java

    return hashlib.sha256(Path(java.__file__).read_bytes() + PARSED.encode()).hexdigest()[:16]


@F.arrow_udf(StringType())
def decode_udf(raw: pa.Array, encoding: pa.Array) -> pa.Array:
    return by_slices(lambda r, e: None if r is None else decode_source(r, e), pa.string(), raw, encoding)


def java_files(spark: SparkSession, root: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, includes: tuple[str, ...] = (), only: list[str] | None = None) -> DataFrame:
    """(file, path, content) of the .java files below `root`, a path or a URI: no directory on the way, `root`
    itself included, has an excluded name, and such directories are not opened; the path contains
    one of `includes` if there are any. With `only`, names below the root, no directory is listed."""
    return source_files(spark, root.rstrip("/") or "/", excludes, includes, only)


def kept_paths(found: DataFrame, top: str, excludes: tuple[str, ...], includes: tuple[str, ...]) -> DataFrame:
    """Rows of `found` (with file, a path below the folder `top`, and path) in no excluded folder,
    whose path contains one of `includes` if there are any."""
    folders = F.slice(F.split(F.concat(F.lit(top + "/"), "file"), "/"), F.lit(1), F.size(F.split("file", "/")))
    kept = found.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, excludes or ("",))))) if excludes else found
    return kept.filter(contains_any(F.col("path"), includes)) if includes else kept


def contains_any(path: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(path, F.lit(p.replace("\\", "/")))
    return out


def parse_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Parsed files, some at a time, as nodes take many times the room of their text. Equal texts among
    these are parsed once; so are short ones that came a little before."""
    from .java import parse_source

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))
    kind = schema.field("nodes").type.value_type
    fields = [kind.field(i) for i in range(kind.num_fields)]
    parse_short = lru_cache(KEPT_TEXTS)(parse_source)
    for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in slices(pc.binary_length(b.column("text")), SLICE_BYTES, SLICE_FILES)):
        known: dict[str, int] = {}
        units, places = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            if text not in known:
                known[text] = len(units)
                unit = parse_short(text) if len(text) <= SHORT else parse_source(text)
                units.append(unit | {"n_lines": text.count("\n") + bool(text and not text.endswith("\n"))})
            places.append(known[text])
        # nodes are built column by column, which is several times faster than row by row
        ends = np.cumsum([0, *(len(u["nodes"]) for u in units)]).astype(np.int32)
        columns = list(zip(*(n for u in units for n in u["nodes"]), strict=True)) or [()] * len(fields)
        nodes = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
        made = {"nodes": pa.ListArray.from_arrays(pa.array(ends), nodes).cast(schema.field("nodes").type)}
        made |= {c: pa.array([u[c] for u in units], schema.field(c).type) for c in ("package", "parse_error", "n_lines", "imports")}
        taken = pa.array(places, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("file") if f.name == "file" else made[f.name].take(taken) for f in schema], schema=schema)


def parse_files(files: DataFrame, encoding: str = "auto", partitions: int | None = None) -> DataFrame:
    """One row per file: package, parse_error, n_lines, imports and nodes. With `partitions` files are dealt out by
    name, as sizes vary, to so many tasks or more: tasks grow in number with the text, not in what they read."""
    schema = to_arrow_schema(StructType.fromDDL(PARSED))
    spread = files
    if partitions:
        size = files.agg(F.sum(F.octet_length("content" if "content" in files.columns else "text"))).first()[0] or 0
        spread = files.repartition(max(partitions, -(-size // TASK_BYTES)), "file")
    text = decode_udf(F.col("content"), F.lit(encoding)) if "content" in files.columns else F.col("text")
    return spread.select("file", text.alias("text")).mapInArrow(lambda batches: parse_batches(batches, schema), PARSED)


def by_content(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, key) of `files` (file, text), and (key, text) of each different text once; a missing text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    keyed = files.select("file", F.sha2(text, 256).alias("key"), text.alias("text"))
    # the text belongs to what is grouped by, so equal ones already fall together where they are read
    return keyed.select("file", "key"), keyed.select("key", "text").distinct()


def parse_cached(files: DataFrame, cache: str, encoding: str = "auto") -> DataFrame:
    """As parse_files, but equal contents are parsed once and kept in Parquet files below `cache`, keyed by
    content and charset, in a folder for each form of the parser.

    Contents that are not there yet are parsed and added; so are those in files that cannot be
    read. Folders of other forms of the parser are renamed, which takes them out at once, and removed.
    """
    spark = files.sparkSession
    here = f"{cache.rstrip('/')}/parser={parser_fingerprint()}"
    # other failures to read than a missing folder or a broken file are errors
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(here).getFileSystem(spark._jsc.hadoopConfiguration())
    schema = StructType.fromDDL(PARSED.replace("file string", "key string", 1))
    entries = lambda: spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(here)
    keyed = files.withColumn("key", F.concat_ws("-", F.sha2("content", 256), F.lit(encoding)))
    missing = keyed.dropDuplicates(["key"]).select(F.col("key").alias("file"), "content")
    if store.exists(path(here)):
        missing = missing.join(entries().select(F.col("key").alias("file")), "file", "left_anti")
    parse_files(missing, encoding).withColumnRenamed("file", "key").write.mode("append").parquet(here)
    for old in [x.getPath() for x in store.listStatus(path(cache)) if x.getPath().getName().startswith("parser=") and x.getPath().getName() != path(here).getName()]:
        gone = path(old.getParent(), f".dropped-{uuid.uuid4().hex}")
        if store.rename(old, gone):
            store.delete(gone, True)
    # two scans may both have added a content
    return keyed.select("file", "key").join(entries().dropDuplicates(["key"]), "key").drop("key")


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.inline("nodes"))


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.posexplode("imports").alias("ord", "i")).select("file", "ord", "i.*")
