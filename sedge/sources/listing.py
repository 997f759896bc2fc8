"""Source files as a data source: `spark.read.format("source_files")`.

The planner walks folder by folder and never opens an excluded one; what it finds is dealt to
partitions by bytes. Tasks open the files, through the same file system: local paths, and whatever
Arrow knows by URI (hdfs://, s3://, gs://).
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .charsets import decode_source

NAME = "source_files"
RAW = "file string, path string, content binary"
DECODED = "file string, path string, text string"
#: Bytes of files that a partition holds, and what opening one counts.
PARTITION_BYTES, OPEN_BYTES = 32_000_000, 100_000
#: Bytes that a task hands on at once, at least one whole file.
BATCH_BYTES = 8_000_000


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), posixpath.normpath(root.removeprefix("file:"))


@dataclass
class Files(InputPartition):
    """Names below the root; one object per task."""

    names: list[str]


class FilesReader(DataSourceReader):
    """Options: path; suffix (.java); excludes and includes (JSON lists); only (JSON list: names below the root, no
    folder is listed then); encoding (texts instead of bytes); partitionBytes."""

    def __init__(self, options: dict, found: tuple[fs.FileSystem, str] | None = None):
        self.fs, self.root = found or opened(options["path"])
        self.suffix = options.get("suffix", ".java")
        self.excludes = set(json.loads(options.get("excludes", "[]")))
        self.includes = [p.replace("\\", "/") for p in json.loads(options.get("includes", "[]"))]
        self.only = json.loads(options["only"]) if "only" in options else None
        self.encoding = options.get("encoding")
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def wanted(self, name: str) -> bool:
        return name.endswith(self.suffix) and (not self.includes or any(p in f"{self.root}/{name}" for p in self.includes))

    def listed(self) -> Iterator[tuple[str, int]]:
        """(name below the root, bytes) of the files, by name within a folder; no folder on the way, the root itself
        included, has an excluded name."""
        if posixpath.basename(self.root) in self.excludes:
            return
        if self.only is not None:
            names = [n for n in self.only if self.wanted(n) and not self.excludes & set(n.split("/")[:-1])]
            for name, info in zip(names, self.fs.get_file_info([f"{self.root}/{n}" for n in names]) if names else [], strict=True):
                if info.type == fs.FileType.File:
                    yield name, info.size
            return
        if self.fs.get_file_info(self.root).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        folders = [""]
        while folders:
            folder = folders.pop()
            inside = sorted(self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}".rstrip("/"))), key=lambda i: i.base_name)
            for info in inside:
                name = f"{folder}{info.base_name}"
                if info.type == fs.FileType.Directory and info.base_name not in self.excludes:
                    folders.append(f"{name}/")
                elif info.type == fs.FileType.File and self.wanted(name):
                    yield name, info.size

    def partitions(self) -> list[Files]:
        parts, size = [Files([])], 0
        for name, n in self.listed():
            if size and size + n + OPEN_BYTES > self.most:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append(name)
            size += n + OPEN_BYTES
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for name in partition.names:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                raw = f.read()
            held.append((name, f"{self.root}/{name}", raw if self.encoding is None else decode_source(raw, self.encoding)))
            size += len(raw)
            if size >= BATCH_BYTES:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        last = ("content", pa.binary()) if self.encoding is None else ("text", pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), last[1]), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["file", "path", last[0]])


class SourceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return DECODED if self.options.get("encoding") else RAW

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(dict(self.options))


def source_files(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), includes: tuple[str, ...] = (), only: list[str] | None = None, encoding: str | None = None):
    """(file, path, content) of the files below `root`; (file, path, text) with an encoding."""
    spark.dataSource.register(SourceFiles)
    reader = spark.read.format(NAME).option("excludes", json.dumps(list(excludes))).option("includes", json.dumps(list(includes)))
    if only is not None:
        reader = reader.option("only", json.dumps(only))
    return (reader.option("encoding", encoding) if encoding else reader).load(root)
