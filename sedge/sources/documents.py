"""Texts that tasks write in order and a commit turns into one document: `df.write.format("document")`.

The data frame has one column of text, a row per item, sorted by whoever writes it. Each task writes
its items to a fragment of its own. The commit adds a head, a tail and the separators between
fragments that hold items; no row passes the driver. The document is the folder's files one after
the other in the order of their names, or, with `single`, one file that the commit joins from them.
A failed or repeated task leaves nothing, as only committed fragments get their names.
"""

from __future__ import annotations

import posixpath
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .listing import opened

NAME = "document"


@dataclass
class Fragment(WriterCommitMessage):
    partition: int
    file: str
    items: int


class DocumentWriter(DataSourceWriter):
    """Options: path; head, separator and tail; single (true or false)."""

    def __init__(self, options: dict, overwrite: bool):
        self.fs, self.path = opened(options["path"])
        self.head, self.separator, self.tail = (options.get(k, "") for k in ("head", "separator", "tail"))
        self.single = options.get("single", "false") == "true"
        self.overwrite = overwrite
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Fragment:
        """Each row is an item; the separator stands between items of the fragment."""
        partition, items, name = TaskContext.get().partitionId(), 0, f"{self.folder}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder, recursive=True)
        with self.fs.open_output_stream(name) as out:
            for row in rows:
                out.write(((self.separator if items else "") + row[0]).encode())
                items += 1
        return Fragment(partition, name, items)

    def commit(self, messages: list[Fragment | None]) -> None:
        there = self.fs.get_file_info(self.path).type
        if there != fs.FileType.NotFound and not self.overwrite:
            raise FileExistsError(self.path)
        self.fs.create_dir(self.folder, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.items), key=lambda m: m.partition)
        names = [self.small("00000000-head", self.head)]
        for i, m in enumerate(parts):
            if i:
                names.append(self.small(f"{i + 1:08d}-0-between", self.separator))
            names.append(f"{self.folder}/{i + 1:08d}-1-items")
            self.fs.move(m.file, names[-1])
        names.append(self.small("99999999-tail", self.tail))
        for m in messages:
            if m is not None and not m.items:
                self.fs.delete_file(m.file)
        if there != fs.FileType.NotFound:
            (self.fs.delete_dir if there == fs.FileType.Directory else self.fs.delete_file)(self.path)
        if not self.single:
            self.fs.move(self.folder, self.path)
            return
        with self.fs.open_output_stream(f"{self.folder}/document") as out:
            for name in names:
                with self.fs.open_input_stream(name) as part:
                    shutil.copyfileobj(part, out, 1 << 20)
        self.fs.move(f"{self.folder}/document", self.path)
        self.fs.delete_dir(self.folder)

    def small(self, name: str, text: str) -> str:
        with self.fs.open_output_stream(f"{self.folder}/{name}") as out:
            out.write(text.encode())
        return f"{self.folder}/{name}"

    def abort(self, messages: list[Fragment | None]) -> None:
        if self.fs.get_file_info(self.folder).type == fs.FileType.Directory:
            self.fs.delete_dir(self.folder)


class Document(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), overwrite)


def write_document(items: DataFrame, path: str, head: str = "", separator: str = "\n", tail: str = "", single: bool = True) -> None:
    """The one text column of `items`, in its order, as a document at `path`, which is replaced."""
    items.sparkSession.dataSource.register(Document)
    path = path if "://" in path else posixpath.abspath(path) if hasattr(posixpath, "abspath") else path
    options = {"head": head, "separator": separator, "tail": tail, "single": str(single).lower()}
    items.write.format(NAME).options(**options).mode("overwrite").save(path)
