"""A source for folders of Markdown files with front matter: spark.read.format("markdown").load(folder), after register().

Each file is a row: its path, the front matter's fields that the schema asks for, as strings, and ``body``, what stands below it. Files are dealt into
partitions by their bytes. Only the columns of a given schema are read: without body, a file is read no further than its
front matter. Equality and IN on front matter fields and paths are pushed down, so that files which don't fit aren't read on.

Files are reached through pyarrow's file systems (local, HDFS, object stores), not through Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StringType, StructType

#: The fields of a report's front matter.
FIELDS = ["topic", "goal_type", "date", "review_status", "english_title"]
#: Bytes of a partition, and of a file that are read for its front matter first.
PARTITION_BYTES, HEAD_BYTES = 64 * 2**20, 4096
NAME = "markdown"


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters be pushed to it (a setting of the session)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MarkdownSource)


def front_matter(text: str) -> tuple[dict[str, str], str] | None:
    """(fields, body) of a whole file; a file without front matter has no fields. None if the text ends inside the front matter."""
    text = text.removeprefix("﻿")
    if not re.match(r"---[ \t]*\r?\n", text):
        return {}, text
    parts = re.split(r"(?m)^---[ \t]*\r?$\n?", text, maxsplit=2)
    if len(parts) < 3:
        return None
    fields = dict(re.findall(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*?)[ \t]*\r?$", parts[1]))
    return fields, parts[2]


@dataclass
class Files(InputPartition):
    paths: list[str]


class MarkdownSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in ["path", *FIELDS, "body"])

    def reader(self, schema: StructType) -> DataSourceReader:
        wrong = [f.name for f in schema if not isinstance(f.dataType, StringType)]
        if wrong:
            raise ValueError(f"columns of Markdown files are strings, not so: {', '.join(wrong)}")
        return MarkdownReader(self.options, [f.name for f in schema])


class MarkdownReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.root, self.columns = options["path"], columns
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.allowed: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and IN on all but the body; the rest is left to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in (None, "body"):
                yield f
            else:
                self.allowed.append((name, (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _opened(self.root)
        found = sorted((i.path, i.size or 0) for i in fs.get_file_info(FileSelector(root, recursive=True)) if i.type == FileType.File and i.path.endswith(".md"))
        wanted = [set(v) for n, v in self.allowed if n == "path"]
        out, size = [Files([])], 0
        for path, n in found:
            if not all(path in w for w in wanted):
                continue
            if out[-1].paths and size + n > self.bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = _opened(self.root)
        for path in partition.paths:
            with fs.open_input_stream(path) as file:
                raw = file.read(HEAD_BYTES)
                head = front_matter(raw.decode("utf-8", "replace")) if len(raw) == HEAD_BYTES else None
                if head is None or "body" in self.columns and self._fits(path, head[0]):
                    raw += file.read()
                    head = front_matter(raw.decode("utf-8", "replace")) or ({}, raw.decode("utf-8", "replace"))
            if self._fits(path, head[0]):
                row = {**head[0], "path": path, "body": head[1]}
                yield tuple(row.get(c) for c in self.columns)

    def _fits(self, path: str, fields: dict[str, str]) -> bool:
        return all((path if name == "path" else fields.get(name)) in values for name, values in self.allowed)


def _opened(root: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" not in root and not root.startswith("file:"):
        return LocalFileSystem(), root
    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
