"""A folder tree as a table: spark.read.format("tree").load(root), one row for each file, folder, link and other entry.

The tree is listed by tasks: the driver lists folders from the top only until there are enough of them, each is a partition then.
Links are reported with their targets and never followed.  The root must be visible to the driver and all executors under the
same path.

Options bound the walk itself: maxDepth (entries directly below the root have depth 1), kind, partitions (folders wanted before
tasks take over).  They are options, not pushed filters: Spark keeps what one query has pushed for later ones of the same table.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, parent string, depth int, kind string, size bigint, modified timestamp, accessed timestamp, changed timestamp, mode int, target string, error string"
_KINDS = {stat.S_IFREG: "file", stat.S_IFDIR: "folder", stat.S_IFLNK: "link"}
_ARROW = pa.schema(
    [("path", pa.string()), ("name", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("size", pa.int64()), *[(n, pa.timestamp("us", "UTC")) for n in ("modified", "accessed", "changed")], ("mode", pa.int32()), ("target", pa.string()), ("error", pa.string())]
)
ROWS = 4096


class Folder(InputPartition):
    """Entries of a folder, and of all below it if deep."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _entries(root: str, folder: str) -> list[os.DirEntry]:
    with os.scandir(os.path.join(root, folder) if folder else root) as found:
        return sorted(found, key=lambda e: e.name)


def describe(root: str, path: str) -> tuple:
    """An entry as a row; an entry that can't be read has its error, and nulls."""
    name, parent = os.path.basename(path), os.path.dirname(path)
    try:
        s = os.lstat(os.path.join(root, path))
        kind = _KINDS.get(stat.S_IFMT(s.st_mode), "other")
        target = os.readlink(os.path.join(root, path)) if kind == "link" else None
    except OSError as e:
        return path, name, parent, path.count("/") + 1, None, None, None, None, None, None, None, e.strerror
    at = lambda t: datetime.fromtimestamp(t, timezone.utc)
    return path, name, parent, path.count("/") + 1, kind, s.st_size if kind == "file" else None, at(s.st_mtime), at(s.st_atime), at(s.st_ctime), stat.S_IMODE(s.st_mode), target, None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.deepest = int(options.get("maxdepth") or 1 << 20)
        self.wanted = int(options.get("partitions") or 64)
        self.kind = options.get("kind")

    def partitions(self) -> list[InputPartition]:
        """Folders, shallow ones opened until there are enough."""
        done, ahead, level = [], [""], 1
        while ahead and len(ahead) < self.wanted and level < self.deepest:
            done += [Folder(f, False) for f in ahead]
            below = []
            for folder in ahead:
                try:
                    below += [f"{folder}/{e.name}".lstrip("/") for e in _entries(self.root, folder) if e.is_dir(follow_symlinks=False)]
                except OSError:
                    continue  # the task that lists it gives the error
            ahead, level = below, level + 1
        return done + [Folder(f, True) for f in ahead] or [Folder("", True)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._walk(partition.path, partition.deep):
            if self.kind is None or row[4] in (None, self.kind):
                rows.append(row)
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _walk(self, folder: str, deep: bool) -> Iterator[tuple]:
        """In the order of names, a folder before what it holds."""
        if (folder.count("/") + 1 if folder else 0) >= self.deepest:
            return
        try:
            found = _entries(self.root, folder)
        except OSError as e:
            row = describe(self.root, folder) if folder else ("", "", "", 0, "folder", *[None] * 7)
            yield (*row[:-1], e.strerror)
            return
        for entry in found:
            path = f"{folder}/{entry.name}".lstrip("/")
            yield describe(self.root, path)
            if deep and entry.is_dir(follow_symlinks=False):
                yield from self._walk(path, True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def walk(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The entries below root; no order is kept, a walk's order is that of the paths' segments."""
    spark.dataSource.register(Tree)
    return spark.read.format("tree").options(**{k: str(v) for k, v in options.items()}).load(root)


def in_walk_order(entries: DataFrame) -> DataFrame:
    """entries with place, from 1: folders before what they hold, names in byte order."""
    return entries.withColumn("place", F.row_number().over(W.orderBy(F.split("path", "/"))))
