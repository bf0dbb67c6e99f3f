"""Listing of source trees: every file but those below skipped directories, which are never entered."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Directories that hold no sources of the project.
SKIPPED = (".git", "node_modules", "__pycache__", ".tox", ".venv", "venv", "env", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".eggs", "target", "vendor", "Pods", "coverage", ".next", ".nuxt")

LISTING = "file_path string, mtime double, size bigint"
#: Bytes of content in one batch, but for a larger file.
BATCH_BYTES = 32_000_000


def local_path(root: str) -> str:
    """The folder that ``root`` names; driver and workers see it under one path, as git needs it too."""
    scheme, _, rest = root.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"{root}: a source tree is a folder that every worker can open")
    return os.path.abspath("/" + rest.lstrip("/") if scheme else rest)


class _Part(InputPartition):
    """Directories of which the own files are listed, or all files below them (``deep``)."""

    def __init__(self, folders: list[str], deep: bool):
        super().__init__(folders)
        self.deep = deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = local_path(options["path"])
        self.top = os.path.normpath(os.path.join(self.root, options.get("directory") or "."))
        self.branches = int(options.get("branches", 64))

    def _entries(self, folder: str):
        """Directories to enter and files of ``folder``; one that has gone meanwhile is empty.  Links to directories are not followed."""
        folders, files = [], []
        try:
            with os.scandir(folder) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in SKIPPED:
                            folders.append(e.path)
                    elif e.is_file():
                        files.append(e)
        except FileNotFoundError:
            pass
        return folders, files

    def partitions(self):
        """The upper directories one by one, until there are enough branches to be walked by tasks."""
        inside = self.top == self.root or self.top.startswith(self.root + os.sep)
        hidden = any(p in SKIPPED for p in os.path.relpath(self.top, self.root).split(os.sep))
        waiting, upper = ([self.top] if inside and not hidden and os.path.isdir(self.top) else []), []
        while waiting and len(waiting) < self.branches and len(upper) < 16 * self.branches:
            upper.append(waiting.pop(0))
            waiting += sorted(self._entries(upper[-1])[0])
        step = max(1, len(upper) // 8)
        return [_Part(upper[k : k + step], False) for k in range(0, len(upper), step)] + [_Part([f], True) for f in waiting] or [_Part([], False)]

    def read(self, partition):
        waiting = list(partition.value)
        while waiting:
            folders, files = self._entries(waiting.pop())
            if partition.deep:
                waiting += folders
            for f in files:
                try:
                    stat = f.stat()
                except FileNotFoundError:
                    continue
                yield os.path.relpath(f.path, self.root).replace(os.sep, "/"), stat.st_mtime_ns // 1_000_000 / 1000, stat.st_size


class TreeSource(DataSource):
    """``spark.read.format("sourcetree").option("directory", ...).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def listing(spark: SparkSession, root: str, directory: str | None = None) -> DataFrame:
    """``file_path, mtime, size`` of all files below ``root``, or below one directory of it: nothing else is entered."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("sourcetree")
    return (reader.option("directory", directory) if directory else reader).load(root)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``file_path, mtime, size, content`` (binary) of listed files, read in tasks; a file that has gone meanwhile has no row."""
    base = local_path(root)

    def run(batches):
        for batch in batches:
            rows, contents, size = [], [], 0
            for i, path in enumerate(batch.column("file_path").to_pylist()):
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        contents.append(f.read())
                except FileNotFoundError:
                    continue
                rows.append(i)
                size += len(contents[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(contents, pa.binary())], names=[*batch.schema.names, "content"])
                    rows, contents, size = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(contents, pa.binary())], names=[*batch.schema.names, "content"])

    return files.select("file_path", "mtime", "size").mapInArrow(run, f"{LISTING}, content binary")
