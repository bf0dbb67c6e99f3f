"""Keyed tables on plain Parquet: upserts, deletes, change detection and an atomic switch to a new version.

A table is a folder of versions and numbered pointers; a write makes a new version from the old one and sets the next
pointer, so what is being read is never overwritten and a failed write leaves the old version in place.  A number is
claimed by creating a file that must not exist yet: of two writers that started from one version the second one sees
that it has lost and starts again from the new version, so no change is lost and checks made on what was read hold.
Appended rows are a folder beside their version's, named after it, and are part of it once a pointer names them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.schemas import KEYS, TABLES


def last_of_each(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key in the order of the named columns; a column expression sorts as it says, first row first."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` added or put in place; of several new rows of a key the last by ``order``."""
    new = last_of_each(new, key, list(order)) if order else new.dropDuplicates(key)
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in old.columns])
    on = [old[k].eqNullSafe(new[k]) for k in key]
    return old.join(new, on, "left_anti").unionByName(new)


def upserted_max(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Both together, the highest ``value`` of each key."""
    return old.select(*key, value).unionByName(new.select(*key, value)).groupBy(*key).agg(F.max(value).alias(value))


def deleted(old: DataFrame, keys: DataFrame) -> DataFrame:
    """``old`` without the rows whose key is in ``keys`` (matched on its columns)."""
    return old.join(keys.distinct(), keys.columns, "left_anti")


def changed_files(current: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Current files (``file_path, content_hash`` and optionally ``mtime, size``) that are new or differ from ``known``.

    Equal time and size spare the comparison of hashes unless ``force``.
    """
    columns = [c for c in ("content_hash", "mtime", "size") if c in known.columns]
    old = known.select("file_path", *[F.col(c).alias(f"old_{c}") for c in columns])
    rows = current.join(old, "file_path", "left")
    differs = F.col("old_content_hash").isNull() | (F.col("content_hash") != F.col("old_content_hash"))
    if not force and {"mtime", "size"} <= set(columns) & set(current.columns):
        same = F.coalesce((F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size")), F.lit(False))
        differs = differs & ~same
    return rows.where(differs).select(*current.columns)


class Store:
    """The tables of the model under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        if folder == ":memory:" or folder.startswith("file:memory"):
            raise ValueError("a store is a folder")
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, table: str) -> list[str]:
        fs, p = self._fs(f"{self.folder}/{table}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _pointer(self, table: str) -> tuple[int, str | None]:
        """The number and folder of the current version."""
        marks = sorted(n for n in self._names(table) if n.startswith("_current-"))
        return (int(marks[-1].split("-")[1]), f"{self.folder}/{table}/{marks[-1].split('-', 2)[2].split('~')[0]}") if marks else (-1, None)

    def _folders(self, table: str, path: str) -> list[str]:
        """The folder of a version and those appended to it that a pointer names."""
        own = path.rsplit("/", 1)[1]
        named = (n.split("-", 2)[2] for n in self._names(table) if n.startswith("_current-"))
        return [path, *sorted(f"{self.folder}/{table}/{n}" for n in named if n.startswith(f"{own}~"))]

    def _current(self, table: str) -> str | None:
        return self._pointer(table)[1]

    def _create(self, path: str) -> bool:
        """Makes an empty file; False if there is one."""
        fs, p = self._fs(path)
        jvm = self.spark.sparkContext._jvm
        fs.mkdirs(p.getParent())
        if fs.getUri().getScheme() == "file":
            return jvm.java.io.File(p.toUri().getPath()).createNewFile()
        try:
            fs.create(p, False).close()
            return True
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise

    def _point(self, table: str, number: int, version: str) -> bool:
        """Sets pointer ``number``; False if another writer has claimed it.

        A claim whose writer died is one without a pointer; after a minute the number counts as passed over.
        """
        claim = f"{self.folder}/{table}/_claim-{number:012d}"
        if not self._create(claim):
            fs, p = self._fs(claim)
            if not fs.exists(p) or self._pointer(table)[0] >= number or time.time() * 1000 - fs.getFileStatus(p).getModificationTime() < 60_000:
                return False
            return self._point(table, number + 1, version)
        self._create(f"{self.folder}/{table}/_current-{number:012d}-{version}")
        return True

    def read(self, table: str) -> DataFrame:
        return self._version(table, self._current(table))

    def _version(self, table: str, path: str | None) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[table]) if path is None else self.spark.read.schema(TABLES[table]).parquet(*self._folders(table, path))

    def _typed(self, table: str, rows: DataFrame) -> DataFrame:
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    def change(self, table: str, new: Callable[[DataFrame], DataFrame], tries: int = 20) -> DataFrame:
        """The next version is ``new(current rows)``, made again from what is there if another writer was faster."""
        for k in range(tries):
            number, path = self._pointer(table)
            version = uuid.uuid4().hex
            self._typed(table, new(self._version(table, path))).write.parquet(f"{self.folder}/{table}/{version}")
            if self._point(table, number + 1, version):
                return self.read(table)
            fs, p = self._fs(f"{self.folder}/{table}/{version}")
            fs.delete(p, True)
            time.sleep(0.05 * 2 ** min(k, 5))
        raise RuntimeError(f"{table}: other writers were always faster")

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` as the new version of the table."""
        return self.change(table, lambda _: rows)

    def upsert(self, table: str, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        return self.change(table, lambda old: upserted(old, rows, KEYS[table], order))

    def append(self, table: str, rows: DataFrame, tries: int = 20) -> DataFrame:
        """More rows, as files beside those of the current version; nothing is read or written again.

        They are part of it from the moment that the pointer moves on, so a writer that has read the version without
        these rows starts again, and none sees rows of an append that goes on.
        """
        for k in range(tries):
            number, path = self._pointer(table)
            if path is None:
                return self.change(table, lambda old: old.unionByName(self._typed(table, rows)))
            more = f"{path}~{uuid.uuid4().hex}"
            self._typed(table, rows).write.parquet(more)
            if self._point(table, number + 1, more.rsplit("/", 1)[1]):
                return self.read(table)
            fs, p = self._fs(more)
            fs.delete(p, True)
            time.sleep(0.05 * 2 ** min(k, 5))
        raise RuntimeError(f"{table}: other writers were always faster")

    def delete(self, table: str, keys: DataFrame) -> DataFrame:
        return self.change(table, lambda old: deleted(old, keys))

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        row = self.read("meta").where(F.col("key") == key).first()
        return row["value"] if row else default

    def set_meta(self, **values) -> None:
        rows = [(k, str(v)) for k, v in values.items() if v is not None]
        self.upsert("meta", self.spark.createDataFrame(rows, "key string, value string"))

    def compact(self, target_mb: int = 128) -> dict[str, int]:
        """Each table in fewer, larger files, and versions that nothing points to removed; bytes freed by table."""
        freed = {}
        for table in TABLES:
            path = self._current(table)
            if path is None:
                continue
            sizes = [fs.getContentSummary(p).getLength() for fs, p in map(self._fs, self._folders(table, path))]
            size = sum(sizes)
            self.change(table, lambda old: old.coalesce(max(1, -(-size // (target_mb << 20)))))  # noqa: B023
            (number, kept), (fs, top) = self._pointer(table), self._fs(f"{self.folder}/{table}")
            kept = kept.rsplit("/", 1)[1]
            freed[table] = 0
            for s in fs.listStatus(top):
                name = s.getPath().getName()
                if s.isDirectory() and not name.startswith(kept):
                    freed[table] += fs.getContentSummary(s.getPath()).getLength()
                    fs.delete(s.getPath(), True)
                elif name.startswith("_current-") and int(name.split("-")[1]) < number or name.startswith("_claim-") and int(name.split("-")[1]) < number:
                    fs.delete(s.getPath(), False)
        return freed
