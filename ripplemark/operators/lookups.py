"""Point and batch lookups over the tables: filters and equality joins, the given keys as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(table: DataFrame, **values) -> DataFrame:
    """The rows whose columns have the given values (None: null)."""
    for name, value in values.items():
        table = table.where(F.col(name).eqNullSafe(F.lit(value)))
    return table


def of_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose values of the columns of ``keys`` are among its rows: one shuffle, or none if Spark broadcasts."""
    return table.join(keys.distinct(), keys.columns, "left_semi")


def units_by_stem(units: DataFrame, stem: str) -> DataFrame:
    """Units of files named by a stem, in any case and with any extension; files of tests and specs left out."""
    path = F.col("file_path")
    named = path.ilike(f"%/{stem}.%") | path.ilike(f"{stem}.%")
    return units.where(named & ~path.ilike("%.test.%") & ~path.ilike("%.spec.%"))


def importers(edges: DataFrame, files: DataFrame, least: float = 0.0) -> DataFrame:
    """``file_path, importer_file``: who imports the given files."""
    own = edges.where(F.col("confidence") >= least).select(F.col("imported_file").alias("file_path"), "importer_file")
    return of_keys(own, files.select("file_path")).distinct()


def imports(edges: DataFrame, files: DataFrame, least: float = 1.0) -> DataFrame:
    """``file_path, imported_file, confidence``: what the given files import; sure imports only unless ``least`` is lower."""
    own = edges.where(F.col("confidence") >= least).select(F.col("importer_file").alias("file_path"), "imported_file", "confidence")
    return of_keys(own, files.select("file_path")).groupBy("file_path", "imported_file").agg(F.max("confidence").alias("confidence"))


def missing(files: DataFrame, known: DataFrame) -> DataFrame:
    """The given files that a table does not know."""
    return files.select("file_path").distinct().join(known.select("file_path"), "file_path", "left_anti")


def meta_number(meta: DataFrame, key: str, default: int, least: int = 1) -> Column | DataFrame:
    """One row: the number kept under ``key``, or the default, not below ``least``."""
    found = meta.where(F.col("key") == key).agg(F.first("value").cast("int").alias("v"))
    return found.select(F.greatest(F.lit(least), F.coalesce("v", F.lit(default))).alias(key))


def latest_events(events: DataFrame, job_id: str, limit: int = 50) -> DataFrame:
    """The newest events of a job."""
    return events.where(F.col("job_id") == job_id).orderBy(F.desc("id")).limit(limit)


def active_locks(locks: DataFrame, now: float, agent: str | None = None) -> DataFrame:
    """Locks that have not expired, newest first."""
    own = locks.where(F.col("expires_at") >= now)
    return (own if agent is None else own.where(F.col("agent_id") == agent)).orderBy(F.desc("acquired_at"), "file_path")


def names_by_file(tests: DataFrame) -> DataFrame:
    """``file_path, names``: the tests of each file, in order."""
    return tests.groupBy("file_path").agg(F.array_sort(F.collect_list("name")).alias("names"))
