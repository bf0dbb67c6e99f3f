"""What is on disk and not yet in the tables: untracked sources and tests beside the stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import scalars as X
from ripplemark.operators import edges
from ripplemark.operators.impact import best_per_test, fallback, name_matches, static_tests

STEM_WEIGHT = 0.4
MOST_NEIGHBORS = 20


def disk_only_tests(on_disk: DataFrame, stored: DataFrame) -> DataFrame:
    """Tests of files that the tables have no test of (``file_path, name`` and what else ``on_disk`` has)."""
    return on_disk.join(stored.select("file_path").distinct(), "file_path", "left_anti")


def with_disk_tests(stored: DataFrame, disk: DataFrame | None) -> DataFrame:
    """``file_path, name, on_disk`` of stored and disk-only tests together."""
    rows = stored.select("file_path", "name", F.lit(False).alias("on_disk"))
    return rows if disk is None else rows.unionByName(disk.select("file_path", "name", F.lit(True).alias("on_disk")))


def static_overlay(stored: DataFrame, tests: DataFrame, deps: DataFrame, paths: DataFrame) -> DataFrame:
    """Static imports of the tables and of tests on disk only, the latter resolved against stored and disk ``paths`` alike.

    ``tests`` are :func:`disk_only_tests`, ``deps`` their dependencies.  What the tables still have of the same files is
    hidden; nothing is rebuilt or written.  Only relative modules of scripts and Go packages close gaps.
    """
    files = tests.select("file_path").distinct()
    own = deps.where("dep_type = 'import'").join(files, "file_path", "left_semi")
    script = X.detect_language("file_path").isin("javascript", "typescript") & F.col("module_path").startswith(".")
    package = F.col("file_path").endswith(".go") & (F.col("module_path") != "")
    closing = edges.import_edges(own.where(script | package), paths).select(F.col("importer_file").alias("test_file_path"), F.col("imported_file").alias("target_file_path"), F.lit(True).alias("closing"))
    fresh = edges.static_test_imports(tests, own, paths).join(closing, ["test_file_path", "target_file_path"], "left")
    fresh = fresh.withColumn("gap_eligible", F.coalesce("closing", F.lit(False))).withColumn("on_disk", F.lit(True))
    kept = stored.join(files.withColumnRenamed("file_path", "test_file_path"), "test_file_path", "left_anti").withColumn("on_disk", F.lit(False))
    columns = ["test_file_path", "test_unit_name", "target_file_path", "gap_eligible", "score", "on_disk"]
    return kept.select(*columns).unionByName(fresh.select(*columns)).distinct()


def gaps_on_disk(units: DataFrame, untracked: DataFrame, stored_units: DataFrame, directory: str | None = None, exclude_tests: bool = True) -> DataFrame:
    """The units of untracked files that the tables do not know, as gaps without churn.

    ``exclude_tests`` leaves out paths that start with ``test``.
    """
    own = units.join(untracked.select("file_path").distinct(), "file_path", "left_semi").join(stored_units.select("file_path"), "file_path", "left_anti")
    if directory:
        own = own.where(F.col("file_path").startswith(directory.rstrip("/") + "/"))
    if exclude_tests:
        own = own.where(~F.col("file_path").startswith("test"))
    return own.select("id", "file_path", "name", "unit_type", "line_start", "line_end", F.lit(0.0).alias("churn_score"), F.lit(0).cast("bigint").alias("commit_count"))


def with_gaps_on_disk(gaps: DataFrame, disk: DataFrame) -> DataFrame:
    """Both, those on disk first, then by churn."""
    rows = gaps.withColumn("working_tree", F.lit(False)).unionByName(disk.withColumn("working_tree", F.lit(True)))
    return rows.orderBy(F.desc("working_tree"), F.desc("churn_score"), "id")


def suggest_by_name(files: DataFrame, stored: DataFrame, disk: DataFrame | None = None, every: bool = True) -> DataFrame:
    """Tests for files by the names of both; with ``every``, all tests, else those that match at 0.5 or more."""
    return (fallback if every else name_matches)(files, with_disk_tests(stored, disk))


def more_tests(rows: DataFrame, hit: DataFrame, files: DataFrame, untracked: DataFrame, static: DataFrame, stored: DataFrame, disk: DataFrame | None) -> DataFrame:
    """The tests of ``rows`` and, for tests not among them, static imports of tracked ``files`` and names of files without a hit."""
    tracked = files.join(untracked.select("file_path"), "file_path", "left_anti")
    by_import = static_tests(static, tracked).withColumn("source", F.lit("working_tree"))
    near = suggest_by_name(files.join(hit, "file_path", "left_anti"), stored, disk, every=False)
    near = near.select("test_id", "file_path", "name", (F.col("relevance") * STEM_WEIGHT).alias("score"), F.concat(F.lit("name like "), F.col("source_file")).alias("reason"), F.lit("working_tree").alias("source"))
    more = best_per_test(by_import.unionByName(near)).join(rows.select("test_id"), "test_id", "left_anti")
    return rows.unionByName(more)


def disk_neighbors(deps: DataFrame, most: int = MOST_NEIGHBORS) -> DataFrame:
    """``file_path, modules``: the first modules that each file imports, each once, in the order of ``deps.place``."""
    own = deps.where((F.col("dep_type") == "import") & F.coalesce(F.col("module_path") != "", F.lit(False)))
    first = own.groupBy("file_path", "module_path").agg(F.min("place").alias("place"))
    rows = first.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("place", "module_path"))).alias("m"))
    return rows.select("file_path", F.slice(F.transform("m", lambda x: x["module_path"]), 1, most).alias("modules"))
