"""Operators over units, tests and edges: direct impact, gaps, stale edges, coverage, table counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.scalars import in_directory
from ripplemark.schemas import EDGE_TYPES


def direct_impact(units: DataFrame, edges: DataFrame, tests: DataFrame, changed: DataFrame, deal: int | None = None) -> DataFrame:
    """Tests with an edge to a unit of a changed file; with ``deal`` their rows are dealt over so many tasks by test.

    ``changed``: ``file_path`` and optionally ``functions`` (array): null means the whole file, empty means nothing.
    """
    if "functions" not in changed.columns:
        changed = changed.withColumn("functions", F.lit(None).cast("array<string>"))
    own = units.select(F.col("id").alias("code_id"), "file_path", F.col("name").alias("unit_name")).join(changed, "file_path")
    own = own.where(F.col("functions").isNull() | F.array_contains("functions", F.col("unit_name"))).drop("functions")
    named = tests.select(F.col("id").alias("test_id"), F.col("file_path").alias("test_file"), F.col("name").alias("test_name"))
    found = own.join(edges, "code_id")
    found = found.repartition(deal, "test_id") if deal else found
    return found.join(named, "test_id").select("test_id", "test_file", "test_name", "file_path", "unit_name", "edge_type", F.col("weight").alias("score"))


def stale_edges(units: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Edges of existing tests to units that are gone."""
    kept = edges.join(tests.select(F.col("id").alias("test_id"), "file_path", "name"), "test_id")
    return kept.join(units.select(F.col("id").alias("code_id")), "code_id", "left_anti")


def untested_units(units: DataFrame, edges: DataFrame, tests: DataFrame, churn: DataFrame, file_path: str | None = None, directory: str | None = None, exclude_tests: bool = True) -> DataFrame:
    """Units without any edge, with the churn of the unit, files of tests left out."""
    own = units
    if file_path is not None:
        own = own.where(F.col("file_path") == file_path)
    if directory:
        own = own.where(in_directory("file_path", directory))
    own = own.join(edges.select(F.col("code_id").alias("id")), "id", "left_anti")
    if exclude_tests:
        own = own.join(tests.select("file_path"), "file_path", "left_anti")
    by_unit = churn.select("file_path", F.coalesce("unit_name", F.lit("")).alias("name"), "churn_score", "commit_count")
    out = own.join(by_unit, ["file_path", "name"], "left")
    return out.select("id", "file_path", "name", "unit_type", "line_start", "line_end", F.coalesce("churn_score", F.lit(0.0)).alias("churn_score"), F.coalesce("commit_count", F.lit(0)).cast("bigint").alias("commit_count"))


def files_with_edges(units: DataFrame, edges: DataFrame) -> DataFrame:
    return units.join(edges.select(F.col("code_id").alias("id")), "id", "left_semi").select("file_path").distinct()


def test_gaps(gaps: DataFrame, static: DataFrame, covered_files: DataFrame) -> DataFrame:
    """Gaps without those in files that only a static import covers.

    A file with edges keeps its gaps.  If nothing would be left, the gaps stay as they are.
    """
    targets = static.where("gap_eligible").select(F.col("target_file_path").alias("file_path")).distinct()
    only = targets.join(covered_files, "file_path", "left_anti")
    left = gaps.join(only, "file_path", "left_anti")
    return gaps if left.isEmpty() else left


def covering_tests(units: DataFrame, edges: DataFrame, deal: int | None = None) -> DataFrame:
    """``file_path, test_id`` of every edge, found in ``deal`` tasks if given."""
    rows = units.select(F.col("id").alias("code_id"), "file_path").join(edges, "code_id").select("file_path", "test_id")
    return (rows.repartition(deal, "file_path", "test_id") if deal else rows).distinct()


def file_coverage(units: DataFrame, edges: DataFrame, mode: str = "line", deal: int | None = None) -> DataFrame:
    """Per file: share of units or lines with a test, covering tests (found in ``deal`` tasks if given), and edges by type (unknown types count in the total)."""
    by_unit = edges.groupBy("code_id").agg(F.count("*").alias("edges"), *[F.count_if(F.col("edge_type") == t).alias(f"n_{t}") for t in EDGE_TYPES])
    rows = units.select(F.col("id").alias("code_id"), "file_path", (F.col("line_end") - F.col("line_start") + 1).alias("lines")).join(by_unit, "code_id", "left")
    tested = F.col("edges").isNotNull()
    out = rows.groupBy("file_path").agg(
        F.count("*").alias("units"),
        F.count_if(tested).alias("tested_units"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(F.when(tested, F.col("lines"))), F.lit(0)).alias("tested_lines"),
        F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"),
        *[F.coalesce(F.sum(f"n_{t}"), F.lit(0)).alias(f"n_{t}") for t in EDGE_TYPES],
    )
    by_units = F.col("tested_units") / F.greatest("units", F.lit(1))
    coverage = F.when(F.col("lines") > 0, F.col("tested_lines") / F.col("lines")).otherwise(by_units) if mode == "line" else by_units
    tests = covering_tests(units, edges, deal).groupBy("file_path").agg(F.count("*").alias("covering_tests"))
    return out.withColumn("coverage", coverage).join(tests, "file_path", "left").fillna(0, ["covering_tests"])


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n`` of every table in one union."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def shadow_graph(edges: DataFrame) -> DataFrame:
    """Counts of edge kinds that static analysis sees poorly, and their share of all edges."""
    one = lambda *kinds: F.count_if(F.col("edge_type").isin(*kinds))
    n = edges.agg(
        F.count("*").alias("total_edges"),
        one("call").alias("call_edges"),
        one("import").alias("import_edges"),
        one("dynamic_import", "eval_import").alias("dynamic_import_edges"),
        one("eval_import").alias("eval_import_edges"),
        one("tainted_import").alias("tainted_import_edges"),
    )
    return n.withColumn("unknown_shadow_ratio", F.round(F.col("dynamic_import_edges") / F.greatest("total_edges", F.lit(1)), 4))


def resolvable_paths(units: DataFrame, churn: DataFrame) -> DataFrame:
    return units.select("file_path").union(churn.select("file_path")).distinct()
