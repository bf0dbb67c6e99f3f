"""Source trees and test reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions.scalars import has_code_extension, in_directory, is_test_file, sha256
from ripplemark.sources import tree

def source_files(spark: SparkSession, root: str, visible: DataFrame | None = None, directory: str | None = None) -> DataFrame:
    """``file_path, content, content_hash, mtime, size`` of all code files under ``root``.

    Directories that hold no sources are not entered, nor anything beside ``directory``; with ``visible`` only those
    paths stay.  Only then are files opened, whatever their names begin with.
    """
    rows = tree.listing(spark, root, directory).where(has_code_extension("file_path"))
    if directory:
        rows = rows.where(in_directory("file_path", directory))
    if visible is not None:
        rows = rows.join(visible.select("file_path"), "file_path", "left_semi")
    rows = tree.with_content(rows, root)
    return rows.select("file_path", F.col("content").cast("string").alias("content"), sha256("content").alias("content_hash"), "mtime", "size")


def test_files(files: DataFrame) -> DataFrame:
    return files.where(is_test_file("file_path", F.col("content")))


def pytest_results(lines: DataFrame, recorded_at=None) -> DataFrame:
    """``test_id, passed, duration_ms, recorded_at`` of verbose test output (column ``value``).

    Passed and expected failures pass; skipped and unexpected passes do not.  ``::`` becomes ``:`` so ids join tests.
    """
    pattern = r"^(\S+::\S+)\s+(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)"
    rows = lines.select(F.regexp_extract("value", pattern, 1).alias("t"), F.regexp_extract("value", pattern, 2).alias("r")).where(F.col("t") != "")
    when = F.current_timestamp() if recorded_at is None else recorded_at
    return rows.select(F.replace("t", F.lit("::"), F.lit(":")).alias("test_id"), F.col("r").isin("PASSED", "XFAIL").alias("passed"), F.lit(None).cast("bigint").alias("duration_ms"), when.alias("recorded_at"))


JEST = "testResults array<struct<name:string,assertionResults:array<struct<fullName:string,title:string,status:string,duration:double>>>>"


def jest_rows(reports: DataFrame, project: str = "", recorded_at=None) -> DataFrame:
    """The same of reports of test suites, one a row, read with the schema ``JEST``."""
    rows = reports.select(F.inline("testResults")).select("name", F.inline("assertionResults"))
    file = F.regexp_replace("name", f"^{project.rstrip('/')}/", "") if project else F.col("name")
    when = F.current_timestamp() if recorded_at is None else recorded_at
    return rows.select(F.concat_ws(":", file, F.coalesce("title", "fullName")).alias("test_id"), (F.col("status") == "passed").alias("passed"), F.round("duration").cast("bigint").alias("duration_ms"), when.alias("recorded_at"))


def jest_results(spark: SparkSession, path: str, project: str = "", recorded_at=None) -> DataFrame:
    return jest_rows(spark.read.schema(JEST).option("multiLine", True).json(path), project, recorded_at)


def results_of(spark: SparkSession, framework: str, lines: DataFrame | None = None, report: str | None = None, project: str = "") -> DataFrame | None:
    """The results by framework; None for those without a machine-readable report."""
    if framework == "pytest" and lines is not None:
        return pytest_results(lines)
    if framework == "jest" and report:
        return jest_results(spark, report, project)
    return None
