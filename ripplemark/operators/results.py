"""Operators over test results: failure rates, duration spread, instability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def failure_rates(results: DataFrame) -> DataFrame:
    """Runs, failures and their ratio for each test."""
    out = results.groupBy("test_id").agg(F.count("*").alias("total_runs"), F.count_if(~F.col("passed")).alias("failures"))
    return out.withColumn("failure_rate", F.col("failures") / F.col("total_runs"))


def duration_cv(results: DataFrame, max_runs: int = 20, min_runs: int = 3, tie: list[str] | None = None) -> DataFrame:
    """Coefficient of variation (at most 1) of the latest ``max_runs`` known durations of each test with enough of them."""
    latest = Window.partitionBy("test_id").orderBy(F.desc("recorded_at"), *[F.desc(c) for c in tie or []])
    rows = results.where(F.col("duration_ms").isNotNull()).withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= max_runs)
    out = rows.groupBy("test_id").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean"), F.stddev_pop("duration_ms").alias("sd"))
    return out.where((F.col("n") >= min_runs) & (F.col("mean") > 0)).select("test_id", F.least(F.col("sd") / F.col("mean"), F.lit(1.0)).alias("duration_cv"))


def instability(covering: DataFrame, rates: DataFrame, spreads: DataFrame) -> DataFrame:
    """Per file, from the tests that cover it (``file_path, test_id``): failures and durations blended.

    Tests without history are left out of either mean; a file with only one of the two has that one, with none 0.
    """
    rows = covering.select("file_path", "test_id").distinct().join(rates.select("test_id", "failure_rate"), "test_id", "left").join(spreads, "test_id", "left")
    out = rows.groupBy("file_path").agg(F.avg("failure_rate").alias("f"), F.avg("duration_cv").alias("c"))
    both = F.least(F.lit(1.0), 0.65 * F.col("f") + 0.35 * F.col("c"))
    value = F.when(F.col("f").isNotNull() & F.col("c").isNotNull(), both).when(F.col("f").isNotNull(), F.col("f")).when(F.col("c").isNotNull(), F.least("c", F.lit(1.0))).otherwise(0.0)
    return out.select("file_path", value.alias("test_instability"))


def without_orphans(results: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results whose test still exists, and the others."""
    known = tests.select(F.col("id").alias("test_id"))
    return results.join(known, "test_id", "left_semi"), results.join(known, "test_id", "left_anti")
