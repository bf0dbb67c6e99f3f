"""Results by shard: a shard is a directory prefix, the longest one that a path lies in.

Tables stay whole; a shard is a filter or a grouping column, so a query over several shards is one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.scalars import shard_of


def with_shard(table: DataFrame, shards: list[str], column: str = "file_path") -> DataFrame:
    """``table`` with ``shard``, null for rows in none."""
    return table.withColumn("shard", shard_of(column, shards))


def of_shard(table: DataFrame, shards: list[str], shard: str | None, column: str = "file_path") -> DataFrame:
    """The rows of one shard; all rows if none is given."""
    return table if shard is None else table.where(shard_of(column, shards).eqNullSafe(F.lit(shard)))


def under(directory: str, shards: list[str]) -> list[str]:
    """The shards that a directory lies in or holds: all for no directory."""
    own = directory.strip("/")
    return [s for s in shards if not own or s == own or s.startswith(own + "/") or own.startswith(s + "/")]


def counts(tables: dict[str, DataFrame], shards: list[str]) -> DataFrame:
    """``table_name, shard, n`` of all tables that have a file, in one union."""
    out = None
    for name, df in tables.items():
        row = with_shard(df, shards).groupBy("shard").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "shard", "n")
        out = row if out is None else out.unionByName(row)
    return out


def totals(by_shard: DataFrame) -> DataFrame:
    """``table_name, n`` summed over the shards."""
    return by_shard.groupBy("table_name").agg(F.sum("n").alias("n"))


def with_data(by_shard: DataFrame) -> DataFrame:
    """The shards that have any row; no data is when there is none."""
    return by_shard.where((F.col("n") > 0) & F.col("shard").isNotNull()).select("shard").distinct()
