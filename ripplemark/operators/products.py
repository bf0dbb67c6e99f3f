"""Products of two lists under a key, made evenly: no row holds a whole list, no task makes more than its share, nothing of the product is shuffled."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1_000
#: Rows that one task makes, about.
PER_TASK = 8_000_000


def blocks(rows: DataFrame, by: str, name: str, size: int = BLOCK, also: dict | None = None) -> DataFrame:
    """``by``, ``_block`` and arrays ``name`` of about ``size`` rows each, as structs of the other columns; ``also`` holds aggregates of all rows of a key."""
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"), *[v.alias(k) for k, v in (also or {}).items()])
    others = [c for c in rows.columns if c != by and c not in (also or {})]
    rows = rows.select(by, *others).join(counts, F.col(by).eqNullSafe(F.col("_by")))
    block = F.pmod(F.xxhash64(*others), F.ceil(F.col("_n") / size)).alias("_block")
    return rows.groupBy(by, block, *(also or {})).agg(F.collect_list(F.struct(*others)).alias(name))


def tasks(rows: float | None, per_task: int | None = None) -> int:
    return int(-(-(rows or 1) // (per_task or PER_TASK)))


def grid(left: int, right: int, per_task: int | None = None) -> tuple[int, int]:
    """Into how many parts each of two lists is cut so that a part of one and a part of the other make a task's share."""
    n = tasks(left * right, per_task)
    parts = max(1, min(right, math.isqrt(n - 1) + 1))
    return -(-n // parts), parts


def crossed(left: DataFrame, right: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """All pairs of rows.  A task takes a part of each side and hands on one pair after another.

    A broadcast join holds all pairs of a row of ``left``, and all rows made of them, before it hands on the first.
    """
    return left.repartition(parts[0]).hint("shuffle_replicate_nl").crossJoin(right.repartition(parts[1]))


def joined(left: DataFrame, right: DataFrame, by: str, per_task: int | None = None) -> DataFrame:
    """``left`` and ``right`` joined on ``by``, for products much larger than both.

    Rows of ``right`` come in blocks.  A key whose product is over ``per_task`` rows is cut into slices of ``left``, and
    the blocks of the key are sent to each of them.  Both are counted first, so both should be cheap to make again.
    """
    per_task = per_task or PER_TASK
    counts = [x.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias(n)) for x, n in ((left, "_l"), (right, "_r"))]
    sizes = reduce(lambda a, b: a.join(b, by), counts).select(by, (F.col("_l").cast("double") * F.col("_r")).alias("_rows"))
    n = tasks(sizes.agg(F.sum("_rows")).first()[0], per_task)
    sizes = sizes.select(by, F.ceil(F.col("_rows") / per_task).cast("int").alias("_slices"))
    others = [c for c in left.columns if c != by]
    rows = left.join(sizes, by).withColumn("_slice", F.pmod(F.xxhash64(*others), "_slices").cast("int")).drop("_slices")
    packed = blocks(right, by, "_right").drop("_block").join(sizes, by).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    both = rows.repartition(n, by, "_slice").join(packed.repartition(n, by, "_slice"), [by, "_slice"])
    return both.select(by, *others, F.inline("_right"))
