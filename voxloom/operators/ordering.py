"""Row numbers, batches and percentiles of any number of rows, without a task that holds them all. DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.scratch import saved

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
_BITS = 33


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """``df`` and the column ``name``: 1, 2, 3... in the order of ``order``; rows that tie go in any one order.

    Rows are sorted over ranges of the order, and each has its place in its range; the ranges' sizes, one number a
    partition, give every range its offset. Rows that tie may lie in several ranges, so a value that most rows share is no
    hot range. ``df`` is read twice, once for the ranges' limits, so it ought to be a table.
    """
    spark = df.sparkSession
    apart = df.withColumn("__at", F.monotonically_increasing_id())
    placed = saved(apart.orderBy(*order, "__at").withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("__at", _BITS)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    known = spark.createDataFrame(offsets, "__part long, __offset long")
    at = F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    return placed.withColumn("__part", part).join(F.broadcast(known), "__part").withColumn(name, at).drop("__at", "__part", "__offset")


def batched(rows: DataFrame, size: int, keys: Sequence[str], seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """Adds ``batch_id``, 0, 1, 2...: ``size`` rows each but for the last batch, in the order of ``keys``, or of their MD5 with
    a seed. ``drop_last`` leaves the last batch out unless it is full. Keys ought to be unique: rows that tie go in any order.
    """
    order = [F.col(k) for k in keys]
    if seed is not None:
        order = [F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary")), *order]
    out = numbered(rows, *order, name="__n").withColumn("batch_id", F.floor((F.col("__n") - 1) / size))
    if drop_last:
        out = out.where(F.col("batch_id") < rows.count() // size)
    return out.drop("__n")


def percentiles(rows: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """The exact percentiles of a column with linear interpolation, as ``F.percentile`` gives them: nulls don't count, NaN is
    above all numbers, and none is there without values. Only the rows at the ranks in question reach the driver."""
    if bad := [s for s in shares if not 0 <= s <= 1]:
        raise ValueError(f"no shares of one: {bad}")
    placed = numbered(rows.select(F.col(value).cast("double").alias("v")).where("v is not null"), "v")
    last = placed.count() - 1
    if last < 0:
        return [None] * len(shares)
    at = [(s * last, math.floor(s * last), math.ceil(s * last)) for s in shares]
    found = {r.n - 1: r.v for r in placed.where(F.col("n").isin(sorted({k + 1 for _, low, high in at for k in (low, high)}))).collect()}
    return [found[low] if low == high else (high - x) * found[low] + (x - low) * found[high] for x, low, high in at]
