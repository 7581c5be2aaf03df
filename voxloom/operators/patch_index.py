"""Patch grids, box sums and porosity. DataFrame operations only."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.schemas import SPLIT_NAMES

AXES = ("z", "y", "x")


def grid(volumes: DataFrame, ps: int, stride: int) -> DataFrame:
    """Adds z0, y0, x0: the origins of all ``ps``-cubes inside volumes of shape (d, h, w); none where one doesn't fit."""
    out = volumes.where((F.col("d") >= ps) & (F.col("h") >= ps) & (F.col("w") >= ps))
    for axis, length in (("z0", "d"), ("y0", "h"), ("x0", "w")):
        out = out.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - ps, F.lit(stride).cast("long"))))
    return out


def integral(voxels: DataFrame, value: str = "mask") -> DataFrame:
    """(volume_id, z, y, x, s): inclusive sums of a dense volume along all three axes, one window per axis."""
    out = voxels.select("volume_id", *AXES, F.col(value).cast("long").alias("s"))
    for axis in AXES:
        others = [a for a in AXES if a != axis]
        out = out.withColumn("s", F.sum("s").over(Window.partitionBy("volume_id", *others).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)))
    return out


def box_sums(sat: DataFrame, boxes: DataFrame, ps: int) -> DataFrame:
    """Adds ``total`` to boxes (volume_id, z0, y0, x0): eight corners of the integral volume, signed and summed.

    The corners are joined by exact position and added up by one aggregation; a corner outside the volume counts zero.
    """
    corners = [(dz, dy, dx) for dz in (0, 1) for dy in (0, 1) for dx in (0, 1)]
    corner = F.explode(F.array(*[F.struct(*[(F.col(f"{a}0") + (ps if d else 0) - 1).alias(a) for a, d in zip(AXES, c, strict=True)], F.lit((-1) ** (3 - sum(c))).alias("sign")) for c in corners]))
    asked = boxes.select("*", corner.alias("c")).select(*boxes.columns, "c.*")
    return asked.join(sat, ["volume_id", *AXES], "left").groupBy(*boxes.columns).agg(F.coalesce(F.sum(F.col("sign") * F.col("s")), F.lit(0).cast("long")).alias("total"))


def patch_sums(voxels: DataFrame, shapes: DataFrame, ps: int, stride: int) -> DataFrame:
    """Adds ``total``, the set voxels of each patch, to the grid of ``shapes`` (volume_id, d, h, w and more).

    ``voxels`` (volume_id, z, y, x) holds the set voxels only. They are first counted in blocks of side g = gcd(ps, stride),
    which combines before the shuffle; a block lies wholly inside or outside every patch, so each block is then added to
    the (at most (ps / g) ** 3) origins that cover it.
    """
    g = gcd(ps, stride)
    blocks = voxels.groupBy("volume_id", *[F.floor(F.col(a) / g).alias(a) for a in AXES]).agg(F.count(F.lit(1)).alias("n"))
    for a in AXES:
        low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(a) * g + g - ps) / stride)) * stride
        high = F.floor(F.col(a) * g / stride) * stride
        blocks = blocks.withColumn(f"{a}0", F.explode(F.when(low <= high, F.sequence(low, high, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    sums = blocks.groupBy("volume_id", "z0", "y0", "x0").agg(F.sum("n").alias("total"))
    return grid(shapes, ps, stride).join(sums, ["volume_id", "z0", "y0", "x0"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


def patch_index(voxels: DataFrame, shapes: DataFrame, ps: int, stride: int) -> DataFrame:
    """The patch index of ``shapes`` (volume_id, source_group, split, d, h, w); porosity is the share of set voxels."""
    summed = patch_sums(voxels, shapes, ps, stride)
    return summed.select("volume_id", "source_group", "split", "z0", "y0", "x0", F.lit(ps).cast("long").alias("ps"), F.lit(stride).cast("long").alias("stride"), (F.col("total") / ps**3).cast("float").alias("porosity"))


def is_corrupt(porosity: Column) -> Column:
    """Porosity above 1; NaN and null are not."""
    return F.coalesce((porosity > 1.0) & ~F.isnan(porosity), F.lit(False))


def readable(index: DataFrame, split: str) -> DataFrame:
    """The patches of a split without those of impossible porosity."""
    return index.where((F.col("split") == split) & ~is_corrupt(F.col("porosity")))


def corrupt_report(index: DataFrame) -> DataFrame:
    """(split, n, worst, first_volume) of the patches that ``readable`` leaves out."""
    return index.where(is_corrupt(F.col("porosity"))).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("porosity").alias("worst"), F.min("volume_id").alias("first_volume"))


def incremental(found: DataFrame, stored: DataFrame, indexed: DataFrame, stats: DataFrame) -> DataFrame:
    """The volumes that are not stored, indexed and described yet."""
    done = stored.select("volume_id").intersect(indexed.select("volume_id")).intersect(stats.select("volume_id"))
    return found.join(done, "volume_id", "left_anti")


def appended(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the rows of volumes it doesn't have; rows that are there keep their split."""
    return index.unionByName(new.join(index.select("volume_id").distinct(), "volume_id", "left_anti").select(index.columns))


def summary(index: DataFrame) -> DataFrame:
    """(split, n) for train, val and test."""
    names = index.sparkSession.createDataFrame([(s,) for s in SPLIT_NAMES], "split string")
    return names.join(index.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").na.fill(0, ["n"])
