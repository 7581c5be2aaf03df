"""Texture of patches: local variance, transition density and focus, classes, and the comparison of two decoders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import losses
from voxloom.functions.arrays import mean, sharpness, sigmoid
from voxloom.operators.ordering import percentiles
from voxloom.operators.patch_metrics import ratio


def box_mean(cubes: np.ndarray, k: int) -> np.ndarray:
    """Means over boxes of side k around every voxel of (n, side, side, side); what lies outside counts as zero."""
    out = cubes
    for axis in (1, 2, 3):
        wide = np.pad(out, [(0, 0)] * axis + [(k // 2 + 1, k // 2)] + [(0, 0)] * (3 - axis))
        sums = np.cumsum(wide, axis=axis)
        n = cubes.shape[axis]
        out = np.take(sums, np.arange(k, k + n), axis=axis) - np.take(sums, np.arange(n), axis=axis)
    return out / k**3


def variance_maps(cubes: np.ndarray, k: int) -> np.ndarray:
    return np.maximum(box_mean(cubes**2, k) - box_mean(cubes, k) ** 2, 0)


def with_variance_map(patches: DataFrame, side: int, kernel: int = 5, mask: str = "mask", out: str = "variance_map") -> DataFrame:
    """Adds the local variance of a mask (an array of side ** 3 numbers; another length is an error)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(mask))
            values = column.flatten().to_numpy(zero_copy_only=False)
            if len(values) != len(column) * side**3:
                raise ValueError(f"a patch doesn't hold {side}^3 voxels")
            maps = variance_maps(values.reshape(-1, side, side, side).astype(np.float64), kernel)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * side**3), pa.array(maps.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, out])

    return patches.mapInArrow(add, patches.select("*", F.lit(None).cast("array<double>").alias(out)).schema)


def variance_density(maps: Column) -> Column:
    return mean(maps)


def focus(maps: Column, side: int) -> Column:
    """(z, y, x) of the largest local variance, the first in that order."""
    at = (F.array_position(maps, F.array_max(maps)) - 1).cast("int")
    return F.struct(F.floor(at / (side * side)).cast("int").alias("z"), (F.floor(at / side) % side).cast("int").alias("y"), (at % side).cast("int").alias("x"))


def percentile_threshold(rows: DataFrame, score: str, percent: float = 75.0) -> float:
    """The exact percentile of single-precision scores, with linear interpolation."""
    return percentiles(rows.select(F.col(score).cast("float").cast("double").alias("score")), "score", [percent / 100])[0]


def two_way(density: Column, threshold: float) -> Column:
    return F.when(density >= threshold, "high_transition").otherwise("interior")


def three_way(density: Column, threshold: float, porosity: Column, porosity_threshold: float) -> Column:
    return F.when(density >= threshold, "high_transition").when(porosity >= porosity_threshold, "high_porosity").otherwise("interior")


def compared_decoders(patches: DataFrame, auxiliary: str, threshold: float, side: int, kernel: int = 5) -> DataFrame:
    """Patch by patch: losses and sharpness of the original (sigmoid of xct_logits) and of an auxiliary reconstruction."""
    original = F.transform("xct_logits", sigmoid)
    loss = lambda pred: losses.charbonnier_sum(pred, F.col("xct")) / F.size("xct")
    rows = with_variance_map(patches, side, kernel).select(
        "split", "dataset_index", "volume_id", "z0", "y0", "x0", mean("mask").alias("porosity"), variance_density(F.col("variance_map")).alias("transition_density"),
        loss(original).alias("xct_loss_original"), loss(F.col(auxiliary)).alias("xct_loss_auxiliary"),
        sharpness(F.col("xct"), side).alias("sharpness_gt"), sharpness(original, side).alias("sharpness_recon_original"), sharpness(F.col(auxiliary), side).alias("sharpness_recon_auxiliary"),
    )
    return rows.withColumns({
        "transition_label": two_way(F.col("transition_density"), threshold),
        "sharpness_ratio_original": ratio(F.col("sharpness_recon_original"), F.col("sharpness_gt")),
        "sharpness_ratio_auxiliary": ratio(F.col("sharpness_recon_auxiliary"), F.col("sharpness_gt")),
    })


def with_gains(rows: DataFrame) -> DataFrame:
    off = lambda c: F.abs(F.col(c) - 1)
    return rows.withColumns({"loss_gain": F.col("xct_loss_original") - F.col("xct_loss_auxiliary"), "ratio_error_original": off("sharpness_ratio_original"), "ratio_error_auxiliary": off("sharpness_ratio_auxiliary")})


def nan_mean(c: str) -> Column:
    """The mean of what is a number."""
    return F.avg(F.nanvl(F.col(c), F.lit(None).cast("double")))


def summarised(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Counts and means by ``keys``; NaN is left out of a mean."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[nan_mean(v).alias(v) for v in values])


def top_per_class(rows: DataFrame, label: str, by: str, k: int = 3, keys: tuple[str, ...] = ("split", "dataset_index")) -> DataFrame:
    """The k rows of each class with the largest ``by`` (ties by key); a row of two classes comes once. k is the feature."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.col(by).desc(), *keys))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank").dropDuplicates(list(keys))


def described(rows: DataFrame, value: str, percents: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """count, mean, sample std, min, exact percentiles and max of a column, in one row."""
    v = F.col(value).cast("double")
    return rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), *[F.lit(p).cast("double").alias(f"p{share * 100:g}") for share, p in zip(percents, percentiles(rows, value, percents), strict=True)], F.max(v).alias("max"))


def gain_verdict(gain: Column, interior_gain: Column, factor: float = 1.25) -> Column:
    return F.when(gain > factor * interior_gain, "keep auxiliary").otherwise("no clear gain")


def crop(slice2d: Column, height: int, width: int, cy: Column, cx: Column, size: int) -> Column:
    """A size x size window of a row-major slice around (cy, cx), moved inside where it would stick out."""
    y0 = F.least(F.greatest(cy - size // 2, F.lit(0)), F.lit(max(0, height - size)))
    x0 = F.least(F.greatest(cx - size // 2, F.lit(0)), F.lit(max(0, width - size)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(min(size, height) - 1)), lambda r: F.slice(slice2d, ((y0 + r) * width + x0 + 1).cast("int"), F.lit(min(size, width)))))
