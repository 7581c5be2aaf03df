"""Statistics of volumes from their intensity histograms. DataFrame operations only.

Voxels are never shuffled: one partial aggregation turns them into at most 256 rows per volume and task, and everything
else (mean, deviation, Otsu's threshold) is computed from the histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALLBACK_MEAN, FALLBACK_STD, FALLBACK_OTSU = 128.0, 50.0, 128
LEVELS = 256


def histogram(voxels: DataFrame) -> DataFrame:
    """(volume_id, v, n) of the intensities that occur."""
    return voxels.groupBy("volume_id", "v").agg(F.count(F.lit(1)).alias("n"))


def full_histogram(voxels: DataFrame) -> DataFrame:
    """(volume_id, v, n) with all 256 intensities of every volume."""
    counts = histogram(voxels)
    levels = voxels.select("volume_id").distinct().select("volume_id", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("v"))
    return levels.join(counts, ["volume_id", "v"], "left").select("volume_id", "v", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """(volume_id, otsu_threshold): the first intensity with the largest between-class variance.

    Intensities that don't occur never exceed the one below them (the class sums stay), so only those that occur matter.
    """
    up = Window.partitionBy("volume_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("volume_id")
    sums = hist.where("n > 0").withColumns({"w": F.sum("n").over(up), "m": F.sum(F.col("n") * F.col("v")).over(up), "total": F.sum("n").over(whole), "moment": F.sum(F.col("n") * F.col("v")).over(whole)})
    omega, mu, mean = F.col("w") / F.col("total"), F.col("m") / F.col("total"), F.col("moment") / F.col("total")
    gap = mean * omega - mu
    variance = F.when(F.col("w") < F.col("total"), gap * gap / (omega * (1 - omega))).otherwise(F.lit(0.0))
    return sums.groupBy("volume_id").agg(F.max_by("v", F.struct(variance.alias("s"), (-F.col("v")).alias("first"))).alias("v"), F.max(variance).alias("s")).select("volume_id", F.when(F.col("s") > 0, F.col("v")).otherwise(0).cast("int").alias("otsu_threshold"))


def moments(hist: DataFrame, keep: Column) -> DataFrame:
    """(volume_id, mean, std, n_foreground) over the intensities that ``keep`` takes; the deviation is the population's.

    A volume without any gets the fallback 128, 50 and 0.
    """
    n = F.sum(F.when(keep, F.col("n")).otherwise(0))
    s = F.sum(F.when(keep, F.col("n") * F.col("v")).otherwise(0))
    q = F.sum(F.when(keep, F.col("n") * F.col("v") * F.col("v")).otherwise(0))
    sums = hist.groupBy("volume_id").agg(n.alias("n"), s.alias("s"), q.alias("q"))
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    some = F.col("n") > 0
    return sums.select("volume_id", F.when(some, mean).otherwise(FALLBACK_MEAN).alias("mean"), F.when(some, F.sqrt(variance)).otherwise(FALLBACK_STD).alias("std"), F.col("n").alias("n_foreground"))


def volume_stats(voxels: DataFrame, foreground: Column) -> DataFrame:
    """(volume_id, mean, std, n_foreground) of the voxels that ``foreground`` marks; volumes without any get the fallback."""
    marked = voxels.groupBy("volume_id", "v", foreground.alias("inside")).agg(F.count(F.lit(1)).alias("n"))
    return moments(marked, F.coalesce("inside", F.lit(False)))


def streamed_stats(voxels: DataFrame) -> DataFrame:
    """The statistics above Otsu's threshold, and the threshold itself."""
    hist = histogram(voxels)
    limits = otsu(hist)
    above = moments(hist.join(limits, "volume_id").withColumn("above", F.col("v") > F.col("otsu_threshold")), F.col("above"))
    return above.join(limits, "volume_id")


def missing_stats(voxels: DataFrame, known: DataFrame) -> DataFrame:
    """Statistics of the volumes that ``known`` doesn't have yet."""
    return streamed_stats(voxels.join(known.select("volume_id"), "volume_id", "left_anti"))


def anomalies(stats: DataFrame, index: DataFrame) -> DataFrame:
    """(volume_id, problem): fallback statistics, tiny deviations, and indexed volumes without statistics."""
    kind = F.when(F.col("mean").between(127, 129) & F.col("std").between(49, 51), "fallback").when(F.col("std") < 1, "flat")
    odd = stats.select("volume_id", kind.alias("problem")).where("problem is not null")
    lost = index.select("volume_id").distinct().join(stats, "volume_id", "left_anti").select("volume_id", F.lit("no statistics").alias("problem"))
    return odd.unionByName(lost)


def sampled(patches: DataFrame, per_split: int = 5, seed: int = 0) -> DataFrame:
    """Up to ``per_split`` patches of each split, chosen by hash (a sampling operator: its limit is the feature)."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "volume_id", "patch_id").cast("binary"))
    return patches.withColumn("_nth", F.row_number().over(Window.partitionBy("split").orderBy(key, "volume_id", "patch_id"))).where(F.col("_nth") <= per_split).drop("_nth")


def range_verdict(low: Column, high: Column) -> Column:
    """Whether normalised intensities lie in [-0.01, 1.01]."""
    return F.when((low >= -0.01) & (high <= 1.01), "ok").otherwise("out of range")


def logit_verdict(recon_range: Column, gt_range: Column) -> Column:
    """Collapse below a tenth of the true range, divergence beyond five times of it."""
    return F.when(recon_range < 0.1 * gt_range, "collapse").when(recon_range > 5 * gt_range, "diverging").otherwise("ok")


def value_histograms(rows: DataFrame, keys: list[str], value: str, bins: int = 30) -> DataFrame:
    """(keys, bin, low, high, n): per key, counts of a value in equal bins from its least to its largest, empty ones left
    out; NaN and null don't count, and where all values are equal they are in bin 0."""
    v = F.col(value).cast("double")
    real = rows.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = real.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = real.join(F.broadcast(ends) if len(keys) == 0 else ends, keys).withColumn("bin", at).groupBy(*keys, "bin", "_low", "_high").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, "bin", (F.col("_low") + F.col("bin") * width).alias("low"), (F.col("_low") + (F.col("bin") + 1) * width).alias("high"), "n")
