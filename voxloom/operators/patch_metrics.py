"""Losses and metrics of model outputs, by batch and over batches. DataFrame operations only.

Patches carry arrays, so a patch's sums need no shuffle; batches are one aggregation of a few numbers per patch, and the
means over batches another. ``patches``: vec_id, volume_id, batch_id, xct_logits, mask_logits, xct, mask, mu, logvar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import losses
from voxloom.functions.arrays import mean, sharpness, sigmoid, total, total_of, total_pair

TINY = 1e-7


def reconstruction_losses(patches: DataFrame) -> DataFrame:
    """(batch_id, l1, mse, charbonnier): means over all voxels of a batch; logits enter without an activation."""
    each = patches.select("batch_id", F.size("xct").alias("n"), *[f(F.col("xct_logits"), F.col("xct")).alias(name) for name, f in losses.RECONSTRUCTION.items()])
    return each.groupBy("batch_id").agg(*[(F.sum(name) / F.sum("n")).alias(name) for name in losses.RECONSTRUCTION])


def mask_losses(patches: DataFrame, bce_weight: float = 1.0, region_weight: float = 1.0, use_tversky: bool = False, alpha: float = 0.3, beta: float = 0.7, pos_weight: float = 1.0) -> DataFrame:
    """(batch_id, mask_bce, mask_dice or mask_tversky, mask_total)."""
    name = "mask_tversky" if use_tversky else "mask_dice"
    region = losses.tversky(F.col("mask_logits"), F.col("mask"), alpha, beta) if use_tversky else losses.dice(F.col("mask_logits"), F.col("mask"))
    each = patches.select("batch_id", F.size("mask").alias("n"), losses.bce_sum(F.col("mask_logits"), F.col("mask"), pos_weight).alias("bce"), region.alias("region"))
    out = each.groupBy("batch_id").agg((F.sum("bce") / F.sum("n")).alias("mask_bce"), (1 - F.avg("region")).alias(name))
    return out.withColumn("mask_total", bce_weight * F.col("mask_bce") + region_weight * F.col(name))


def channel_sums(patches: DataFrame, channels: int) -> DataFrame:
    """(batch_id, ch, n, s, q, k): count, sum and sum of squares of mu, and the sum of the KL, of each channel."""
    size = (F.size("mu") / channels).cast("int")
    c = F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("ch")
    part = patches.select("batch_id", "mu", "logvar", c)
    cut = part.select("batch_id", "ch", F.slice("mu", F.col("ch") * size + 1, size).alias("mu"), F.slice("logvar", F.col("ch") * size + 1, size).alias("lv"))
    each = cut.select("batch_id", "ch", F.size("mu").alias("n"), total("mu").alias("s"), total_of("mu", lambda m: m * m).alias("q"), total_pair("mu", "lv", losses.kl).alias("k"))
    return each.groupBy("batch_id", "ch").agg(*[F.sum(x).alias(x) for x in ("n", "s", "q", "k")])


def kl_losses(patches: DataFrame, channels: int, free_bits: float) -> DataFrame:
    """(batch_id, kl, freebits_used, kl_per_channel): clamped sum, share of clamped channels, raw values by channel."""
    by = channel_sums(patches, channels).withColumn("k", F.col("k") / F.col("n"))
    return by.groupBy("batch_id").agg(F.sum(F.greatest("k", F.lit(free_bits))).alias("kl"), F.avg((F.col("k") < free_bits).cast("double")).alias("freebits_used"), F.transform(F.array_sort(F.collect_list(F.struct("ch", "k"))), lambda x: x["k"]).alias("kl_per_channel"))


def total_losses(patches: DataFrame, channels: int, step: int, recon: str = "l1", recon_weight: float = 1.0, warmup: int = 5000, max_beta: float = 1.0, free_bits: float = 0.0, **mask) -> DataFrame:
    """(batch_id, xct, mask_total, kl, beta, total): reconstruction, mask and weighted divergence together."""
    out = reconstruction_losses(patches).select("batch_id", F.col(recon).alias("xct")).join(mask_losses(patches, **mask).select("batch_id", "mask_total"), "batch_id").join(kl_losses(patches, channels, free_bits).select("batch_id", "kl"), "batch_id")
    out = out.withColumn("beta", losses.beta(F.lit(float(step)), warmup, max_beta))
    return out.withColumn("total", recon_weight * F.col("xct") + F.col("mask_total") + F.col("beta") * F.col("kl"))


def psnr(mse: Column, most: float = 1.0) -> Column:
    """Peak signal-to-noise ratio; infinite without an error."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(most * most / F.when(mse == 0, 1.0).otherwise(mse)))


def segmentation(patches: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(batch_id, dice, iou, precision, recall, f1 with _all and _pos_only): scores by patch averaged, counts pooled.

    ``_pos_only`` looks at patches with a positive voxel alone, and is 0 in a batch without any.
    """
    hit = lambda x: F.when(sigmoid(x) >= threshold, 1.0).otherwise(0.0)
    each = patches.select("batch_id", total_pair("mask_logits", "mask", lambda x, y: hit(x) * y).alias("tp"), total_pair("mask_logits", "mask", lambda x, y: hit(x) * (1 - y)).alias("fp"), total_pair("mask_logits", "mask", lambda x, y: (1 - hit(x)) * y).alias("fn"), (total("mask") > 0).alias("positive"))
    each = each.withColumns({"dice": (2 * F.col("tp") + TINY) / (2 * F.col("tp") + F.col("fp") + F.col("fn") + TINY), "iou": (F.col("tp") + TINY) / (F.col("tp") + F.col("fp") + F.col("fn") + TINY)})
    out = each.groupBy("batch_id")
    of = {"all": F.lit(True), "pos_only": F.col("positive")}
    sums = out.agg(*[f(F.when(on, F.col(c))).alias(f"{c}_{name}") for name, on in of.items() for c, f in (("tp", F.sum), ("fp", F.sum), ("fn", F.sum), ("dice", F.avg), ("iou", F.avg))])
    columns = ["batch_id"]
    for name in of:
        tp, fp, fn = (F.col(f"{c}_{name}") for c in ("tp", "fp", "fn"))
        precision, recall = (tp + TINY) / (tp + fp + TINY), (tp + TINY) / (tp + fn + TINY)
        scores = {"dice": F.col(f"dice_{name}"), "iou": F.col(f"iou_{name}"), "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall + TINY)}
        columns += [F.coalesce(v, F.lit(0.0)).alias(f"{k}_{name}") for k, v in scores.items()]
    return sums.select(*columns)


def porosity(patches: DataFrame) -> DataFrame:
    """(vec_id, volume_id, batch_id, error, predicted): soft porosity against the true one, signed."""
    predicted = total_of("mask_logits", sigmoid) / F.size("mask_logits")
    return patches.select("vec_id", "volume_id", "batch_id", (predicted - mean("mask")).alias("error"), predicted.alias("predicted"))


def porosity_metrics(patches: DataFrame) -> DataFrame:
    """(batch_id, porosity_mae, porosity_bias, porosity_pred_mean)."""
    return porosity(patches).groupBy("batch_id").agg(F.avg(F.abs("error")).alias("porosity_mae"), F.avg("error").alias("porosity_bias"), F.avg("predicted").alias("porosity_pred_mean"))


def volume_porosity_errors(patches: DataFrame) -> DataFrame:
    """(volume_id, porosity_error): the absolute value of a volume's mean signed error."""
    return porosity(patches).groupBy("volume_id").agg(F.abs(F.avg("error")).alias("porosity_error"))


def reconstruction(patches: DataFrame, side: int) -> DataFrame:
    """(batch_id, mae, mse, psnr, sharpness_recon, sharpness_gt, sharpness_recon_over_gt, recon_xct_mean, recon_xct_std).

    Errors are of the logits, sharpness of their sigmoids; without sharpness in the truth the ratio is NaN.
    """
    each = patches.select("batch_id", F.size("xct").alias("n"), losses.l1_sum(F.col("xct_logits"), F.col("xct")).alias("a"), losses.mse_sum(F.col("xct_logits"), F.col("xct")).alias("e"), total("xct_logits").alias("s"), total_of("xct_logits", lambda x: x * x).alias("q"),
                          sharpness(F.transform("xct_logits", sigmoid), side).alias("sharp"), sharpness(F.col("xct"), side).alias("sharp_gt"))
    out = each.groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in ("n", "a", "e", "s", "q")], F.avg("sharp").alias("sharpness_recon"), F.avg("sharp_gt").alias("sharpness_gt"))
    mse = F.col("e") / F.col("n")
    variance = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)) / F.when(F.col("n") > 1, F.col("n") - 1)
    return out.select("batch_id", (F.col("a") / F.col("n")).alias("mae"), mse.alias("mse"), psnr(mse).alias("psnr"), "sharpness_recon", "sharpness_gt", ratio(F.col("sharpness_recon"), F.col("sharpness_gt")).alias("sharpness_recon_over_gt"), (F.col("s") / F.col("n")).alias("recon_xct_mean"), F.sqrt(variance).alias("recon_xct_std"))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, NaN elsewhere."""
    return F.when(b > 0, a / F.when(b > 0, b).otherwise(1.0)).otherwise(F.lit(float("nan")))


def latent_stats(patches: DataFrame) -> DataFrame:
    """(batch_id, mu_mean, mu_std, logvar_mean, logvar_std, sigma_mean); deviations are the sample's."""
    sums = [f(c).alias(f"{c}_{k}") for c in ("mu", "logvar") for k, f in (("s", total), ("q", lambda c: total_of(c, lambda v: v * v)))]
    each = patches.select("batch_id", F.size("mu").alias("n"), *sums, total_of("logvar", lambda v: F.exp(0.5 * v)).alias("sigma"))
    out = each.groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in each.columns if c != "batch_id"])
    std = lambda c: F.sqrt(F.greatest(F.col(f"{c}_q") - F.col(f"{c}_s") * F.col(f"{c}_s") / F.col("n"), F.lit(0.0)) / F.when(F.col("n") > 1, F.col("n") - 1))
    return out.select("batch_id", *[x for c in ("mu", "logvar") for x in ((F.col(f"{c}_s") / F.col("n")).alias(f"{c}_mean"), std(c).alias(f"{c}_std"))], (F.col("sigma") / F.col("n")).alias("sigma_mean"))


def variance(n: Column, s: Column, q: Column) -> Column:
    """The sample variance from moments; 0 for one value or none, never negative."""
    return F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))).otherwise(0.0)


def merged_moments(by_batch: DataFrame) -> DataFrame:
    """(ch, n, s, q) of all batches."""
    return by_batch.groupBy("ch").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])


def active_units(moments: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(n_active, n_total, active_fraction): channels whose variance exceeds the threshold; zeros without channels."""
    active = F.coalesce(F.sum(F.when(variance(F.col("n"), F.col("s"), F.col("q")) > threshold, 1).otherwise(0)), F.lit(0).cast("long"))
    out = moments.agg(active.alias("n_active"), F.count(F.lit(1)).alias("n_total"))
    return out.withColumn("active_fraction", F.col("n_active") / F.greatest("n_total", F.lit(1)))


def mean_of_batches(metrics: DataFrame) -> DataFrame:
    """One row: the mean over batches of every number, and of the values of a list together."""
    lists = {f.name for f in metrics.schema if f.dataType.typeName() == "array"}
    return metrics.agg(*[(F.sum(total(c)) / F.sum(F.size(c)) if c in lists else F.avg(c)).alias(c) for c in metrics.columns if c != "batch_id"])


def evaluated(patches: DataFrame, channels: int, side: int) -> DataFrame:
    """One row: all metrics averaged over batches, and the active units of the merged moments."""
    by = reconstruction(patches, side)
    for other in (segmentation(patches), porosity_metrics(patches), latent_stats(patches)):
        by = by.join(other, "batch_id")
    one = F.lit(1).alias("one")  # both sides are a single row
    return mean_of_batches(by).select("*", one).join(active_units(merged_moments(channel_sums(patches, channels))).select("*", one), "one").drop("one")


def rolling_active(by_batch: DataFrame, window: int = 50, threshold: float = 0.01) -> DataFrame:
    """(batch_id, n_active): active units over the moments of the last ``window`` batches, each channel on its own."""
    last = Window.partitionBy("ch").orderBy("batch_id").rowsBetween(1 - window, 0)
    return counted_active(by_batch.select("batch_id", "ch", *[F.sum(c).over(last).alias(c) for c in ("n", "s", "q")]), threshold)


def counted_active(rolled: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(batch_id, n_active) of moments (batch_id, ch, n, s, q): the channels whose variance exceeds the threshold."""
    return rolled.groupBy("batch_id").agg(F.sum(F.when(variance(F.col("n"), F.col("s"), F.col("q")) > threshold, 1).otherwise(0)).alias("n_active"))


def active_channels(freebits_used: Column, channels: int) -> Column:
    """Channels that the free bits don't hold down; a half rounds to the even number."""
    return channels - F.bround(freebits_used * channels)


def voxel_moments(draws: DataFrame) -> DataFrame:
    """(patch_id, voxel, mean, std) of draws (patch_id, voxel, value); the sample's deviation, 0 for a single draw."""
    return draws.groupBy("patch_id", "voxel").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def monte_carlo(draws: DataFrame) -> DataFrame:
    """(patch_id, diversity, collapsed) from draws (patch_id, voxel, value): the mean over voxels of the draws' deviation."""
    return voxel_moments(draws).groupBy("patch_id").agg(F.avg("std").alias("diversity")).withColumn("collapsed", F.col("diversity") < 1e-5)
