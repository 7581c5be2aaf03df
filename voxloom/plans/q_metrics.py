"""Loss and metric queries. The oracles work on one row per voxel."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import losses
from voxloom.functions.arrays import central_slice, sharpness, total_of
from voxloom.operators import patch_metrics as pm
from voxloom.plans import stand_ins as si
from voxloom.plans.catalog import query
from voxloom.scratch import fresh_path, saved
from voxloom.streaming import log_monitor as lm

W = f"WITH {si.OUTPUT_SQL}"


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_sql(name, sql):
    return query(name, f"{W} {sql}" if sql.lstrip().startswith("SELECT") else f"{W}, {sql}")


@with_sql("ref61_reconstruction_losses", "SELECT batch_id, round(avg(abs(xl - xct)), 6) AS l1, round(avg((xl - xct) ** 2), 6) AS mse, round(avg(sqrt((xl - xct) ** 2 + 1e-12)), 6) AS charbonnier FROM p GROUP BY 1")
def reconstruction_losses(spark, sf):
    return rounded(pm.reconstruction_losses(si.model_output(spark, sf)))


_MASK = """m AS (SELECT batch_id, vec_id, avg(-(2.0 * mask * ln(1 / (1 + exp(-ml))) + (1 - mask) * ln(1 - 1 / (1 + exp(-ml))))) AS bce, sum(mask / (1 + exp(-ml))) AS tp, sum(1 / (1 + exp(-ml))) AS sp, sum(mask) AS st FROM p GROUP BY 1, 2)"""


@with_sql("ref64_mask_losses_dice", _MASK + ", d AS (SELECT batch_id, avg(bce) AS b, 1 - avg((2 * tp + 1) / (sp + st + 1)) AS d FROM m GROUP BY 1) SELECT batch_id, round(b, 6) AS mask_bce, round(d, 6) AS mask_dice, round(0.5 * b + 2 * d, 6) AS mask_total FROM d")
def mask_losses_dice(spark, sf):
    return rounded(pm.mask_losses(si.model_output(spark, sf), 0.5, 2.0, pos_weight=2.0))


@with_sql("ref66_mask_losses_tversky", _MASK + ", d AS (SELECT batch_id, avg(bce) AS b, 1 - avg((tp + 1) / (tp + 0.3 * (sp - tp) + 0.7 * (st - tp) + 1)) AS d FROM m GROUP BY 1) SELECT batch_id, round(b, 6) AS mask_bce, round(d, 6) AS mask_tversky, round(b + d, 6) AS mask_total FROM d")
def mask_losses_tversky(spark, sf):
    return rounded(pm.mask_losses(si.model_output(spark, sf), use_tversky=True, pos_weight=2.0))


_KL = "k AS (SELECT batch_id, ch, avg(0.5 * (mu * mu + exp(logvar) - logvar - 1)) AS k FROM p GROUP BY 1, 2)"


@with_sql("ref68_kl", _KL + " SELECT batch_id, round(sum(greatest(k, 0.015)), 6) AS kl, round(avg((k < 0.015)::INT), 6) AS freebits_used FROM k GROUP BY 1")
def kl(spark, sf):
    return rounded(pm.kl_losses(si.model_output(spark, sf), 8, 0.015).drop("kl_per_channel"))


@with_sql("ref78_kl_per_channel", _KL + " SELECT batch_id, ch::INT AS ch, round(k, 6) AS kl FROM k")
def kl_per_channel(spark, sf):
    return rounded(pm.kl_losses(si.model_output(spark, sf), 8, 0.0).select("batch_id", F.posexplode("kl_per_channel").alias("ch", "kl")))


@query("ref69_beta_schedule", "SELECT event_id AS step, round(least(0.05, 0.05 * event_id / 500), 9) AS beta, 0.05::DOUBLE AS at_once FROM events")
def beta(spark, sf):
    return si.table(spark, sf, "events").select(F.col("event_id").alias("step"), F.round(losses.beta(F.col("event_id"), 500, 0.05), 9).alias("beta"), losses.beta(F.col("event_id"), 0, 0.05).alias("at_once"))


@with_sql("ref70_total_loss", _MASK + ", " + _KL + ", r AS (SELECT batch_id, avg(abs(xl - xct)) AS x FROM p GROUP BY 1), d AS (SELECT batch_id, avg(bce) + 1 - avg((2 * tp + 1) / (sp + st + 1)) AS m FROM m GROUP BY 1), q AS (SELECT batch_id, sum(greatest(k, 0.015)) AS k FROM k GROUP BY 1) SELECT batch_id, round(x, 6) AS xct, round(m, 6) AS mask_total, round(k, 6) AS kl, 0.02::DOUBLE AS beta, round(x + m + 0.02 * k, 6) AS total FROM r JOIN d USING (batch_id) JOIN q USING (batch_id)")
def total_loss(spark, sf):
    return rounded(pm.total_losses(si.model_output(spark, sf), 8, 2000, warmup=5000, max_beta=0.05, free_bits=0.015, pos_weight=2.0))


_SHARP = "sh AS (SELECT a.batch_id, a.vec_id, avg(abs(b.{v} - a.{v})) FILTER (b.z = a.z + 1) AS dz, avg(abs(b.{v} - a.{v})) FILTER (b.y = a.y + 1) AS dy, avg(abs(b.{v} - a.{v})) FILTER (b.x = a.x + 1) AS dx FROM {t} a JOIN {t} b ON a.vec_id = b.vec_id AND b.z + b.y + b.x = a.z + a.y + a.x + 1 AND b.z >= a.z AND b.y >= a.y AND b.x >= a.x GROUP BY 1, 2)"


@with_sql("ref71_reconstruction_metrics", "SELECT batch_id, round(avg(abs(xl - xct)), 6) AS mae, round(avg((xl - xct) ** 2), 6) AS mse, round(10 * log10(1 / avg((xl - xct) ** 2)), 6) AS psnr, round(avg(xl), 6) AS recon_xct_mean, round(stddev_samp(xl), 6) AS recon_xct_std FROM p GROUP BY 1")
def reconstruction_metrics(spark, sf):
    return rounded(pm.reconstruction(si.model_output(spark, sf), 4).select("batch_id", "mae", "mse", "psnr", "recon_xct_mean", "recon_xct_std"))


@with_sql("ref73_sharpness", _SHARP.format(v="xct", t="p") + " SELECT vec_id, round((dz + dy + dx) / 3, 6) AS sharpness FROM sh")
def sharpness_proxy(spark, sf):
    return si.model_output(spark, sf).select("vec_id", F.round(sharpness(F.col("xct"), 4), 6).alias("sharpness"))


_SEG = """s AS (SELECT batch_id, vec_id, sum(mask * (ml >= 0)::INT) AS tp, sum((1 - mask) * (ml >= 0)::INT) AS fp, sum(mask * (ml < 0)::INT) AS fn, sum(mask) > 0 AS pos FROM p GROUP BY 1, 2),
i AS (SELECT *, (2 * tp + 1e-7) / (2 * tp + fp + fn + 1e-7) AS d, (tp + 1e-7) / (tp + fp + fn + 1e-7) AS u FROM s),
a AS (SELECT batch_id, 'all' AS k, avg(d) AS d, avg(u) AS u, (sum(tp) + 1e-7) / (sum(tp) + sum(fp) + 1e-7) AS p, (sum(tp) + 1e-7) / (sum(tp) + sum(fn) + 1e-7) AS r FROM i GROUP BY 1
      UNION ALL SELECT batch_id, 'pos_only', avg(d) FILTER (pos), avg(u) FILTER (pos), (sum(tp) FILTER (pos) + 1e-7) / (sum(tp) FILTER (pos) + sum(fp) FILTER (pos) + 1e-7), (sum(tp) FILTER (pos) + 1e-7) / (sum(tp) FILTER (pos) + sum(fn) FILTER (pos) + 1e-7) FROM i GROUP BY 1),
b AS (SELECT batch_id, k, coalesce(d, 0) AS d, coalesce(u, 0) AS u, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(2 * p * r / (p + r + 1e-7), 0) AS f FROM a)"""
_SCORES = ", ".join(f"round(max({c}) FILTER (k = '{k}'), 6) AS {n}_{k}" for k in ("all", "pos_only") for c, n in (("d", "dice"), ("u", "iou"), ("p", "precision"), ("r", "recall"), ("f", "f1")))


@with_sql("ref74_segmentation", f"{_SEG} SELECT batch_id, {_SCORES} FROM b GROUP BY 1")
def segmentation(spark, sf):
    return rounded(pm.segmentation(si.model_output(spark, sf)))


_POR = "o AS (SELECT vec_id, volume_id, batch_id, avg(1 / (1 + exp(-ml))) AS s, avg(mask) AS t FROM p GROUP BY ALL)"


@with_sql("ref75_porosity", _POR + " SELECT batch_id, round(avg(abs(s - t)), 6) AS porosity_mae, round(avg(s - t), 6) AS porosity_bias, round(avg(s), 6) AS porosity_pred_mean FROM o GROUP BY 1")
def porosity(spark, sf):
    return rounded(pm.porosity_metrics(si.model_output(spark, sf)))


_MOM = "g AS (SELECT batch_id, ch, count(*) AS n, sum(mu) AS s, sum(mu * mu) AS q FROM p GROUP BY 1, 2)"


@with_sql("ref76_channel_moments", _MOM + " SELECT ch::INT AS ch, sum(n)::BIGINT AS n, round(sum(s), 6) AS s, round(sum(q), 6) AS q FROM g GROUP BY 1")
def channel_moments(spark, sf):
    return rounded(pm.merged_moments(pm.channel_sums(si.model_output(spark, sf), 8)))


@with_sql("ref77_active_units", "v AS (SELECT ch, var_samp(mu) AS v FROM p GROUP BY 1) SELECT count(*) FILTER (v > 0.0155) AS n_active, count(*) AS n_total, round(count(*) FILTER (v > 0.0155) / count(*), 6) AS active_fraction FROM v")
def active_units(spark, sf):
    return rounded(pm.active_units(pm.merged_moments(pm.channel_sums(si.model_output(spark, sf), 8)), 0.0155))


@with_sql("ref79_latent_stats", "SELECT batch_id, round(avg(mu), 6) AS mu_mean, round(stddev_samp(mu), 6) AS mu_std, round(avg(logvar), 6) AS logvar_mean, round(stddev_samp(logvar), 6) AS logvar_std, round(avg(exp(0.5 * logvar)), 6) AS sigma_mean FROM p GROUP BY 1")
def latent_stats(spark, sf):
    return rounded(pm.latent_stats(si.model_output(spark, sf)))


@with_sql("ref80_mean_of_batches", _KL + " SELECT round((SELECT avg(l) FROM (SELECT avg(abs(xl - xct)) AS l FROM p GROUP BY batch_id)), 6) AS l1, round((SELECT avg(k) FROM k), 6) AS kl_per_channel")
def mean_of_batches(spark, sf):
    p = si.model_output(spark, sf)
    return rounded(pm.mean_of_batches(pm.reconstruction_losses(p).select("batch_id", "l1").join(pm.kl_losses(p, 8, 0.0).select("batch_id", "kl_per_channel"), "batch_id")))


@with_sql("ref81_evaluation", f"""{_SEG}, {_POR}, {_SHARP.format(v='xct', t='p')}, pg AS (SELECT * REPLACE (1 / (1 + exp(-xl)) AS xl) FROM p), {_SHARP.format(v='xl', t='pg').replace('sh AS', 'sr AS')},
r AS (SELECT batch_id, avg(abs(xl - xct)) AS mae, 10 * log10(1 / avg((xl - xct) ** 2)) AS psnr FROM p GROUP BY 1),
s1 AS (SELECT batch_id, avg((dz + dy + dx) / 3) AS g FROM sh GROUP BY 1), s2 AS (SELECT batch_id, avg((dz + dy + dx) / 3) AS g FROM sr GROUP BY 1),
v AS (SELECT ch, var_samp(mu) AS v FROM p GROUP BY 1)
SELECT round((SELECT avg(mae) FROM r), 6) AS mae, round((SELECT avg(psnr) FROM r), 6) AS psnr, round((SELECT avg(s2.g / s1.g) FROM s1 JOIN s2 USING (batch_id)), 6) AS sharpness_recon_over_gt, round((SELECT avg(d) FROM b WHERE k = 'pos_only'), 6) AS dice_pos_only,
       round((SELECT avg(m) FROM (SELECT avg(abs(s - t)) AS m FROM o GROUP BY batch_id)), 6) AS porosity_mae, round((SELECT avg(m) FROM (SELECT stddev_samp(mu) AS m FROM p GROUP BY batch_id)), 6) AS mu_std, (SELECT count(*) FROM v WHERE v > 0.01) AS n_active""")
def evaluation(spark, sf):
    return rounded(pm.evaluated(si.model_output(spark, sf), 8, 4).select("mae", "psnr", "sharpness_recon_over_gt", "dice_pos_only", "porosity_mae", "mu_std", "n_active"))


@with_sql("ref82_volume_porosity_errors", _POR + " SELECT volume_id, round(abs(avg(s - t)), 6) AS porosity_error FROM o GROUP BY 1")
def volume_porosity_errors(spark, sf):
    return rounded(pm.volume_porosity_errors(si.model_output(spark, sf)))


_ROLLED = _MOM + ", w AS (SELECT batch_id, ch, sum(n) OVER l AS n, sum(s) OVER l AS s, sum(q) OVER l AS q FROM g WINDOW l AS (PARTITION BY ch ORDER BY batch_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT batch_id, count(*) FILTER (greatest((q - s * s / n) / (n - 1), 0) > 0.0155) AS n_active FROM w GROUP BY 1"


@with_sql("ref83_rolling_active_units", _ROLLED)
def rolling(spark, sf):
    return pm.rolling_active(pm.channel_sums(si.model_output(spark, sf), 8), 4, 0.0155)


@with_sql("ref83_rolling_stream", _ROLLED)
def rolling_stream(spark, sf):
    """The same over a log that grows: three times what was appended is streamed, from the checkpoint of the time before."""
    sums = saved(pm.channel_sums(si.model_output(spark, sf), 8), "sums")
    log, out, checkpoint = (fresh_path(spark, n) for n in ("log", "rolled", "checkpoint"))
    n = sums.agg(F.max("batch_id")).first()[0] + 1
    for k in range(3):
        sums.where(F.floor(F.col("batch_id") * 3 / n) == k).write.mode("append").json(log)
        stream = lm.rolling_moments(lm.logs(spark, log, lm.MOMENTS), 4)
        lm.appended(stream, out, checkpoint).awaitTermination()
    return pm.counted_active(spark.read.schema(lm.MOMENTS).json(out), 0.0155)


@query("ref84_active_channels", "SELECT event_id, (8 - CASE WHEN h % 2 = 0 THEN h // 2 WHEN (h // 2) % 2 = 0 THEN h // 2 ELSE h // 2 + 1 END)::DOUBLE AS active FROM (SELECT event_id, event_id % 17 AS h FROM events)")
def active_channels(spark, sf):
    return si.table(spark, sf, "events").select("event_id", pm.active_channels((F.col("event_id") % 17) / 16.0, 8).cast("double").alias("active"))


@with_sql("ref85_monte_carlo", "d AS (SELECT volume_id AS patch_id, pos, stddev_samp(xl) AS s FROM p GROUP BY 1, 2) SELECT patch_id, round(avg(coalesce(s, 0)), 6) AS diversity, avg(coalesce(s, 0)) < 1e-5 AS collapsed FROM d GROUP BY 1")
def monte_carlo(spark, sf):
    draws = si.model_output(spark, sf).select(F.col("volume_id").alias("patch_id"), F.posexplode("xct_logits").alias("voxel", "value"))
    return rounded(pm.monte_carlo(draws))


@with_sql("ref86_central_slices", "SELECT vec_id, round(sum(xct) FILTER (z = 2), 6) AS z, round(sum(xct) FILTER (y = 2), 6) AS y, round(sum(xct) FILTER (x = 2), 6) AS x FROM p GROUP BY 1")
def central_slices(spark, sf):
    return si.model_output(spark, sf).select("vec_id", *[F.round(total_of(central_slice(F.col("xct"), 4, k), lambda v: v), 6).alias(a) for k, a in enumerate("zyx")])


@query("ref87_showcase_batch", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 8")
def showcase(spark, sf):
    return si.table(spark, sf, "embeddings").select("vec_id", "label").orderBy("vec_id").limit(8)


@with_sql("ref65_samplewise_losses", _MASK + ", c AS (SELECT vec_id, avg(sqrt((1 / (1 + exp(-xl)) - xct) ** 2 + 1e-12)) AS c FROM p GROUP BY 1) SELECT vec_id, round((2 * tp + 1) / (sp + st + 1), 6) AS dice, round(c, 6) AS charbonnier FROM m JOIN c USING (vec_id)")
def samplewise(spark, sf):
    from voxloom.functions.arrays import sigmoid

    p = si.model_output(spark, sf)
    return p.select("vec_id", F.round(losses.dice(F.col("mask_logits"), F.col("mask")), 6).alias("dice"), F.round(losses.charbonnier_sum(F.transform("xct_logits", sigmoid), F.col("xct")) / F.size("xct"), 6).alias("charbonnier"))
