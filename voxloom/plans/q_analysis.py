"""Texture and latent space queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.arrays import channel_means, gradient_density, sigmoid
from voxloom.operators import latent as la
from voxloom.operators import texture as tx
from voxloom.plans import stand_ins as si
from voxloom.plans.catalog import query
from voxloom.plans.q_metrics import _SHARP, rounded, with_sql

SIDE = 4
_MAP = """nb AS (SELECT a.vec_id, a.pos, sum(b.mask) / 27 AS m1, sum(b.mask * b.mask) / 27 AS m2 FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2),
vm AS (SELECT vec_id, pos, round(greatest(m2 - m1 * m1, 0), 12) AS v FROM nb), den AS (SELECT vec_id, avg(v) AS density FROM vm GROUP BY 1)"""
_COMP = f"""{_MAP}, pg AS (SELECT * REPLACE (1 / (1 + exp(-xl)) AS xl) FROM p), px AS (SELECT *, 0.5 * xl + 0.25 AS au FROM pg),
{_SHARP.format(v='xct', t='p')}, {_SHARP.format(v='xl', t='pg').replace('sh AS', 'so AS')}, {_SHARP.format(v='au', t='px').replace('sh AS', 'sa AS')},
l AS (SELECT vec_id, volume_id, avg(mask) AS porosity, avg(sqrt((xl - xct) ** 2 + 1e-12)) AS lo, avg(sqrt((au - xct) ** 2 + 1e-12)) AS lx FROM px GROUP BY 1, 2),
c AS (SELECT CASE WHEN l.vec_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, l.vec_id AS dataset_index, l.*, density, (sh.dz + sh.dy + sh.dx) / 3 AS g, (so.dz + so.dy + so.dx) / 3 AS o, (sa.dz + sa.dy + sa.dx) / 3 AS a, CASE WHEN density >= 0.02 THEN 'high_transition' ELSE 'interior' END AS label
      FROM l JOIN den USING (vec_id) JOIN sh USING (vec_id) JOIN so USING (vec_id) JOIN sa USING (vec_id))"""


def maps(spark, sf):
    return tx.with_variance_map(si.model_output(spark, sf).select("vec_id", "mask"), SIDE, 3)


def compared(spark, sf):
    p = si.model_output(spark, sf)
    p = p.withColumns({"split": F.when(F.col("vec_id") % 2 == 0, "val").otherwise("test"), "dataset_index": F.col("vec_id"), "aux": F.transform("xct_logits", lambda x: 0.5 * sigmoid(x) + 0.25), **{a: (F.col("vec_id") % 8 * k).cast("int") for k, a in enumerate(("z0", "y0", "x0"), 1)}})
    return tx.compared_decoders(p, "aux", 0.02, SIDE, 3)


@with_sql("ref100_variance_map", _MAP + " SELECT vec_id, pos::INT AS pos, round(v, 6) AS v FROM vm")
def variance_map(spark, sf):
    return rounded(maps(spark, sf).select("vec_id", F.posexplode("variance_map").alias("pos", "v")))


@with_sql("ref101_variance_density", _MAP + " SELECT vec_id, round(density, 6) AS density FROM den")
def variance_density(spark, sf):
    return rounded(maps(spark, sf).select("vec_id", tx.variance_density(F.col("variance_map")).alias("density")))


@with_sql("ref102_gradient_density", _SHARP.format(v="mask", t="p") + " SELECT vec_id, round((dz + dy + dx) / 3, 6) AS density FROM sh")
def gradient(spark, sf):
    return rounded(si.model_output(spark, sf).select("vec_id", gradient_density(F.col("mask"), SIDE).alias("density")))


@with_sql("ref103_percentile_threshold", _MAP + " SELECT round(quantile_cont(density::FLOAT::DOUBLE, 0.75), 6) AS threshold FROM den")
def threshold(spark, sf):
    d = maps(spark, sf).select(F.round(tx.variance_density(F.col("variance_map")), 12).alias("density"))
    return spark.createDataFrame([(round(tx.percentile_threshold(d, "density"), 6),)], "threshold double")


@with_sql("ref104_transition_focus", _MAP + ", f AS (SELECT vec_id, arg_max(pos, (v, -pos)) AS spot FROM vm GROUP BY 1) SELECT vec_id, (spot // 16)::INT AS z, ((spot // 4) % 4)::INT AS y, (spot % 4)::INT AS x FROM f")
def focus(spark, sf):
    m = maps(spark, sf).withColumn("m", F.transform("variance_map", lambda v: F.round(v, 12)))
    return m.select("vec_id", tx.focus(F.col("m"), SIDE).alias("f")).select("vec_id", "f.*")


@with_sql("ref105_channel_means", "SELECT vec_id, ch::INT AS ch, round(avg(mu), 6) AS mean FROM p GROUP BY 1, 2")
def means(spark, sf):
    return rounded(si.model_output(spark, sf).select("vec_id", F.posexplode(channel_means(F.col("mu"), 8)).alias("ch", "mean")))


_COLS = "split, dataset_index, volume_id, (vec_id % 8)::INT AS z0, (vec_id % 8 * 2)::INT AS y0, (vec_id % 8 * 3)::INT AS x0, round(porosity, 6) AS porosity, round(density, 6) AS transition_density, label AS transition_label, round(lo, 6) AS xct_loss_original, round(lx, 6) AS xct_loss_auxiliary, round(g, 6) AS sharpness_gt, round(o, 6) AS sharpness_recon_original, round(a, 6) AS sharpness_recon_auxiliary, round(CASE WHEN g > 0 THEN o / g ELSE 'nan'::DOUBLE END, 6) AS sharpness_ratio_original, round(CASE WHEN g > 0 THEN a / g ELSE 'nan'::DOUBLE END, 6) AS sharpness_ratio_auxiliary"


@with_sql("ref109_compared_decoders", f"{_COMP} SELECT {_COLS} FROM c")
def compared_decoders(spark, sf):
    return rounded(compared(spark, sf))


@with_sql("ref112_summary_by_label", f"{_COMP} SELECT split, label AS transition_label, count(*) AS n, round(avg(lo), 6) AS xct_loss_original, round(avg(lo - lx), 6) AS loss_gain, round(avg(abs(o / g - 1)) FILTER (g > 0), 6) AS ratio_error_original FROM c GROUP BY 1, 2")
def summary(spark, sf):
    return rounded(tx.summarised(tx.with_gains(compared(spark, sf)), ["split", "transition_label"], ["xct_loss_original", "loss_gain", "ratio_error_original"]))


@with_sql("ref113_top_per_class", f"{_COMP}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(lo - lx, 9) DESC, split, dataset_index) AS k FROM c) SELECT split, dataset_index, label AS transition_label, round(lo - lx, 6) AS loss_gain FROM r WHERE k <= 3")
def top(spark, sf):
    rows = tx.with_gains(compared(spark, sf)).withColumn("loss_gain", F.round("loss_gain", 9))
    return rounded(tx.top_per_class(rows, "transition_label", "loss_gain").select("split", "dataset_index", "transition_label", "loss_gain"))


@query("ref111_union_of_splits", "SELECT CASE WHEN event_type IN ('view', 'error') THEN 'val' ELSE 'test' END AS split, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def union(spark, sf):
    e = si.table(spark, sf, "events").withColumn("val", F.coalesce(F.col("event_type").isin("view", "error"), F.lit(False)))
    both = e.where("val").withColumn("split", F.lit("val")).unionByName(e.where("NOT val").withColumn("split", F.lit("test")))
    return both.groupBy("split", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("ref114_described", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS max FROM events")
def described(spark, sf):
    return rounded(tx.described(si.table(spark, sf, "events"), "value"))


_CLASS = f"""{_MAP}, po AS (SELECT vec_id, avg(mask) AS porosity FROM p GROUP BY 1), th AS (SELECT quantile_cont(round(density, 12)::FLOAT::DOUBLE, 0.75) AS t FROM den), tp AS (SELECT quantile_cont(porosity::FLOAT::DOUBLE, 0.75) AS t FROM po),
cl AS (SELECT vec_id, CASE WHEN round(density, 12) >= (SELECT t FROM th) THEN 'high_transition' WHEN porosity >= (SELECT t FROM tp) THEN 'high_porosity' ELSE 'interior' END AS patch_class FROM den JOIN po USING (vec_id))"""


def classes(spark, sf):
    p = tx.with_variance_map(si.model_output(spark, sf).select("vec_id", "mask", "mu"), SIDE, 3)
    rows = p.select("vec_id", "mu", F.round(tx.variance_density(F.col("variance_map")), 12).alias("density"), tx.mean("mask").alias("porosity"))
    return rows.withColumn("patch_class", tx.three_way(F.col("density"), tx.percentile_threshold(rows, "density"), F.col("porosity"), tx.percentile_threshold(rows, "porosity")))


@with_sql("ref115_three_way_class", f"{_CLASS} SELECT * FROM cl")
def three_way(spark, sf):
    return classes(spark, sf).select("vec_id", "patch_class")


@with_sql("ref116_class_counts", f"{_CLASS} SELECT patch_class, count(*) AS n FROM cl GROUP BY 1")
def class_counts(spark, sf):
    return classes(spark, sf).groupBy("patch_class").agg(F.count(F.lit(1)).alias("n"))


@query("ref117_reservoir", "SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id::VARCHAR), vec_id) AS k FROM embeddings) WHERE k <= 1024")
def reservoir(spark, sf):
    return la.reservoir(si.table(spark, sf, "embeddings").select("label", "vec_id"), "label", "vec_id")


@with_sql("ref118_channel_table", "SELECT vec_id, " + ", ".join(f"round(avg(mu) FILTER (ch = {c}), 6) AS mu_ch{c:02d}_mean" for c in range(8)) + " FROM p GROUP BY 1")
def channel_table(spark, sf):
    m = channel_means(F.col("mu"), 8)
    return rounded(si.model_output(spark, sf).select("vec_id", m.alias("m")).select("vec_id", *[F.get("m", F.lit(c)).alias(f"mu_ch{c:02d}_mean") for c in range(8)]))


@with_sql("ref119_channel_correlations", "m AS (SELECT vec_id, ch, avg(mu) AS m FROM p GROUP BY 1, 2), d AS (SELECT vec_id, avg(mask) AS d FROM p GROUP BY 1) SELECT 'mu_ch' || lpad(ch::VARCHAR, 2, '0') || '_mean' AS channel, round(corr(m, d), 6) AS r FROM m JOIN d USING (vec_id) GROUP BY 1")
def correlations(spark, sf):
    p = si.model_output(spark, sf).select(channel_means(F.col("mu"), 8).alias("m"), tx.mean("mask").alias("density"))
    names = [f"mu_ch{c:02d}_mean" for c in range(8)]
    return rounded(la.correlations(p.select("density", *[F.get("m", F.lit(c)).alias(n) for c, n in enumerate(names)]), names, "density"))


@with_sql("ref120_scaled", "s AS (SELECT pos, avg(mu) AS m, stddev_pop(mu) AS d FROM p GROUP BY 1) SELECT vec_id, round(sum(abs((mu - m) / d)), 6) AS total FROM p JOIN s USING (pos) GROUP BY 1")
def scaled(spark, sf):
    return rounded(la.scaled(si.table(spark, sf, "embeddings"), "embedding", 64).select("vec_id", F.aggregate("scaled", F.lit(0.0), lambda a, v: a + F.abs(v)).alias("total")))


@query("ref121_principal_components")
def components(spark, sf):
    e = si.table(spark, sf, "embeddings")
    mean, axes, _ = la.principal(e, "embedding", 64)
    return la.projected(e, "embedding", mean, axes).select("vec_id", F.transform("pc", lambda v: F.round(v, 6)).alias("pc"))


_DIST = "s AS (SELECT vec_id, (label < 5)::INT::VARCHAR AS label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), d AS (SELECT a.vec_id, a.label AS la, b.vec_id AS wid, b.label AS lb, list_distance(a.v, b.v) AS d FROM s a JOIN s b ON a.vec_id <> b.vec_id)"


def two(spark, sf):
    """All rows, in two classes of labels."""
    return si.table(spark, sf, "embeddings").withColumn("label", (F.col("label") < 5).cast("int").cast("string"))


@query("ref123_silhouette", f"WITH {_DIST}, m AS (SELECT vec_id, la, avg(d) FILTER (la = lb) AS a, avg(d) FILTER (la <> lb) AS b FROM d GROUP BY 1, 2) SELECT vec_id, round(coalesce((b - a) / greatest(a, b), 0), 5) AS silhouette FROM m")
def silhouette(spark, sf):
    return rounded(la.silhouettes(two(spark, sf), "embedding", "vec_id", "label", 64), 5)


@query("ref124_knn_accuracy", f"WITH {_DIST}, f AS (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('fold|' || vec_id::VARCHAR), vec_id) - 1) % 5 AS fold FROM s), n AS (SELECT d.vec_id, la, lb, x.fold, row_number() OVER (PARTITION BY d.vec_id ORDER BY d, wid) AS k FROM d JOIN f x ON x.vec_id = d.vec_id JOIN f y ON y.vec_id = d.wid WHERE x.fold <> y.fold), v AS (SELECT vec_id, fold, la, CASE WHEN count(*) FILTER (lb = '0') >= 3 THEN '0' ELSE '1' END AS got FROM n WHERE k <= 5 GROUP BY 1, 2, 3) SELECT fold::BIGINT AS fold, round(avg((la = got)::INT), 6) AS accuracy FROM v GROUP BY 1")
def knn(spark, sf):
    return rounded(la.knn_accuracy(two(spark, sf), "embedding", "vec_id", "label", 64))


@query("ref125_verdicts", "SELECT event_id, CASE WHEN value > 1.25 * 20 THEN 'keep auxiliary' ELSE 'no clear gain' END AS gain, CASE WHEN value / 100 > 0.65 AND value / 1000 > 0.05 THEN 'separated' ELSE 'not separated' END AS separation FROM events")
def verdicts(spark, sf):
    v = F.col("value")
    return si.table(spark, sf, "events").select("event_id", tx.gain_verdict(v, F.lit(20.0)).alias("gain"), la.separation_verdict(v / 100, v / 1000).alias("separation"))


@with_sql("ref126_crops", "SELECT vec_id, round(sum(xct) FILTER (z = 2 AND y BETWEEN 2 AND 3 AND x BETWEEN 0 AND 1), 6) AS corner FROM p GROUP BY 1")
def crops(spark, sf):
    from voxloom.functions.arrays import central_slice, total

    return rounded(si.model_output(spark, sf).select("vec_id", total(tx.crop(central_slice(F.col("xct"), 4, 0), 4, 4, F.lit(9), F.lit(0), 2)).alias("corner")))


@query("ref94_memorisation", "WITH s AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v, row_number() OVER (PARTITION BY vec_id % 4 = 0 ORDER BY md5('nn|' || vec_id::VARCHAR), vec_id) AS k, vec_id % 4 = 0 AS t FROM embeddings), m AS (SELECT a.vec_id, min(list_distance(a.v, b.v)) AS d FROM s a JOIN s b ON a.t AND NOT b.t AND a.k <= 1000 AND b.k <= 5000 GROUP BY 1) SELECT round(avg(d), 5) AS nn_mean, round(stddev_samp(d), 5) AS nn_std, count(*) AS n FROM m")
def memorisation(spark, sf):
    e = si.table(spark, sf, "embeddings")
    return rounded(la.memorisation(e.where("vec_id % 4 = 0"), e.where("vec_id % 4 <> 0"), "embedding", "vec_id", 64), 5)


@query("ref130_reparameterised")
def reparameterised(spark, sf):
    return la.reparameterised(si.model_output(spark, sf), 7).select("vec_id", "z")
