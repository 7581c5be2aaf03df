"""Volume statistics and patch index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import patch_index as pi
from voxloom.operators import statistics as st
from voxloom.plans import stand_ins as si
from voxloom.plans.catalog import query

_OTSU = """
hist AS (SELECT volume_id, v, count(*) AS n FROM voxels GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY volume_id ORDER BY v) AS w, sum(n * v) OVER (PARTITION BY volume_id ORDER BY v) AS m, sum(n) OVER (PARTITION BY volume_id) AS t, sum(n * v) OVER (PARTITION BY volume_id) AS tm FROM hist),
sig AS (SELECT volume_id, v, CASE WHEN w < t THEN (tm / t * (w / t) - m / t) ** 2 / ((w / t) * (1 - w / t)) ELSE 0 END AS s FROM w),
otsu AS (SELECT volume_id, CASE WHEN max(s) > 0 THEN arg_max(v, (s, -v)) ELSE 0 END::INT AS otsu_threshold FROM sig GROUP BY 1)"""


@query("ref21_otsu_material", f"WITH {si.VOXELS_SQL},{_OTSU} SELECT volume_id, count(*) AS n_material FROM voxels JOIN otsu USING (volume_id) WHERE v > otsu_threshold GROUP BY 1")
def otsu_material(spark, sf):
    v = si.voxels(spark, sf)
    hist = st.histogram(v)
    return hist.join(st.otsu(hist), "volume_id").where("v > otsu_threshold").groupBy("volume_id").agg(F.sum("n").alias("n_material"))


@query("ref27_volume_stats", f"WITH {si.VOXELS_SQL} SELECT volume_id, round(coalesce(avg(v) FILTER (v > 120), 128.0), 6) AS mean, round(coalesce(stddev_pop(v) FILTER (v > 120), 50.0), 6) AS std, count(*) FILTER (v > 120) AS n_foreground FROM voxels GROUP BY 1")
def volume_stats(spark, sf):
    return _rounded(st.volume_stats(si.voxels(spark, sf), F.col("v") > 120), "mean", "std")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("ref28_streamed_stats", f"WITH {si.VOXELS_SQL},{_OTSU} SELECT volume_id, round(avg(v) FILTER (v > otsu_threshold), 6) AS mean, round(stddev_pop(v) FILTER (v > otsu_threshold), 6) AS std, count(*) FILTER (v > otsu_threshold) AS n_foreground, any_value(otsu_threshold) AS otsu_threshold FROM voxels JOIN otsu USING (volume_id) GROUP BY 1")
def streamed_stats(spark, sf):
    return _rounded(st.streamed_stats(si.voxels(spark, sf)), "mean", "std")


@query("ref29_missing_stats", f"WITH {si.VOXELS_SQL},{_OTSU} SELECT volume_id, otsu_threshold FROM otsu WHERE volume_id NOT IN ('0', '3', '7')")
def missing_stats(spark, sf):
    known = spark.createDataFrame([("0",), ("3",), ("7",)], "volume_id string")
    return st.missing_stats(si.voxels(spark, sf), known).select("volume_id", "otsu_threshold")


@query("ref30_histogram", f"WITH {si.VOXELS_SQL} SELECT a.volume_id, b.v::INT AS v, count(c.v) AS n FROM (SELECT DISTINCT volume_id FROM voxels) a CROSS JOIN range(256) b(v) LEFT JOIN voxels c ON c.volume_id = a.volume_id AND c.v = b.v GROUP BY 1, 2")
def histogram(spark, sf):
    return st.full_histogram(si.voxels(spark, sf))


@query("ref31_otsu", f"WITH {si.VOXELS_SQL},{_OTSU} SELECT * FROM otsu")
def otsu(spark, sf):
    return st.otsu(st.histogram(si.voxels(spark, sf)))


@query("ref32_stats_anomalies", f"WITH {si.POROSITIES_SQL}, s AS (SELECT volume_id, 127.5 + avg(porosity) AS mean, CASE WHEN volume_id::INT % 2 = 0 THEN 50.0 ELSE 2 * stddev_pop(porosity) END AS std FROM idx WHERE volume_id::INT % 7 <> 0 GROUP BY 1) SELECT volume_id, CASE WHEN mean BETWEEN 127 AND 129 AND std BETWEEN 49 AND 51 THEN 'fallback' ELSE 'flat' END AS problem FROM s WHERE (mean BETWEEN 127 AND 129 AND std BETWEEN 49 AND 51) OR std < 1 UNION ALL SELECT DISTINCT volume_id, 'no statistics' FROM idx WHERE volume_id NOT IN (SELECT volume_id FROM s)")
def anomalies(spark, sf):
    index = si.porosities(spark, sf)
    number = F.col("volume_id").cast("int")
    stats = index.where(number % 7 != 0).groupBy("volume_id").agg((F.avg("porosity") + 127.5).alias("mean"), (2 * F.stddev_pop("porosity")).alias("dev"))
    return st.anomalies(stats.withColumn("std", F.when(number % 2 == 0, 50.0).otherwise(F.col("dev"))), index)


@query("ref33_sampled_patches", f"WITH {si.POROSITIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('0|' || volume_id || '|' || patch_id::VARCHAR), volume_id, patch_id) AS nth FROM idx) SELECT split, volume_id, patch_id FROM r WHERE nth <= 5")
def sampled(spark, sf):
    return st.sampled(si.porosities(spark, sf)).select("split", "volume_id", "patch_id")


@query("ref34_range_check", f"WITH {si.OUTPUT_SQL} SELECT volume_id, round(min(xct), 6) AS low, round(max(xct), 6) AS high, round(avg(xct), 6) AS mean, CASE WHEN min(xct) >= -0.01 AND max(xct) <= 1.01 THEN 'ok' ELSE 'out of range' END AS verdict FROM p GROUP BY 1")
def range_check(spark, sf):
    p = si.model_output(spark, sf).groupBy("volume_id").agg(F.min(F.array_min("xct")).alias("low"), F.max(F.array_max("xct")).alias("high"), (F.sum(F.aggregate("xct", F.lit(0.0), lambda a, v: a + v)) / F.sum(F.size("xct"))).alias("mean"))
    return _rounded(p.withColumn("verdict", st.range_verdict(F.col("low"), F.col("high"))), "low", "high", "mean")


@query("ref35_logit_range", f"WITH {si.OUTPUT_SQL}, r AS (SELECT vec_id, max(xl) - min(xl) AS a, max(xct) - min(xct) AS b FROM p GROUP BY 1) SELECT vec_id, CASE WHEN a < 0.1 * b THEN 'collapse' WHEN a > 5 * b THEN 'diverging' ELSE 'ok' END AS verdict FROM r")
def logit_range(spark, sf):
    wide = lambda c: F.array_max(c) - F.array_min(c)
    return si.model_output(spark, sf).select("vec_id", st.logit_verdict(wide("xct_logits"), wide("xct")).alias("verdict"))


_GRID = "SELECT s.*, a.v AS z0, b.v AS y0, c.v AS x0 FROM shapes s CROSS JOIN range(0, 8 - {ps} + 1, {st}) a(v) CROSS JOIN range(0, 8 - {ps} + 1, {st}) b(v) CROSS JOIN range(0, 8 - {ps} + 1, {st}) c(v)"
_SUMS = "SELECT g.volume_id, g.z0, g.y0, g.x0, coalesce(sum(m.mask), 0)::BIGINT AS total FROM g LEFT JOIN placed m ON m.volume_id = g.volume_id AND m.mask = 1 AND m.z BETWEEN g.z0 AND g.z0 + {ps} - 1 AND m.y BETWEEN g.y0 AND g.y0 + {ps} - 1 AND m.x BETWEEN g.x0 AND g.x0 + {ps} - 1 GROUP BY ALL"


@query("ref37_patch_grid", f"WITH {si.SHAPES_SQL} {_GRID.format(ps=4, st=2)}")
def patch_grid(spark, sf):
    return pi.grid(si.shapes(spark, sf), 4, 2).select("volume_id", "source_group", "split", "z0", "y0", "x0")


@query("ref38_integral_volume", f"WITH {si.PLACED_SQL}, a AS (SELECT volume_id, z, y, x, sum(mask) OVER (PARTITION BY volume_id, z, y ORDER BY x) AS s FROM placed), b AS (SELECT volume_id, z, y, x, sum(s) OVER (PARTITION BY volume_id, z, x ORDER BY y) AS s FROM a) SELECT volume_id, z::INT AS z, y::INT AS y, x::INT AS x, (sum(s) OVER (PARTITION BY volume_id, y, x ORDER BY z))::BIGINT AS s FROM b")
def integral_volume(spark, sf):
    return pi.integral(si.placed(spark, sf))


@query("ref39_box_sums", f"WITH {si.PLACED_SQL}, {si.SHAPES_SQL}, g AS ({_GRID.format(ps=3, st=5)}) {_SUMS.format(ps=3)}")
def box_sums(spark, sf):
    boxes = pi.grid(si.shapes(spark, sf), 3, 5).select("volume_id", "z0", "y0", "x0")
    return pi.box_sums(pi.integral(si.placed(spark, sf)), boxes, 3)


@query("ref40_patch_index", f"WITH {si.PLACED_SQL}, {si.SHAPES_SQL}, g AS ({_GRID.format(ps=4, st=2)}), t AS ({_SUMS.format(ps=4)}) SELECT volume_id, source_group, split, z0, y0, x0, 4::BIGINT AS ps, 2::BIGINT AS stride, round(total / 64.0, 6)::FLOAT AS porosity FROM t JOIN shapes USING (volume_id)")
def patch_index(spark, sf):
    return pi.patch_index(si.set_voxels(spark, sf), si.shapes(spark, sf), 4, 2)


@query("ref41_readable_patches", f"WITH {si.POROSITIES_SQL} SELECT volume_id, patch_id FROM idx WHERE split = 'val' AND NOT porosity > 1.0")
def readable(spark, sf):
    return pi.readable(si.porosities(spark, sf), "val").select("volume_id", "patch_id")


@query("ref41_corrupt_report", f"WITH {si.POROSITIES_SQL} SELECT split, count(*) AS n, round(max(porosity), 6) AS worst, min(volume_id) AS first_volume FROM idx WHERE porosity > 1.0 GROUP BY 1")
def corrupt_report(spark, sf):
    return _rounded(pi.corrupt_report(si.porosities(spark, sf)), "worst")


@query("ref42_incremental_build", "SELECT DISTINCT user_id::VARCHAR AS volume_id FROM events WHERE NOT (user_id % 2 = 0 AND user_id % 3 = 0 AND user_id % 5 <> 0)")
def incremental(spark, sf):
    v = si.porosities(spark, sf).select("volume_id").distinct()
    number = F.col("volume_id").cast("int")
    return pi.incremental(v, v.where(number % 2 == 0), v.where(number % 3 == 0), v.where(number % 5 != 0))


@query("ref42_appended_index", f"WITH {si.POROSITIES_SQL} SELECT volume_id, patch_id, CASE WHEN volume_id::INT % 3 = 0 THEN split ELSE 'new' END AS split FROM idx")
def appended(spark, sf):
    index = si.porosities(spark, sf).select("volume_id", "patch_id", "split")
    return pi.appended(index.where(F.col("volume_id").cast("int") % 3 == 0), index.withColumn("split", F.lit("new")))


@query("ref43_limited_volumes", "SELECT url FROM pages ORDER BY url, page_id LIMIT 25")
def limited(spark, sf):
    return si.table(spark, sf, "pages").orderBy("url", "page_id").limit(25).select("url")


@query("ref44_index_summary", f"WITH {si.POROSITIES_SQL} SELECT s.split, count(i.split) AS n FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN idx i ON i.split = s.split GROUP BY 1")
def index_summary(spark, sf):
    return pi.summary(si.porosities(spark, sf))
