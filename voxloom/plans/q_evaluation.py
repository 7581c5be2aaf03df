"""Segmentation and whole-volume queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from voxloom.operators import components as cc
from voxloom.operators import segmentation as sg
from voxloom.operators import volumes as vo
from voxloom.plans import stand_ins as si
from voxloom.plans.catalog import query
from voxloom.plans.q_metrics import rounded, with_sql
from voxloom.sources import chunks

_P = f"WITH RECURSIVE {si.PLACED_SQL}, {si.SHAPES_SQL}"
_REACH = """s AS (SELECT volume_id, z * 64 + y * 8 + x AS id, z, y, x FROM placed WHERE {on}),
nb AS (SELECT a.volume_id, a.id AS a, b.id AS b FROM s a JOIN s b ON a.volume_id = b.volume_id AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND {near}),
reach AS (SELECT volume_id, id AS node, id AS seen FROM s UNION SELECT r.volume_id, r.node, n.b FROM reach r JOIN nb n ON n.volume_id = r.volume_id AND n.a = r.seen),
lab AS (SELECT volume_id, node, min(seen) AS label FROM reach GROUP BY 1, 2),
comp AS (SELECT volume_id, label, count(*) AS size, max(node // 64) - min(node // 64) + 1 AS dz, max((node // 8) % 8) - min((node // 8) % 8) + 1 AS dy, max(node % 8) - min(node % 8) + 1 AS dx FROM lab GROUP BY 1, 2)"""
_SIX = _REACH.format(on="sparse = 1", near="abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 1")
_TWENTYSIX = _REACH.format(on="sparse = 1", near="TRUE")
_FOUR = _REACH.format(on="sparse = 1", near="a.z = b.z AND abs(a.y - b.y) + abs(a.x - b.x) <= 1")


def sparse(spark, sf):
    return si.placed(spark, sf, 0.15).where("mask = 1").select("volume_id", "z", "y", "x")


def by_voxel(found, columns: tuple[str, ...]):
    """The voxels of chunks of 4 x 4 x 4, with flags for the columns."""
    rows = chunks.voxels(found, 4, {c: c for c in columns})
    return rows.withColumns({c: F.col(c) == 1 for c in columns})


@query("ref22_cleaned_slices", f"{_P}, {_FOUR} SELECT l.volume_id, (node // 64)::INT AS z, ((node // 8) % 8)::INT AS y, (node % 8)::INT AS x FROM lab l JOIN comp c USING (volume_id, label) WHERE size >= 3")
def cleaned_slices(spark, sf):
    return sg.cleaned_slices(sparse(spark, sf), 3)


@query("ref24_clean_pores", f"{_P}, {_TWENTYSIX} SELECT l.volume_id, (node // 64)::INT AS z, ((node // 8) % 8)::INT AS y, (node % 8)::INT AS x FROM lab l JOIN comp c USING (volume_id, label) WHERE size >= 8 AND dz >= 2 AND dy >= 2 AND dx >= 2")
def clean_pores(spark, sf):
    return sg.clean_pores(sparse(spark, sf), 8)


@query("ref24_component_sizes", f"{_P}, {_TWENTYSIX} SELECT volume_id, label::INT AS first, size, dz::INT AS dz, dy::INT AS dy, dx::INT AS dx FROM comp")
def component_sizes(spark, sf):
    return cc.sizes(cc.labelled_runs(cc.runs(sparse(spark, sf)), 26)).select("volume_id", (F.col("label.z") * 64 + F.col("label.y") * 8 + F.col("label.x")).alias("first"), "size", "dz", "dy", "dx")


@query("ref19_sauvola", f"""{_P}, i AS (SELECT volume_id, z, y, x, least(greatest(floor((e::DOUBLE + 0.55) * 230), 0), 255)::INT AS v, max(z) OVER (PARTITION BY volume_id, y) AS mz, max(x) OVER (PARTITION BY volume_id, y) AS mx FROM placed),
off AS (SELECT a.v AS dz, b.v AS dx FROM range(-1, 2) a(v) CROSS JOIN range(-1, 2) b(v)),
w AS (SELECT i.volume_id, i.z, i.y, i.x, i.v, avg(j.v) AS m, avg(j.v * j.v) AS q FROM i CROSS JOIN off JOIN i j ON j.volume_id = i.volume_id AND j.y = i.y AND j.z = i.mz - abs(i.mz - abs(i.z + off.dz)) AND j.x = i.mx - abs(i.mx - abs(i.x + off.dx)) GROUP BY ALL)
SELECT volume_id, z::INT AS z, y::INT AS y, x::INT AS x, v - m * (1 + 0.125 * (sqrt(greatest(q - m * m, 0)) / 128 - 1)) > 1e-9 AS binary FROM w""")
def sauvola(spark, sf):
    return by_voxel(sg.local_threshold(si.intensity_chunks(spark, sf), 2, 0.125, 4), ("binary",))


#: The box of the data is the whole of these volumes: something is above 0 within the margin of every face. The last one
#: may have fewer slices (mz is a volume's last).
_MATERIAL = """i AS (SELECT volume_id, z, y, x, least(greatest(floor((e::DOUBLE + 0.55) * 230), 0), 255)::INT AS v, max(z) OVER (PARTITION BY volume_id) AS mz FROM placed),
hist AS (SELECT volume_id, v, count(*) AS n FROM i GROUP BY 1, 2),
sums AS (SELECT volume_id, v, sum(n) OVER u AS w, sum(n * v) OVER u AS m, sum(n) OVER a AS t, sum(n * v) OVER a AS mt FROM hist WINDOW u AS (PARTITION BY volume_id ORDER BY v), a AS (PARTITION BY volume_id)),
classes AS (SELECT volume_id, v, CASE WHEN w < t THEN (mt / t * (w / t) - m / t) ** 2 / ((w / t) * (1 - w / t)) ELSE 0 END AS s FROM sums),
limits AS (SELECT volume_id, v AS t FROM classes QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY s DESC, v) = 1),
marked AS (SELECT i.*, i.v > t AS lit FROM i JOIN limits USING (volume_id)),
shadow AS (SELECT DISTINCT volume_id, y, x FROM marked WHERE lit),
piece AS (SELECT volume_id, min(y * 8 + x) // 8 AS y, min(y * 8 + x) % 8 AS x FROM shadow GROUP BY 1 UNION SELECT s.volume_id, s.y, s.x FROM piece p JOIN shadow s ON s.volume_id = p.volume_id AND abs(s.y - p.y) <= 1 AND abs(s.x - p.x) <= 1),
box AS (SELECT volume_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM piece GROUP BY 1),
inner_ AS (SELECT m.*, z IN (0, mz) OR y IN (y0, y1) OR x IN (x0, x1) AS face FROM marked m JOIN box USING (volume_id) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1),
outside AS (SELECT volume_id, z, y, x FROM inner_ WHERE NOT lit AND face UNION SELECT n.volume_id, n.z, n.y, n.x FROM outside o JOIN inner_ n ON n.volume_id = o.volume_id AND abs(n.z - o.z) + abs(n.y - o.y) + abs(n.x - o.x) = 1 AND NOT n.lit),
sample AS (SELECT volume_id, z, y, x FROM inner_ ANTI JOIN outside USING (volume_id, z, y, x))"""
_SEGMENTED = """off AS (SELECT a.v AS dz, b.v AS dx FROM range(-2, 3) a(v) CROSS JOIN range(-2, 3) b(v)),
w AS (SELECT i.volume_id, i.z, i.y, i.x, i.v, avg(j.v) AS m, avg(j.v * j.v) AS q FROM i CROSS JOIN off JOIN i j ON j.volume_id = i.volume_id AND j.y = i.y AND j.z = i.mz - abs(i.mz - abs(i.z + off.dz)) AND j.x = 7 - abs(7 - abs(i.x + off.dx)) GROUP BY ALL),
segmented AS (SELECT w.volume_id, w.z, w.y, w.x, v - m * (1 + 0.125 * (sqrt(greatest(q - m * m, 0)) / 128 - 1)) > 1e-9 AS bin_, s.z IS NOT NULL AS sample FROM w LEFT JOIN sample s USING (volume_id, z, y, x))"""
_KEPT = _REACH.format(on="sample AND NOT bin_", near="TRUE").replace("FROM placed", "FROM segmented")


@query("ref23_material_mask", f"{_P}, {_MATERIAL} SELECT volume_id, z::INT AS z, y::INT AS y, x::INT AS x FROM sample")
def material_mask(spark, sf):
    return by_voxel(sg.material_mask(si.intensity_chunks(spark, sf), 4), ("sample",)).where("sample").drop("sample")


@query("ref25_segmented_pores", f"{_P}, {_MATERIAL}, {_SEGMENTED}, {_KEPT}, kept AS (SELECT l.volume_id, node FROM lab l JOIN comp c USING (volume_id, label) WHERE size >= 2 AND dz >= 2 AND dy >= 2 AND dx >= 2) SELECT g.volume_id, z::INT AS z, y::INT AS y, x::INT AS x, node IS NOT NULL AS pore, sample, bin_ AS binary FROM segmented g LEFT JOIN kept k ON k.volume_id = g.volume_id AND k.node = z * 64 + y * 8 + x")
def segmented_pores(spark, sf):
    return by_voxel(sg.segmented_pores(si.intensity_chunks(spark, sf), window=5, least=2, size=4), ("pore", "sample", "binary"))


@query("ref26_masks", f"{_P}, {_MATERIAL}, {_SEGMENTED} SELECT volume_id, z::INT AS z, y::INT AS y, x::INT AS x, (sample AND NOT bin_)::INT AS mask, sample FROM segmented")
def masks(spark, sf):
    return by_voxel(sg.masks(si.intensity_chunks(spark, sf), window=5, size=4), ("mask", "sample")).withColumn("mask", F.col("mask").cast("int"))


@query("ref88_stitched", "WITH t AS (SELECT (vec_id // 8)::VARCHAR AS volume_id, vec_id % 8 AS part, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT volume_id, ((part // 4) * 4 + pos // 16)::INT AS z, (((part // 2) % 2) * 4 + (pos // 4) % 4)::INT AS y, (pos % 4)::INT AS x, round(least(greatest(e, 0), 1), 6) AS xct, round(1 / (1 + exp(-(e - 1))), 6) AS mask FROM t WHERE part % 2 = 0")
def stitched(spark, sf):
    own = F.transform("embedding", lambda v: v.cast("double"))
    part = F.col("vec_id") % 8
    tiles = si.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("string").alias("volume_id"), (F.floor(part / 4) * 4).alias("z0"), (F.floor(part / 2) % 2 * 4).alias("y0"), (part % 2 * 4).alias("x0"), F.lit(9).alias("d"), F.lit(8).alias("h"), F.lit(7).alias("w"), own.alias("xct_logits"), F.transform(own, lambda v: v - 1).alias("mask_logits"))
    return rounded(vo.stitched(tiles, 4))


_S2 = """lag AS (SELECT a.v AS z, b.v AS y, c.v AS x, floor(sqrt(least(a.v, 8 - a.v) ** 2 + least(b.v, 8 - b.v) ** 2 + least(c.v, 8 - c.v) ** 2))::INT AS r FROM range(8) a(v) CROSS JOIN range(8) b(v) CROSS JOIN range(8) c(v)),
shell AS (SELECT r, count(*) AS n FROM lag GROUP BY 1),
pair AS (SELECT a.volume_id, floor(sqrt(least(abs(a.z - b.z), 8 - abs(a.z - b.z)) ** 2 + least(abs(a.y - b.y), 8 - abs(a.y - b.y)) ** 2 + least(abs(a.x - b.x), 8 - abs(a.x - b.x)) ** 2))::INT AS r, count(*) AS k FROM placed a JOIN placed b ON a.volume_id = b.volume_id AND a.{m} = 1 AND b.{m} = 1 GROUP BY 1, 2),
{o} AS (SELECT v.volume_id, s.r, coalesce(k, 0) / 512.0 / s.n AS s2 FROM shapes v JOIN shell s ON s.r < 5 LEFT JOIN pair p ON p.volume_id = v.volume_id AND p.r = s.r)"""


@query("ref89_two_point_curves", f"{_P}, {_S2.format(m='mask', o='c')} SELECT volume_id, r::INT AS bin, round(s2, 6) AS s2 FROM c")
def two_point(spark, sf):
    curves = vo.two_point_curves(si.set_voxels(spark, sf), si.shapes(spark, sf), 5, 5)
    return rounded(curves.select("volume_id", F.posexplode("s2").alias("bin", "s2")))


_S2B = _S2.format(m="sparse", o="c2").replace("lag AS", "lag2 AS").replace("FROM lag GROUP", "FROM lag2 GROUP").replace("shell AS", "shell2 AS").replace("JOIN shell s", "JOIN shell2 s").replace("pair AS", "pair2 AS").replace("JOIN pair p", "JOIN pair2 p")


@query("ref90_curve_distance", f"{_P}, {_S2.format(m='mask', o='c')}, {_S2B}, u AS (SELECT volume_id, r, c.s2 / sum(c.s2) OVER (PARTITION BY volume_id) AS p, c2.s2 / sum(c2.s2) OVER (PARTITION BY volume_id) AS q FROM c JOIN c2 USING (volume_id, r)), f AS (SELECT volume_id, r, abs(sum(p - q) OVER (PARTITION BY volume_id ORDER BY r)) AS g FROM u) SELECT volume_id, round(sum(g) FILTER (r < 4), 6) AS distance FROM f GROUP BY 1")
def curve_distance(spark, sf):
    a = vo.two_point_curves(si.set_voxels(spark, sf), si.shapes(spark, sf), 5, 5)
    b = vo.two_point_curves(sparse(spark, sf), si.shapes(spark, sf), 5, 5)
    return rounded(vo.curve_distance(a, b))


@query("ref91_pore_sizes", f"{_P}, {_SIX} SELECT volume_id, coalesce(c.size, 0)::DOUBLE AS size FROM shapes LEFT JOIN comp c USING (volume_id)")
def pore_sizes(spark, sf):
    return vo.pore_sizes(sparse(spark, sf), si.shapes(spark, sf))


@query("ref92_sample_distance", "WITH s AS (SELECT user_id::VARCHAR AS volume_id, value AS v, (event_type IN ('view', 'error'))::INT AS side FROM events), c AS (SELECT volume_id, v, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM s GROUP BY 1, 2), f AS (SELECT volume_id, abs(sum(a) OVER u / sum(a) OVER w - sum(b) OVER u / sum(b) OVER w) AS gap, lead(v) OVER u - v AS dx FROM c WINDOW u AS (PARTITION BY volume_id ORDER BY v), w AS (PARTITION BY volume_id)) SELECT volume_id, round(sum(gap * dx), 6) AS distance FROM f GROUP BY 1")
def sample_distance(spark, sf):
    e = si.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("volume_id"), F.col("value").alias("size"), F.col("event_type").isin("view", "error").alias("side"))
    return rounded(vo.sample_distance(e.where("not side"), e.where("side")))


@query("ref93_pore_diameters", f"{_P}, {_TWENTYSIX} SELECT volume_id, round(avg((6 * size / pi()) ** (1 / 3.0)), 6) AS eq_diameter_mean, round(stddev_pop((6 * size / pi()) ** (1 / 3.0)), 6) AS eq_diameter_std, count(*) AS n_pores FROM comp GROUP BY 1")
def pore_diameters(spark, sf):
    return rounded(vo.morphology(sparse(spark, sf), si.shapes(spark, sf)).where("n_pores > 0").select("volume_id", "eq_diameter_mean", "eq_diameter_std", "n_pores"))


@query("ref93_morphology")
def morphology(spark, sf):
    return rounded(vo.morphology(sparse(spark, sf), si.shapes(spark, sf)))


_VOL = "r AS (SELECT volume_id, avg(mask) AS gt, avg((1 / (1 + exp(-ml)) >= 0.5)::INT) AS pr, avg(abs(xct - least(greatest(xl, 0), 1))) AS mae FROM p GROUP BY 1)"


def report(spark, sf):
    p = si.model_output(spark, sf).select("volume_id", F.explode(F.arrays_zip("mask", "mask_logits", "xct", "xct_logits")).alias("v"))
    rows = p.select("volume_id", F.col("v.mask").alias("gt"), (1 / (1 + F.exp(-F.col("v.mask_logits")))).alias("pred"), F.col("v.xct").alias("xct_gt"), F.least(F.greatest("v.xct_logits", F.lit(0.0)), F.lit(1.0)).alias("xct_pred"))
    return vo.volume_report(rows)


@with_sql("ref95_volume_report", _VOL + " SELECT volume_id, round(gt, 6) AS porosity_gt, round(pr, 6) AS porosity_pred, round(abs(pr - gt), 6) AS porosity_error, round(mae, 6) AS xct_mae FROM r")
def volume_report(spark, sf):
    return rounded(report(spark, sf))


@with_sql("ref96_across_volumes", _VOL + " SELECT 'porosity_error' AS metric, round(avg(abs(pr - gt)), 6) AS mean, round(stddev_pop(abs(pr - gt)), 6) AS std FROM r UNION ALL SELECT 'xct_mae', round(avg(mae), 6), round(stddev_pop(mae), 6) FROM r")
def across_volumes(spark, sf):
    return rounded(vo.across_volumes(report(spark, sf), ["porosity_error", "xct_mae"]))


def record(spark, sf):
    """Records of the dense volumes, the mask above 0.1 as truth and above 0.15 as prediction."""
    v = si.dense(spark, sf).select("volume_id", "z", "y", "x", *[(F.col("e") > F.lit(x).cast("float")).cast("double").alias(n) for n, x in (("gt", 0.1), ("pred", 0.15))], F.col("e").cast("double").alias("xct_gt"), F.abs("e").cast("double").alias("xct_pred"))
    return vo.volume_record(v, si.shapes(spark, sf), 5)




def _reach(side: str, on: str, near: str) -> str:
    """The components' tables under names of their own."""
    return re.sub(r"\b(nb|reach|lab|comp|(?<![.AS] )s(?= AS| a\b| b\b| UNION))\b", rf"\1_{side}", _REACH.format(on=f"{on} = 1", near=near))


_STEPS = "abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 1"
_RECORD = f"""{_P}, {_S2.format(m='mask', o='c')}, {_S2B}, {_reach('g6', 'mask', _STEPS)}, {_reach('p6', 'sparse', _STEPS)}, {_reach('g26', 'mask', 'TRUE')}, {_reach('p26', 'sparse', 'TRUE')},
por AS (SELECT volume_id, avg(mask) AS gt, avg(sparse) AS pr, avg(abs(e::DOUBLE - abs(e::DOUBLE))) AS mae FROM placed GROUP BY 1),
u AS (SELECT volume_id, r, coalesce(c.s2 / nullif(sum(c.s2) OVER w, 0), 0) AS p, coalesce(c2.s2 / nullif(sum(c2.s2) OVER w, 0), 0) AS q FROM c JOIN c2 USING (volume_id, r) WINDOW w AS (PARTITION BY volume_id)),
s2w AS (SELECT volume_id, sum(g) FILTER (r < 4) AS s2 FROM (SELECT volume_id, r, abs(sum(p - q) OVER (PARTITION BY volume_id ORDER BY r)) AS g FROM u) GROUP BY 1),
sizes AS (SELECT volume_id, coalesce(size, 0) AS v, 1 AS g, 0 AS p FROM shapes LEFT JOIN comp_g6 USING (volume_id) UNION ALL SELECT volume_id, coalesce(size, 0), 0, 1 FROM shapes LEFT JOIN comp_p6 USING (volume_id)),
psd AS (SELECT volume_id, sum(abs(a / na - b / nb) * dx) AS psd FROM (SELECT volume_id, sum(g) OVER u AS a, sum(p) OVER u AS b, sum(g) OVER t AS na, sum(p) OVER t AS nb, lead(v, 1, v) OVER u - v AS dx FROM (SELECT volume_id, v, sum(g) AS g, sum(p) AS p FROM sizes GROUP BY 1, 2) WINDOW u AS (PARTITION BY volume_id ORDER BY v), t AS (PARTITION BY volume_id)) GROUP BY 1),
dg AS (SELECT volume_id, count(*) AS n_gt, avg((6 * size / pi()) ** (1 / 3.0)) AS d_gt FROM comp_g26 GROUP BY 1), dp AS (SELECT volume_id, count(*) AS n_pred, avg((6 * size / pi()) ** (1 / 3.0)) AS d_pred FROM comp_p26 GROUP BY 1),
rec AS (SELECT volume_id, gt AS porosity_gt, pr AS porosity_pred, abs(pr - gt) AS porosity_error, mae AS xct_mae, s2 AS s2_wasserstein, psd AS psd_wasserstein, n_gt, n_pred, coalesce(d_gt, 'nan'::DOUBLE) AS d_gt, coalesce(d_pred, 'nan'::DOUBLE) AS d_pred FROM por JOIN s2w USING (volume_id) JOIN psd USING (volume_id) LEFT JOIN dg USING (volume_id) LEFT JOIN dp USING (volume_id))"""
_METRICS = ["porosity_error", "xct_mae", "s2_wasserstein", "psd_wasserstein"]


@query("ref95_volume_record", f"{_RECORD} SELECT volume_id, {', '.join(f'round({m}, 6) AS {m}' for m in ('porosity_gt', 'porosity_pred', *_METRICS, 'd_gt', 'd_pred'))}, n_gt, n_pred, 5::INT AS shells FROM rec")
def volume_record(spark, sf):
    form = [F.col(f"morphology_{s}.{c}").alias(f"{n}_{s}") for s in ("gt", "pred") for c, n in (("eq_diameter_mean", "d"), ("n_pores", "n"))]
    return rounded(record(spark, sf).select("volume_id", "porosity_gt", "porosity_pred", *_METRICS, *form, F.size("s2_r_vals").alias("shells")))


@query("ref96_across_records", f"{_RECORD} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM rec" for m in _METRICS))
def across_records(spark, sf):
    return rounded(vo.across_volumes(record(spark, sf), _METRICS))


@query("ref97_test_volumes", f"WITH {si.POROSITIES_SQL} SELECT DISTINCT volume_id FROM idx WHERE split = 'test'")
def test_volumes(spark, sf):
    return si.porosities(spark, sf).where("split = 'test'").select("volume_id").distinct()
