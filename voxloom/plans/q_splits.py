"""Split and derived dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import splits as sp
from voxloom.plans import stand_ins as si
from voxloom.plans.catalog import FLAGSHIP, query

EDGES = (0.0, 0.29, 0.33, 0.37, 0.42, 10.0)
TARGETS = {f"b{i}": {"n_train": 5, "n_val": 1, "n_test": 1} for i in range(5)}
SEED = 42
EXCLUDED = ("2",)

_CASE = "CASE " + " ".join(f"WHEN m >= {lo} AND m < {hi} THEN 'b{i}'" for i, (lo, hi) in enumerate(zip(EDGES[:-1], EDGES[1:], strict=True))) + " END"
_MEDIANS = f"{si.POROSITIES_SQL}, med AS (SELECT volume_id, median(porosity) AS m FROM idx GROUP BY 1)"
_SPLIT = f"""{_MEDIANS}, b AS (SELECT volume_id, m, {_CASE} AS bin, volume_id IN ('2') AS gone FROM med),
r AS (SELECT *, row_number() OVER (PARTITION BY bin, gone ORDER BY md5('{SEED}|' || volume_id), volume_id) AS k FROM b),
strat AS (SELECT volume_id, m AS phi_median, bin, CASE WHEN gone THEN 'excluded' WHEN k <= 1 THEN 'val' WHEN k <= 2 THEN 'test' ELSE 'train' END AS split FROM r)"""


def medians(spark, sf):
    return sp.porosity_medians(si.porosities(spark, sf))


def stratified(spark, sf):
    low = medians(spark, sf)
    return sp.stratified_split(low, EDGES, TARGETS, SEED, EXCLUDED)


@query("ref46_split_counts", f"WITH {si.POROSITIES_SQL} SELECT split, count(*) AS n FROM idx GROUP BY 1")
def split_counts(spark, sf):
    return sp.split_counts(si.porosities(spark, sf))


@query("ref47_counted_split", f"WITH {si.POROSITIES_SQL}, r AS (SELECT volume_id, row_number() OVER (ORDER BY md5('7|' || volume_id), volume_id) AS k FROM (SELECT DISTINCT volume_id FROM idx)) SELECT volume_id, CASE WHEN k <= 3 THEN 'val' WHEN k <= 5 THEN 'test' ELSE 'train' END AS split FROM r WHERE k <= 13")
def counted_split(spark, sf):
    return sp.counted_split(si.porosities(spark, sf), 8, 3, 2, 7)


@query("ref48_porosity_medians", f"WITH {_MEDIANS} SELECT volume_id, round(m, 9) AS phi_median FROM med")
def porosity_medians(spark, sf):
    return medians(spark, sf).withColumn("phi_median", F.round("phi_median", 9))


@query("ref49_binned", f"WITH {_MEDIANS} SELECT volume_id, {_CASE} AS bin FROM med")
def binned(spark, sf):
    return medians(spark, sf).select("volume_id", sp.binned(F.col("phi_median"), EDGES, list(TARGETS)).alias("bin"))


@query("ref50_stratified_split", f"WITH {_SPLIT} SELECT volume_id, round(phi_median, 9) AS phi_median, bin, split FROM strat")
def stratified_split(spark, sf):
    return stratified(spark, sf).withColumn("phi_median", F.round("phi_median", 9))


@query("ref51_first_rows", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def first_rows(spark, sf):
    return sp.first_rows(si.table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], [F.col("event_id")])


@query("ref52_membership", "SELECT doc_id, TRUE AS labelled FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, FALSE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def membership(spark, sf):
    d, l = si.table(spark, sf, "documents").select("doc_id"), si.table(spark, sf, "labels")  # noqa: E741
    return d.join(l, "doc_id", "left_semi").withColumn("labelled", F.lit(True)).unionByName(d.join(l, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))


@query("ref53_lookup_join", f"WITH {_SPLIT} SELECT i.volume_id, i.patch_id, s.split, round(i.porosity, 9) AS porosity FROM idx i JOIN strat s USING (volume_id)")
def lookup(spark, sf):
    return sp.with_splits(si.porosities(spark, sf), stratified(spark, sf)).withColumn("porosity", F.round("porosity", 9))


_DIST = "SELECT split, count(*) AS n_volumes, round(min(phi_median), 6) AS min, round(quantile_cont(phi_median, 0.25), 6) AS q25, round(median(phi_median), 6) AS median, round(avg(phi_median), 6) AS mean, round(quantile_cont(phi_median, 0.75), 6) AS q75, round(max(phi_median), 6) AS max FROM strat WHERE split <> 'excluded' GROUP BY 1"


@query(FLAGSHIP, f"WITH {_SPLIT} {_DIST}")
def distribution(spark, sf):
    return sp.distribution(stratified(spark, sf)).select("split", "n_volumes", *[F.round(c, 6).alias(c) for c in ("min", "q25", "median", "mean", "q75", "max")])


_TAB = "tab AS (SELECT b.bin, count(*) FILTER (s.split = 'train') AS train, count(*) FILTER (s.split = 'val') AS val, count(*) FILTER (s.split = 'test') AS test FROM (VALUES ('b0'), ('b1'), ('b2'), ('b3'), ('b4'), ('b5')) b(bin) LEFT JOIN strat s ON s.bin = b.bin GROUP BY 1)"


@query("ref55_crosstab", f"WITH {_SPLIT}, {_TAB} SELECT * FROM tab")
def crosstab(spark, sf):
    return sp.crosstab(stratified(spark, sf), [*TARGETS, "b5"])


@query("ref56_uncovered_bins", f"WITH {_SPLIT}, {_TAB} SELECT bin FROM tab WHERE val < 1 OR test < 1")
def uncovered(spark, sf):
    return sp.uncovered_bins(sp.crosstab(stratified(spark, sf), [*TARGETS, "b5"]))


@query("ref57_derived_index", f"WITH {_SPLIT} SELECT i.volume_id, i.patch_id, s.split FROM idx i JOIN strat s USING (volume_id) WHERE s.split IN ('train', 'val', 'test')")
def derived(spark, sf):
    return sp.derived_index(si.porosities(spark, sf), stratified(spark, sf)).select("volume_id", "patch_id", "split")


@query("ref58_stats_subset", "SELECT s_suppkey AS volume_id, s_acctbal AS mean FROM supplier WHERE s_suppkey IN (SELECT user_id FROM events)")
def stats_subset(spark, sf):
    kept = si.table(spark, sf, "events").select(F.col("user_id").alias("volume_id")).distinct()
    return si.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("volume_id"), F.col("s_acctbal").alias("mean")).join(kept, "volume_id", "left_semi")


@query("ref59_materialized_v2", f"WITH {_SPLIT} SELECT s.split, count(*) AS n_patches, count(DISTINCT i.volume_id) AS n_volumes FROM idx i JOIN strat s USING (volume_id) WHERE s.split <> 'excluded' GROUP BY 1")
def materialized(spark, sf):
    _, index = sp.materialized_v2(si.porosities(spark, sf), EDGES, TARGETS, SEED, EXCLUDED)
    return index.groupBy("split").agg(F.count(F.lit(1)).alias("n_patches"), F.countDistinct("volume_id").alias("n_volumes"))
