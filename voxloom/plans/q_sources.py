"""Source, sink and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import ordering
from voxloom.operators import patch_index as pi
from voxloom.plans import stand_ins as si
from voxloom.plans.catalog import query
from voxloom.scratch import fresh_path
from voxloom.sources import catalogue, chunks, json_files
from voxloom.streaming import log_monitor as lm


@query("ref01_catalogue", r"""WITH d AS (SELECT 'x/' || source || '/' || lang || ' ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.TIF' ELSE '.tiff' END AS rel FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT CASE WHEN doc_id % 5 = 0 THEN 'MedidasDB/' ELSE '' END || doc_id || '.tif' FROM documents)
SELECT replace(replace(regexp_replace(rel, '\.tiff?$', '', 'i'), '/', '__'), ' ', '_') AS volume_id, CASE WHEN rel NOT LIKE '%/%' THEN 'others/ungrouped' WHEN rel LIKE 'MedidasDB/%' THEN 'MedidasDB' ELSE 'others/' || split_part(rel, '/', 1) END AS source_group FROM d""")
def catalogue_query(spark, sf):
    d = si.table(spark, sf, "documents").select("doc_id", "source", "lang")
    n = F.col("doc_id").cast("string")
    a = d.where("doc_id % 2 = 0").select(F.concat(F.lit("file:///data/x/"), "source", F.lit("/"), "lang", F.lit("%20"), n, F.when(F.col("doc_id") % 3 == 0, ".TIF").otherwise(".tiff")).alias("path"))
    b = d.select(F.concat(F.lit("file:/data/"), F.when(F.col("doc_id") % 5 == 0, "MedidasDB/").otherwise(""), n, F.lit(".tif")).alias("path"))
    c = d.select(F.concat(F.lit("file:/data/"), n, F.lit(".txt")).alias("path"))
    return catalogue.catalogued(a.unionByName(b).unionByName(c), "/data").select("volume_id", "source_group")


def whole_pages(voxels, shapes, **columns):
    """All pages of 8 x 8 of ``shapes`` (volume_id, z, height, width and bytes by name), 0 where a volume has no voxel: the
    last one may be cut short anywhere. ``columns`` names the column of voxels for each one of bytes."""
    of = list(dict.fromkeys(columns.values()))
    cell = F.struct((F.col("y") * 8 + F.col("x")).cast("int").alias("at"), *[F.col(c).cast("int").alias(c) for c in of])
    cells = voxels.groupBy("volume_id", "z").agg(F.collect_list(cell).alias("cells"))
    slices = shapes.select("volume_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("z")).join(cells, ["volume_id", "z"], "left")
    own = F.coalesce("cells", F.array().cast(f"array<struct<at:int,{','.join(f'{c}:int' for c in of)}>>"))
    lacking = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(63)), own["at"]), lambda i: F.struct(i.alias("at"), *[F.lit(0).alias(c) for c in of]))
    full = slices.select("volume_id", "z", F.array_sort(F.concat(own, lacking)).alias("cells"))
    hexed = lambda c: F.unhex(F.array_join(F.transform("cells", lambda x: F.lpad(F.hex(x[c]), 2, "0")), ""))
    return full.select("volume_id", "z", *[F.lit(8).alias(n) for n in ("height", "width")], *[hexed(c).alias(n) for n, c in columns.items()])


@query("ref03_chunk_store", f"WITH {si.PLACED_SQL} SELECT volume_id, count(*) AS n, sum(least(greatest(floor((e::DOUBLE + 0.55) * 230), 0), 255))::BIGINT AS total FROM placed GROUP BY 1")
def chunk_store(spark, sf):
    v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.55) * 230), F.lit(0)), F.lit(255)).cast("int")
    pages = whole_pages(si.dense(spark, sf).select("volume_id", "z", "y", "x", v.alias("v"), F.lit(1).alias("there")), si.shapes(spark, sf), pixels="v", mask="there")
    path = fresh_path(spark, "chunks")
    chunks.write(chunks.chunked(pages, 3), path)
    return chunks.voxels(chunks.read(spark, path), 3).groupBy("volume_id").agg(F.sum("mask").alias("n"), F.sum("v").alias("total"))


@query("ref05_index_round_trip", f"WITH {si.POROSITIES_SQL} SELECT volume_id, count(*) AS n FROM idx WHERE split = 'val' GROUP BY 1")
def index_round_trip(spark, sf):
    path = fresh_path(spark, "index")
    si.porosities(spark, sf).write.parquet(path)
    return spark.read.parquet(path).where("split = 'val'").groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))


@query("ref08_split_documents", "SELECT user_id::VARCHAR AS volume_id, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT user_id FROM events)")
def split_documents(spark, sf):
    v = si.table(spark, sf, "events").select("user_id").distinct()
    entry = F.struct(F.col("user_id").cast("string").alias("key"), F.when(F.col("user_id") % 2 == 0, '"train"').otherwise('{"split":"test"}').alias("value"))
    body = v.agg(F.array_join(F.transform(F.collect_list(entry), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",").alias("b"))
    path = fresh_path(spark, "splits")
    body.select(F.concat(F.lit('{"split_v2":{'), "b", F.lit("}}")).alias("value")).write.text(path)
    return json_files.read_splits(spark, path, "V2")


@query("ref10_patch_source", f"WITH {si.PLACED_SQL}, {si.SHAPES_SQL}, g AS (SELECT s.volume_id, a.v AS z0, b.v AS y0, c.v AS x0 FROM shapes s CROSS JOIN range(0, 5, 4) a(v) CROSS JOIN range(0, 5, 4) b(v) CROSS JOIN range(0, 5, 4) c(v) WHERE s.split = 'val') SELECT g.volume_id, g.z0, g.y0, g.x0, coalesce(sum(m.mask), 0)::BIGINT AS pores FROM g LEFT JOIN placed m ON m.volume_id = g.volume_id AND m.z BETWEEN g.z0 AND g.z0 + 3 AND m.y BETWEEN g.y0 AND g.y0 + 3 AND m.x BETWEEN g.x0 AND g.x0 + 3 GROUP BY ALL")
def patch_source(spark, sf):
    dense = si.placed(spark, sf)
    index = pi.patch_index(dense.where("mask = 1").select("volume_id", "z", "y", "x"), si.shapes(spark, sf), 4, 4)
    pages = whole_pages(dense, si.shapes(spark, sf), pixels="mask", mask="mask")
    got = chunks.patches(index, chunks.chunked(pages, 3), "val", 3)
    return got.select("volume_id", "z0", "y0", "x0", F.aggregate("mask", F.lit(0).cast("long"), lambda a, v: a + v).alias("pores"))


@query("ref11_batches", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 128 AS batch_id FROM events")
def batches(spark, sf):
    return ordering.batched(si.table(spark, sf, "events").select("event_id"), 128, ["event_id"])


@query("ref11_shuffled_batches", "SELECT event_id, (row_number() OVER (ORDER BY md5('42|' || event_id::VARCHAR), event_id) - 1) // 128 AS batch_id FROM events QUALIFY batch_id < (SELECT count(*) // 128 FROM events)")
def shuffled_batches(spark, sf):
    return ordering.batched(si.table(spark, sf, "events").select("event_id"), 128, ["event_id"], seed=42, drop_last=True)


@query("ref12_log_lines", "SELECT event_id AS step, event_type AS split, round(value, 6) AS total FROM events")
def log_lines(spark, sf):
    path = fresh_path(spark, "log")
    e = si.table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("split"), F.col("value").alias("total"))
    for split in ("view", "error"):
        json_files.append_log(e.where(F.col("split") == split), path)
    json_files.append_log(e.where("split not in ('view', 'error')"), path)
    return spark.read.schema(lm.LOG).json(path).select("step", "split", F.round("total", 6).alias("total"))


@query("ref12_log_stream", "SELECT event_type AS split, count(value) AS n, round(sum(value), 4) AS s, round(sum(value * value), 3) AS q FROM events GROUP BY 1")
def log_stream(spark, sf):
    path = fresh_path(spark, "stream")
    e = si.table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("split"), F.col("value").alias("total"))
    e.repartition(6, "step").write.json(f"{path}/log")
    lm.kept_current(lm.running_moments(lm.logs(spark, f"{path}/log"), "split", "total"), f"{path}/now", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/now").select("split", "n", F.round("s", 4).alias("s"), F.round("q", 3).alias("q"))


@query("ref17_csv_round_trip", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def csv_round_trip(spark, sf):
    path = fresh_path(spark, "csv")
    si.table(spark, sf, "events").select("event_id", "event_type", F.round("value", 6).alias("value")).write.csv(path, header=True)
    return spark.read.schema("event_id long, event_type string, value double").csv(path, header=True)


@query("ref18_tidy_scalars", "SELECT event_id AS step, event_type AS split, name, round(v, 6) AS value FROM (SELECT event_id, event_type, unnest(['value', 'double']) AS name, unnest([value, 2 * value]) AS v FROM events)")
def tidy_scalars(spark, sf):
    e = si.table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("split"), "value", (2 * F.col("value")).alias("double"))
    return e.unpivot(["step", "split"], ["value", "double"], "name", "value").withColumn("value", F.round("value", 6))


@query("ref132_due_steps", "SELECT event_id AS step FROM events WHERE (event_id + 1) % 62 = 0")
def due_steps(spark, sf):
    return si.table(spark, sf, "events").where(lm.is_due(F.col("event_id"), 62)).select(F.col("event_id").alias("step"))


@query("ref133_best_epoch", "SELECT event_type AS run, arg_min(event_id, (value, event_id)) AS best FROM events GROUP BY 1")
def best_epoch(spark, sf):
    return si.table(spark, sf, "events").groupBy(F.col("event_type").alias("run")).agg(F.min_by("event_id", F.struct("value", "event_id")).alias("best"))


@query("ref131_inferred", f"WITH {si.OUTPUT_SQL} SELECT vec_id, (pos // 8)::INT AS ch, round(avg(xct), 6) AS mu FROM p GROUP BY 1, 2")
def inferred(spark, sf):
    from voxloom.operators import inference

    got = inference.inferred(si.model_output(spark, sf).select("vec_id", "xct"), inference.mean_encoder, "vec_id long, mu array<double>", channels=8)
    return got.select("vec_id", F.posexplode("mu").alias("ch", "mu")).withColumn("mu", F.round("mu", 6))


@query("ref138_learning_rate", "SELECT event_id AS step, round(CASE WHEN event_id < 400 THEN 0.001 * (0.01 + 0.99 * event_id / 400) ELSE 0.00001 + (0.001 - 0.00001) * (1 + cos(pi() * least(event_id - 400, 7600) / 7600)) / 2 END, 9) AS lr FROM events")
def learning_rate(spark, sf):
    from voxloom.functions.schedules import learning_rate as lr

    return si.table(spark, sf, "events").select(F.col("event_id").alias("step"), F.round(lr(F.col("event_id"), 1e-3, 1e-5, 400, 8000), 9).alias("lr"))
