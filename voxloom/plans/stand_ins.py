"""The engine's tables, made from the test tables, with the same in SQL for the oracles.

An embedding of 64 numbers is a 4 x 4 x 4 patch, or 8 latent channels of 8 positions; its label is the volume. The patch
after it (by vec_id, in a circle) is its ground truth. Events by user are volumes with patch porosities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, volume_id, batch_id, xct_logits, mask_logits, xct, mask, mu, logvar: one row per patch."""
    e = table(spark, sf_dir, "embeddings")
    own = F.transform("embedding", lambda v: v.cast("double"))
    n = e.count()
    a = e.select("vec_id", F.col("label").cast("string").alias("volume_id"), own.alias("mu"))
    b = e.select(((F.col("vec_id") + F.lit(n - 1)) % F.lit(max(1, n))).alias("vec_id"), own.alias("logvar"))
    return a.join(b, "vec_id").select(
        "vec_id", "volume_id", F.floor(F.col("vec_id") / 32).alias("batch_id"),
        F.transform("mu", lambda v: v * 8).alias("xct_logits"), F.transform("mu", lambda v: v * 8 - 1).alias("mask_logits"),
        F.transform("logvar", lambda v: F.least(F.greatest(v + 0.5, F.lit(0.0)), F.lit(1.0))).alias("xct"), F.transform("logvar", lambda v: F.when(v > 0.3, 1.0).otherwise(0.0)).alias("mask"),
        "mu", "logvar",
    )


#: The same in long form: e (vec_id, label, pos, v) and p (one row per patch and position).
OUTPUT_SQL = """
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
cnt AS (SELECT count(*) AS n FROM embeddings),
p AS (SELECT a.vec_id, a.label::VARCHAR AS volume_id, a.vec_id // 32 AS batch_id, a.pos, a.pos // 16 AS z, (a.pos // 4) % 4 AS y, a.pos % 4 AS x, a.pos // 8 AS ch,
             8 * a.v AS xl, 8 * a.v - 1 AS ml, least(greatest(b.v + 0.5, 0), 1) AS xct, CASE WHEN b.v > 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask, a.v AS mu, b.v AS logvar
      FROM e a CROSS JOIN cnt JOIN e b ON b.vec_id = (a.vec_id + 1) % cnt.n AND a.pos = b.pos)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id, patch_id, pos, v: intensities 0 to 255."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("volume_id"), F.col("vec_id").alias("patch_id"), F.posexplode("embedding").alias("pos", "e"))
    return e.select("volume_id", "patch_id", "pos", F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.55) * 230), F.lit(0)), F.lit(255)).cast("int").alias("v"))


VOXELS_SQL = """
e AS (SELECT label::VARCHAR AS volume_id, vec_id AS patch_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
voxels AS (SELECT volume_id, patch_id, pos, least(greatest(floor((e + 0.55) * 230), 0), 255)::INT AS v FROM e)"""


def set_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id, z, y, x of pore voxels: eight patches of a label side by side make a volume of 8 x 8 x 8."""
    return placed(spark, sf_dir).where("mask = 1").select("volume_id", "z", "y", "x")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id, z, y, x, e of dense volumes of 8 x 8 x 8 voxels; eight consecutive embeddings are a volume."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("string").alias("volume_id"), (F.col("vec_id") % 8).cast("int").alias("part"), F.posexplode("embedding").alias("pos", "e"))
    at = lambda part, pos: (part * 4 + pos).cast("int")
    return e.select("volume_id", at(F.floor(F.col("part") / 4), F.floor(F.col("pos") / 16)).alias("z"), at(F.floor(F.col("part") / 2) % 2, F.floor(F.col("pos") / 4) % 4).alias("y"), at(F.col("part") % 2, F.col("pos") % 4).alias("x"), "e")


def intensity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same volumes as chunks of 4 x 4 x 4 with intensities 0 to 255: an embedding is a chunk."""
    e, part = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 8
    level = lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.55) * 230), F.lit(0)), F.lit(255))
    xct = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(level(v)), 2, "0")), ""))
    at = [F.floor(part / 4), F.floor(part / 2) % 2, part % 2]
    return e.select(F.floor(F.col("vec_id") / 8).cast("string").alias("volume_id"), *[c.cast("int").alias(n) for c, n in zip(at, ("cz", "cy", "cx"), strict=True)], *[F.lit(4).alias(n) for n in "dhw"], xct.alias("xct"))


def placed(spark: SparkSession, sf_dir: str, above: float = 0.1) -> DataFrame:
    """volume_id, z, y, x, mask of the same volumes."""
    return dense(spark, sf_dir).select("volume_id", "z", "y", "x", (F.col("e") > F.lit(above).cast("float")).cast("int").alias("mask"))


#: With the mask above 0.1 as mask, and above 0.15 as sparse.
PLACED_SQL = """
e AS (SELECT (vec_id // 8)::VARCHAR AS volume_id, vec_id % 8 AS part, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
placed AS (SELECT volume_id, (part // 4) * 4 + pos // 16 AS z, ((part // 2) % 2) * 4 + (pos // 4) % 4 AS y, (part % 2) * 4 + pos % 4 AS x, e, (e > 0.1::FLOAT)::INT AS mask, (e > 0.15::FLOAT)::INT AS sparse FROM e)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("volume_id") % 5 == 0, "val").when(F.col("volume_id") % 5 == 1, "test").otherwise("train")
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("volume_id")).distinct()
    return v.select(F.col("volume_id").cast("string").alias("volume_id"), F.lit("others/stand_in").alias("source_group"), split.alias("split"), F.lit(8).alias("d"), F.lit(8).alias("h"), F.lit(8).alias("w"))


SHAPES_SQL = """
shapes AS (SELECT DISTINCT (vec_id // 8)::VARCHAR AS volume_id, 'others/stand_in' AS source_group, CASE (vec_id // 8) % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM embeddings)"""


def porosities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch index by user: volume_id, patch_id, split, porosity."""
    e = table(spark, sf_dir, "events")
    split = F.when(F.col("event_type") == "view", "val").when(F.col("event_type") == "error", "test").otherwise("train")
    return e.select(F.col("user_id").cast("string").alias("volume_id"), F.col("event_id").alias("patch_id"), split.alias("split"), (F.col("value") / 100).alias("porosity"))


POROSITIES_SQL = """
idx AS (SELECT user_id::VARCHAR AS volume_id, event_id AS patch_id, CASE event_type WHEN 'view' THEN 'val' WHEN 'error' THEN 'test' ELSE 'train' END AS split, value / 100 AS porosity FROM events)"""
