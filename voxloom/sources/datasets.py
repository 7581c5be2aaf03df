"""Dataset folders: a patch index, its splits and statistics, and voxels that several folders share by reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.splits import derived_index
from voxloom.schemas import VOLUME_STATS
from voxloom.sources import json_files

INDEX, SPLIT_MAP, SPLIT_LINES, STATS, VOXELS = "patch_index", "splits", "split_lines", "volume_stats", "voxels"


def _text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def voxel_path(spark: SparkSession, root: str) -> str:
    """Where the voxels of a dataset lie: in its own folder, or where its reference points."""
    try:
        return spark.read.json(f"{root}/{VOXELS}_link").first()["path"]
    except Exception as e:  # Spark reports a missing path when it plans the read
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return f"{root}/{VOXELS}"


def write_root(spark: SparkSession, root: str, index: DataFrame, splits: DataFrame, stats: DataFrame, seed: int) -> None:
    """A dataset folder from its tables; voxels are written by ``chunks.write``. Splits are written as lines, for any number
    of volumes, and as a document, which has no volumes if there are too many for one."""
    index.write.mode("overwrite").parquet(f"{root}/{INDEX}")
    json_files.write_split_lines(splits, f"{root}/{SPLIT_LINES}", seed)
    few = splits.limit(json_files.MOST_VOLUMES + 1).count() <= json_files.MOST_VOLUMES
    _text(spark, json_files.splits_document(splits, seed) if few else json_files.splits_summary(splits, seed), f"{root}/{SPLIT_MAP}")
    stats.write.mode("overwrite").json(f"{root}/{STATS}")


def root_splits(spark: SparkSession, root: str, version: str = "v1") -> DataFrame:
    """(volume_id, split) of a dataset folder: its lines, or the document of a folder that has none."""
    lines = _lines(spark, root)
    return lines.select("volume_id", "split") if lines is not None else json_files.read_splits(spark, f"{root}/{SPLIT_MAP}", version)


def _lines(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return json_files.read_split_lines(spark, f"{root}/{SPLIT_LINES}")
    except Exception as e:  # Spark reports a missing path when it plans the read
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def derive_root(spark: SparkSession, source: str, target: str, splits: DataFrame | None = None, seed: int | None = None) -> None:
    """A dataset that shares the voxels of another one. With ``splits`` it keeps the volumes that those assign to train,
    val or test, with their new split, and needs a seed; without, it is a copy. An empty result is an error."""
    index = spark.read.parquet(f"{source}/{INDEX}")
    stats = spark.read.schema(VOLUME_STATS).json(f"{source}/{STATS}")
    if splits is None:
        index.write.mode("overwrite").parquet(f"{target}/{INDEX}")
        if _lines(spark, source) is not None:
            spark.read.text(f"{source}/{SPLIT_LINES}").write.mode("overwrite").text(f"{target}/{SPLIT_LINES}")
        spark.read.text(f"{source}/{SPLIT_MAP}", wholetext=True).coalesce(1).write.mode("overwrite").text(f"{target}/{SPLIT_MAP}")
        stats.write.mode("overwrite").json(f"{target}/{STATS}")
    else:
        if seed is None:
            raise ValueError("a derived dataset needs the seed of its splits")
        kept = derived_index(index, splits)
        if kept.isEmpty():
            raise ValueError("the derived dataset would hold no patches")
        write_root(spark, target, kept, splits, stats.join(splits.where("split <> 'excluded'"), "volume_id", "left_semi"), seed)
    spark.createDataFrame([(voxel_path(spark, source),)], "path string").coalesce(1).write.mode("overwrite").json(f"{target}/{VOXELS}_link")


def migrated(spark: SparkSession, source: str, first: str, second: str, splits: DataFrame, seed: int) -> None:
    """Two dataset folders out of one with an old layout: ``first`` keeps its splits, ``second`` has those given. Both
    refer to the voxels of ``source``, which stays as it is. A target that is there already is an error."""
    for target in (first, second):
        try:
            spark.read.parquet(f"{target}/{INDEX}")
        except Exception as e:  # Spark reports a missing path when it plans the read
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            raise ValueError(f"{target} is there already")
    derive_root(spark, source, first)
    derive_root(spark, first, second, splits, seed)


def report_document(reports: DataFrame, summary: DataFrame) -> DataFrame:
    """(value): the evaluation report as one line of JSON per volume, after a line with the summary."""
    head = summary.select(F.to_json(F.struct(F.lit("summary").alias("kind"), *summary.columns)).alias("value"), F.lit(0).alias("at"))
    body = reports.select(F.to_json(F.struct(F.lit("volume").alias("kind"), *reports.columns)).alias("value"), F.lit(1).alias("at"))
    return head.unionByName(body).orderBy("at", "value").select("value")
