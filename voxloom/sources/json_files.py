"""Split maps and volume statistics as JSON documents, training logs as JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.splits import split_column
from voxloom.schemas import SPLIT_NAMES, SPLITS, VOLUME_STATS


#: Volumes of a document that goes through the driver; larger maps are tables (``write_split_lines``).
MOST_VOLUMES = 100_000


def _few(rows: DataFrame) -> list:
    found = rows.limit(MOST_VOLUMES + 1).collect()
    if len(found) > MOST_VOLUMES:
        raise ValueError(f"a document holds {MOST_VOLUMES} volumes at most; write the table instead")
    return found


def write_split_lines(splits: DataFrame, path: str, seed: int) -> None:
    """A split map as JSON lines, one for each volume, for any number of volumes."""
    splits.select("volume_id", "split", F.lit(seed).alias("seed")).write.mode("overwrite").json(path)


def read_split_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPLITS).json(path)


def splits_document(splits: DataFrame, seed: int, before: str | None = None) -> str:
    """The JSON text of a split map: seed, counts and volumes, merged into an earlier document. It has a line per volume
    and is made for the few volumes of a study; larger maps are tables."""
    volumes = {r.volume_id: r.split for r in _few(splits.select("volume_id", "split"))}
    counts = {s: sum(v == s for v in volumes.values()) for s in SPLIT_NAMES}
    return json.dumps((json.loads(before) if before else {}) | {"seed": seed, "counts": counts, "volumes": volumes}, indent=2)


def splits_summary(splits: DataFrame, seed: int) -> str:
    """The JSON text of a split map without its volumes: seed and counts."""
    found = {r.split: r.n for r in splits.groupBy("split").agg(F.countDistinct("volume_id").alias("n")).where(F.col("split").isin(*SPLIT_NAMES)).collect()}
    return json.dumps({"seed": seed, "counts": {s: found.get(s, 0) for s in SPLIT_NAMES}}, indent=2)


def read_splits(spark: SparkSession, path: str, version: str = "v1") -> DataFrame:
    """(volume_id, split) of a split map. Version 2 may be a plain map or a map to objects with a split."""
    key = "volumes" if split_column(version) == "split" else "split_v2"
    doc = spark.read.text(path, wholetext=True)
    entries = F.from_json(F.get_json_object("value", f"$.{key}"), "map<string,string>")
    pairs = doc.select(F.explode(entries).alias("volume_id", "entry"))
    return pairs.select("volume_id", F.coalesce(F.get_json_object(F.when(F.startswith("entry", F.lit("{")), F.col("entry")), "$.split"), "entry").alias("split"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The volume statistics of a JSON document; a missing file is an empty table."""
    try:
        doc = spark.read.text(path, wholetext=True)
    except Exception as e:  # Spark reports a missing path when it plans the read
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], VOLUME_STATS)
    entry = "struct<mean:double,std:double,n_foreground:bigint,otsu_threshold:int>"
    return doc.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("volume_id", "s")).select("volume_id", "s.*")


def stats_document(stats: DataFrame) -> str:
    """The JSON text of volume statistics."""
    out = {}
    for r in _few(stats):
        d = r.asDict()
        name = d.pop("volume_id")
        out[name] = {k: v for k, v in d.items() if v is not None}
    return json.dumps(out, indent=2)


def append_log(records: DataFrame, path: str) -> None:
    """Adds records to a folder of JSON lines."""
    records.write.mode("append").json(path)

