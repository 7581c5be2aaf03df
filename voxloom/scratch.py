"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may go through the driver to all executors.
BROADCAST_ROWS = 50_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a folder of our own in a local session, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        base = _own[app]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: the lineage ends there, and a lost executor costs nothing.

    A table of more than ``BROADCAST_ROWS`` rows is joined by shuffles: what Spark sees of it is the size of its compressed
    files, by which it would send tables of many millions of rows through the driver.
    """
    path, counted = fresh_path(df.sparkSession, name), Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    return found.hint("merge") if counted.get["n"] > BROADCAST_ROWS else found
