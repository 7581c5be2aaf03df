"""Training logs as streams: running moments, windows, and the sinks that a training run appends to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "step long, split string, elapsed double, total double, kl double, beta double, active_fraction double, full_eval boolean, n_batches int"


def logs(spark: SparkSession, folder: str, schema: str = LOG) -> DataFrame:
    """A stream of the JSON lines that are appended to a folder."""
    return spark.readStream.schema(schema).json(folder)


def is_due(step: Column, every: int) -> Column:
    """Whether something that happens every so many steps happens at this one (counted from 0)."""
    return (step + 1) % every == 0


def running_moments(records: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, s, q): mergeable moments; on a stream the state is three numbers per key."""
    v = F.col(value).cast("double")
    return records.groupBy(key).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


MOMENTS = "batch_id long, ch int, n long, s double, q double"


def rolling_moments(records: DataFrame, window: int = 50) -> DataFrame:
    """(batch_id, ch, n, s, q): on a stream of each batch's moments by channel, those of its last ``window`` batches.

    A channel's state is its last ``window`` moments. Batches of a channel come in order; a record that isn't later than
    the last one is a repeat and is left out. ``patch_metrics.counted_active`` counts the active channels.
    """

    def rolled(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for r in pd.concat(list(parts)).sort_values("batch_id").itertuples():
            if held and r.batch_id <= held[-1][0]:
                continue
            held = [*held[max(0, len(held) + 1 - window) :], (int(r.batch_id), int(r.n), float(r.s), float(r.q))]
            out.append((r.batch_id, key[0], *(sum(h[k] for h in held) for k in (1, 2, 3))))
        if held:
            state.update(tuple(list(x) for x in zip(*held, strict=True)))
        yield pd.DataFrame(out, columns=["batch_id", "ch", "n", "s", "q"])

    own = records.select(F.col("batch_id").cast("long"), F.col("ch").cast("int"), F.col("n").cast("long"), F.col("s").cast("double"), F.col("q").cast("double"))
    return own.groupBy("ch").applyInPandasWithState(rolled, MOMENTS, "ids array<long>, n array<long>, s array<double>, q array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed(records: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, key, n, mean) per time window; windows close when the watermark has passed them."""
    timed = records.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    out = timed.groupBy(F.window("_time", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), key, "n", "mean")


def kept_current(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs an aggregated stream over what is there and stops; ``path`` then holds the whole current result."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def appended(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's new rows to a folder of JSON lines, exactly once, and stops."""
    return result.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
