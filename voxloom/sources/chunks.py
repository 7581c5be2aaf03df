"""The chunk store: a row per chunk of a volume, written in generations; and patches cut out of it."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.patch_index import readable
from voxloom.schemas import VOLUME_CHUNKS

#: The column of the folders of a store, one for each write.
GENERATION = "written"
#: Chunks that are unpacked at once, and voxels that are handed on.
ROWS, VOXELS = 64, 1 << 18


def chunked(pages: DataFrame, size: int = 64) -> DataFrame:
    """Chunks (volume_id, cz, cy, cx, d, h, w, xct, mask) of pages (volume_id, z, height, width, pixels, mask).

    A group is one layer of chunks, ``size`` pages; d, h and w are the chunk's own extents, smaller at the far edges.
    ``mask`` (bytes like ``pixels``) may be null: no pores.
    """

    def layer(t: pa.Table) -> pa.Table:
        t = t.sort_by("z")
        h, w = t.column("height")[0].as_py(), t.column("width")[0].as_py()
        cube = np.stack([np.frombuffer(b.as_py(), np.uint8).reshape(h, w) for b in t.column("pixels")])
        mask = np.stack([np.frombuffer(b.as_py(), np.uint8).reshape(h, w) if b.is_valid else np.zeros((h, w), np.uint8) for b in t.column("mask")])
        name, cz = t.column("volume_id")[0].as_py(), t.column("z")[0].as_py() // size
        rows = [(name, cz, y // size, x // size, *cube[:, y : y + size, x : x + size].shape, cube[:, y : y + size, x : x + size].tobytes(), mask[:, y : y + size, x : x + size].tobytes()) for y in range(0, h, size) for x in range(0, w, size)]
        kinds = [pa.string(), *[pa.int32()] * 6, pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["volume_id", "cz", "cy", "cx", "d", "h", "w", "xct", "mask"])

    rows = pages.select("volume_id", "z", "height", "width", "pixels", F.col("mask").cast("binary").alias("mask") if "mask" in pages.columns else F.lit(None).cast("binary").alias("mask"))
    return rows.groupBy("volume_id", F.floor(F.col("z") / size)).applyInArrow(layer, VOLUME_CHUNKS)


def write(chunks: DataFrame, path: str) -> None:
    """Adds chunks to a store; volumes that are there already are replaced one by one, the others stay.

    A write is a generation, a folder of its own with as many files as tasks, however many volumes there are: the newest
    one that has a volume has all of it. Nothing that is there is touched, so a write that fails changes nothing.
    """
    chunks.write.parquet(f"{path}/{GENERATION}={time.time_ns()}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each volume's newest generation."""
    rows = spark.read.schema(f"{VOLUME_CHUNKS}, {GENERATION} long").parquet(path)
    if rows.select(GENERATION).distinct().limit(2).count() > 1:
        newest = rows.groupBy("volume_id").agg(F.max(GENERATION).alias(GENERATION))
        rows = rows.join(newest, ["volume_id", GENERATION], "left_semi")
    return rows.select(*[f.split(" ")[0] for f in VOLUME_CHUNKS.split(", ")])


def missing(volumes: DataFrame, stored: DataFrame) -> DataFrame:
    """The volumes that aren't in the store."""
    return volumes.join(stored.select("volume_id").distinct(), "volume_id", "left_anti")


def voxels(chunks: DataFrame, size: int = 64, columns: dict[str, str] | None = None) -> DataFrame:
    """The long form, for operators that work on voxels: (volume_id, z, y, x) and a column for each one of bytes in
    ``columns``, by its new name; v (of xct) and mask by default."""
    names = columns or {"xct": "v", "mask": "mask"}

    def long(held: list[dict]) -> pa.RecordBatch:
        places = [np.indices((r["d"], r["h"], r["w"]), np.int32).reshape(3, -1) + np.array([[r["cz"]], [r["cy"]], [r["cx"]]], np.int32) * np.int32(size) for r in held]
        own = np.repeat(np.arange(len(held)), [p.shape[1] for p in places])
        ids = pa.array([r["volume_id"] for r in held], pa.string()).take(pa.array(own))
        values = [pa.array(np.frombuffer(b"".join(r[c] for r in held), np.uint8).astype(np.int32)) for c in names]
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, np.concatenate(places, axis=1)), *values], ["volume_id", "z", "y", "x", *names.values()])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for k in range(0, batch.num_rows, ROWS):
                for r in batch.slice(k, ROWS).to_pylist():
                    held.append(r)
                    n += r["d"] * r["h"] * r["w"]
                    if n >= VOXELS:
                        yield long(held)
                        held, n = [], 0
            if held:
                yield long(held)

    rows = chunks.select("volume_id", "cz", "cy", "cx", "d", "h", "w", *names)
    return rows.mapInArrow(spread, "volume_id string, z int, y int, x int, " + ", ".join(f"{n} int" for n in names.values()))


def patches(index: DataFrame, chunks: DataFrame, split: str, size: int = 64) -> DataFrame:
    """The readable patches of a split with their voxels: index columns, xct (array, 0 to 1) and mask (array).

    A patch is joined to the chunks that it touches by chunk key (up to eight), and put together in one small group.
    """
    rows = readable(index, split)
    span = lambda a: F.explode(F.sequence(F.floor(F.col(f"{a}0") / size).cast("int"), F.floor((F.col(f"{a}0") + F.col("ps") - 1) / size).cast("int")))
    asked = rows
    for a in "zyx":
        asked = asked.withColumn(f"c{a}", span(a))
    parts = asked.join(chunks, ["volume_id", "cz", "cy", "cx"])
    columns = index.columns

    def assembled(t: pa.Table) -> pa.Table:
        r = t.slice(0, 1).to_pylist()[0]
        ps, origin = r["ps"], np.array([r["z0"], r["y0"], r["x0"]])
        out = {c: np.zeros((ps, ps, ps), np.uint8) for c in ("xct", "mask")}
        for part in t.to_pylist():
            low = np.array([part["cz"], part["cy"], part["cx"]]) * size
            extent = np.array([part["d"], part["h"], part["w"]])
            start, end = np.maximum(origin, low), np.minimum(origin + ps, low + extent)
            to, of = (tuple(slice(a, b) for a, b in zip(start - base, end - base, strict=True)) for base in (origin, low))
            for c, cube in out.items():
                cube[to] = np.frombuffer(part[c], np.uint8).reshape(extent)[of]
        keep = t.slice(0, 1).select(columns)
        return keep.append_column("xct", pa.array([(out["xct"] / np.float32(255)).ravel().tolist()], pa.list_(pa.float32()))).append_column("mask", pa.array([out["mask"].ravel().tolist()], pa.list_(pa.int16())))

    schema = index.select("*", F.lit(None).cast("array<float>").alias("xct"), F.lit(None).cast("array<smallint>").alias("mask")).schema
    return parts.groupBy("volume_id", "z0", "y0", "x0").applyInArrow(assembled, schema)

