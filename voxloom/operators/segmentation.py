"""Segmentation of volumes: local and global thresholds, material mask, pores.

Volumes are chunks (volume_id, cz, cy, cx, d, h, w, xct; dense, see ``sources.chunks``) and stay chunks: a mask is one more
column of bytes. Only strips at the faces of chunks are shuffled for local thresholds, and runs in the faces for what spans
a volume (voids and pores, see ``chunk_labels``); boxes and histograms are partial aggregations. No volume has to fit into a
task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import chunk_labels, statistics
from voxloom.operators.components import labelled_runs, merged, runs, sizes, spread
from voxloom.scratch import saved
from voxloom.sources.chunks import ROWS

RANGE = 128.0
#: A value that exceeds its threshold by less than rounding errors of sums doesn't exceed it.
TIE = 1e-9
MARGIN = 4
CHUNK = ["volume_id", "cz", "cy", "cx"]
EXTENT = ["d", "h", "w"]
BOX = ["z0", "z1", "y0", "y1", "x0", "x1"]
_KEYS = "volume_id string, cz int, cy int, cx int"
_RUNS = "volume_id string, z int, y int, x0 int, x1 int"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _several(out: dict | list[dict] | None) -> list[dict | None]:
    return out if isinstance(out, list) else [out]


def _per_chunk(chunks: DataFrame, schema: str, rows: Callable[[dict], dict | list[dict] | None]) -> DataFrame:
    """What ``rows`` makes of each chunk: columns of ``schema``, single values or arrays of equal length, or a list of
    such. Chunks come and go ``ROWS`` at a time."""
    columns = [c.split(" ") for c in schema.split(", ")]

    def made(held: list[dict]) -> pa.RecordBatch:
        times = [max((len(v) for v in out.values() if isinstance(v, np.ndarray)), default=1) for out in held]
        own = pa.array(np.repeat(np.arange(len(held)), times))
        arrays = []
        for c, kind in columns:
            if isinstance(held[0][c], np.ndarray):
                arrays.append(pa.array(np.concatenate([out[c].astype(np.int64) for out in held])).cast(_KINDS[kind]))
            else:
                arrays.append(pa.array([out[c] for out in held], _KINDS[kind]).take(own))
        return pa.RecordBatch.from_arrays(arrays, [c for c, _ in columns])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                held = [out for r in batch.slice(k, ROWS).to_pylist() for out in _several(rows(r)) if out is not None]
                if held:
                    yield made(held)

    return chunks.mapInArrow(mapped, schema)


def _cube(r: dict, column: str = "xct") -> np.ndarray:
    return np.frombuffer(r[column], np.uint8).reshape([r[c] for c in EXTENT])


def _inside(r: dict, size: int) -> tuple[slice, ...]:
    """The part of a chunk that lies in the row's box."""
    return tuple(slice(max(0, r[f"{a}0"] - r[f"c{a}"] * size), max(0, min(r[n], r[f"{a}1"] + 1 - r[f"c{a}"] * size))) for a, n in zip("zyx", EXTENT, strict=True))


def _lines(on: np.ndarray, r: dict, size: int) -> dict | None:
    """The runs along x of a chunk's set voxels; a run ends at the chunk's face."""
    wide = np.pad(on.astype(np.int8), [(0, 0), (0, 0), (1, 1)])
    step = np.diff(wide, axis=2)
    (z, y, x0), (_, _, x1) = np.nonzero(step == 1), np.nonzero(step == -1)
    if not len(z):
        return None
    return {"volume_id": r["volume_id"], "z": z + r["cz"] * size, "y": y + r["cy"] * size, "x0": x0 + r["cx"] * size, "x1": x1 - 1 + r["cx"] * size}


def histogram(chunks: DataFrame) -> DataFrame:
    """(volume_id, v, n) of the intensities that occur."""

    def counts(r: dict) -> dict:
        n = np.bincount(np.frombuffer(r["xct"], np.uint8), minlength=256)
        return {"volume_id": r["volume_id"], "v": np.flatnonzero(n), "n": n[n > 0]}

    return _per_chunk(chunks, "volume_id string, v int, n long", counts).groupBy("volume_id", "v").agg(F.sum("n").alias("n"))


def sauvola(wide: np.ndarray, window: int, k: float) -> np.ndarray:
    """Whether pixels exceed the threshold m (1 + k (s / 128 - 1)) of their window, slice by slice along the middle axis.

    ``wide`` has ``window // 2`` pixels more on each end of the first and last axis than the result.
    """
    w, wide = 2 * (window // 2) + 1, wide.astype(np.float64)

    def box(a: np.ndarray) -> np.ndarray:
        s = np.pad(a, [(1, 0), (0, 0), (1, 0)]).cumsum(axis=0).cumsum(axis=2)
        return (s[w:, :, w:] - s[:-w, :, w:] - s[w:, :, :-w] + s[:-w, :, :-w]) / (w * w)

    m = box(wide)
    s = np.sqrt(np.maximum(box(wide * wide) - m * m, 0))
    p = w // 2
    return wide[p : wide.shape[0] - p, :, p : wide.shape[2] - p] - m * (1 + k * (s / RANGE - 1)) > TIE


def box_of(chunks: DataFrame, size: int = 64) -> DataFrame:
    """(volume_id, z0, z1, y0, y1, x0, x1): what holds all voxels above 0, and ``MARGIN`` around it inside the volume."""

    def ends(r: dict) -> dict:
        cube, out = _cube(r), {"volume_id": r["volume_id"]}
        for k, (a, n) in enumerate(zip("zyx", EXTENT, strict=True)):
            at = np.flatnonzero(cube.any(axis=tuple({0, 1, 2} - {k}))) + r[f"c{a}"] * size
            out |= {f"{a}0": int(at[0]) if len(at) else None, f"{a}1": int(at[-1]) if len(at) else None, f"n{a}": r[f"c{a}"] * size + r[n] - 1}
        return out

    found = _per_chunk(chunks, "volume_id string, " + ", ".join(f"{a}0 int, {a}1 int, n{a} int" for a in "zyx"), ends)
    out = found.groupBy("volume_id").agg(*[f(f"{a}{n}").alias(f"{a}{n}") for a in "zyx" for n, f in (("0", F.min), ("1", F.max))], *[F.max(f"n{a}").alias(f"n{a}") for a in "zyx"]).where("z0 is not null")
    return out.select("volume_id", *[c for a in "zyx" for c in (F.greatest(F.col(f"{a}0") - MARGIN, F.lit(0)).alias(f"{a}0"), F.least(F.col(f"{a}1") + MARGIN, F.col(f"n{a}")).alias(f"{a}1"))])


def whole_box(chunks: DataFrame, size: int = 64) -> DataFrame:
    """The same columns for the whole of each volume."""
    end = lambda a, n: F.max(F.col(f"c{a}") * size + F.col(n) - 1).cast("int").alias(f"{a}1")
    return chunks.groupBy("volume_id").agg(*[end(a, n) for a, n in zip("zyx", EXTENT, strict=True)]).select("volume_id", *[c for a in "zyx" for c in (F.lit(0).alias(f"{a}0"), F.col(f"{a}1"))])


def local_threshold(chunks: DataFrame, window: int, k: float, size: int = 64, box: DataFrame | None = None) -> DataFrame:
    """(volume_id, cz, cy, cx, d, h, w, binary): Sauvola's threshold in every slice of equal y; binary marks material.

    An even window grows by one; edges are mirrored. With ``box``, only what lies in a volume's box is seen, the rest is 0.
    A chunk sends strips of half a window to the chunks around it that the box reaches.
    """
    half = window // 2
    far = max(1, math.ceil(half / size))
    rows = chunks.select(*CHUNK, *EXTENT, "xct").join(box if box is not None else whole_box(chunks, size), "volume_id")
    steps = [(dz, dx) for dz in range(-far, far + 1) for dx in range(-far, far + 1)]

    def strips(r: dict) -> list[dict]:
        cube, out = _cube(r), []
        seen = [range(r[f"{a}0"] // size - r[f"c{a}"], r[f"{a}1"] // size - r[f"c{a}"] + 1) for a in "zx"]
        for dz, dx in steps:
            if (dz or dx) and (dz not in seen[0] or dx not in seen[1]):
                continue
            # The part that the chunk (dz, dx) further sees, and the row and column where it starts there.
            z, x = (slice(max(0, d * size - half), min(n, (d + 1) * size + half)) for d, n in ((dz, r["d"]), (dx, r["w"])))
            part = cube[z, :, x]
            if part.size:
                out.append({"volume_id": r["volume_id"], "cz": r["cz"] + dz, "cy": r["cy"], "cx": r["cx"] + dx, "own": int(dz == dx == 0), "z": z.start - dz * size, "x": x.start - dx * size, "d": part.shape[0], "h": part.shape[1], "w": part.shape[2], "part": part.tobytes(), **{c: r[c] for c in BOX}})
        return out

    ddl = f"{_KEYS}, own int, z int, x int, d int, h int, w int, part binary, " + ", ".join(f"{c} int" for c in BOX)

    def mirrored(first: int, n: int, low: int, high: int) -> np.ndarray:
        """Where each of n places from ``first`` - half reads from, mirrored at low and high."""
        at = np.arange(first - half, first + n + half) - low
        turn = 2 * (high - low)
        at = at % turn if turn else at * 0
        return np.minimum(at, turn - at) + low

    def judged(r: dict) -> dict | None:
        parts = r["parts"]
        own = next((p for p in parts if p["own"]), None)
        if own is None:
            return None
        own |= {c: r[c] for c in CHUNK}
        field = np.zeros((size + 2 * half, own["h"], size + 2 * half), np.uint8)
        for p in parts:
            field[p["z"] + half : p["z"] + half + p["d"], :, p["x"] + half : p["x"] + half + p["w"]] = _cube(p, "part")
        where = _inside(own, size)
        out = np.zeros([own[c] for c in EXTENT], np.uint8)
        if out[where].size:
            from_z, from_x = (mirrored(s.start, s.stop - s.start, own[f"{a}0"] - own[f"c{a}"] * size, own[f"{a}1"] - own[f"c{a}"] * size) + half for s, a in ((where[0], "z"), (where[2], "x")))
            out[where] = sauvola(field[np.ix_(from_z, np.arange(where[1].start, where[1].stop), from_x)], window, k)
        return {c: own[c] for c in (*CHUNK, *EXTENT)} | {"binary": out.tobytes()}

    around = _per_chunk(rows, ddl, strips).groupBy(*CHUNK).agg(F.collect_list(F.struct("own", "z", "x", *EXTENT, "part", *BOX)).alias("parts"))
    return _per_chunk(around, f"{_KEYS}, d int, h int, w int, binary binary", judged)


def cleaned_slices(voxels: DataFrame, least: int = 2) -> DataFrame:
    """The set voxels without 2-D components (4-connected, slices of equal z) of fewer than ``least`` pixels."""
    labels = saved(labelled_runs(runs(voxels), 4), "slices")
    return spread(labels.join(sizes(labels).where(F.col("size") >= least), ["volume_id", "label"], "left_semi").drop("label"))


def material_mask(chunks: DataFrame, size: int = 64, box: DataFrame | None = None) -> DataFrame:
    """(volume_id, cz, cy, cx, d, h, w, sample): above Otsu's threshold, within the box of the first component of the
    projection along z (8-connected; the first by rows, which need not be the largest), with enclosed voids filled.

    With ``box``, a volume is what lies in its box.
    """
    rows = chunks.select(*CHUNK, *EXTENT, "xct").join(box if box is not None else whole_box(chunks, size), "volume_id")

    def cropped(r: dict) -> dict:
        values = _cube(r)[_inside(r, size)]
        n = np.bincount(values.ravel(), minlength=256)
        return {"volume_id": r["volume_id"], "v": np.flatnonzero(n), "n": n[n > 0]}

    limits = statistics.otsu(_per_chunk(rows, "volume_id string, v int, n long", cropped).groupBy("volume_id", "v").agg(F.sum("n").alias("n")))
    limits = saved(limits, "limits")
    marked = rows.join(limits, "volume_id")

    def on(r: dict) -> np.ndarray:
        out = np.zeros([r[c] for c in EXTENT], bool)
        where = _inside(r, size)
        out[where] = _cube(r)[where] > r["otsu_threshold"]
        return out

    def shadow(r: dict) -> dict | None:
        found = _lines(on(r).any(axis=0)[None], r, size)
        return None if found is None else found | {"z": found["z"] * 0}

    labels = saved(labelled_runs(merged(_per_chunk(marked, _RUNS, shadow)), 8), "shadow")
    first = labels.groupBy("volume_id").agg(F.min("label").alias("label"))
    ends = labels.join(first, ["volume_id", "label"]).groupBy("volume_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    inner = marked.drop("y0", "y1", "x0", "x1").join(saved(ends, "ends"), "volume_id")

    def gaps(r: dict) -> np.ndarray:
        out = np.zeros([r[c] for c in EXTENT], bool)
        where = _inside(r, size)
        out[where] = ~on(r)[where]
        return out

    voids = saved(chunk_labels.labelled(chunk_labels.pieces(inner, gaps, 6, size), 6, size), "voids")
    filled = chunk_labels.by_chunk(voids, ~F.col("open"), "filled")

    def solid(r: dict) -> dict:
        out = chunk_labels.chosen(r, gaps(r), 6, size, "filled")
        where = _inside(r, size)
        out[where] |= on(r)[where]
        return {c: r[c] for c in (*CHUNK, *EXTENT)} | {"sample": out.astype(np.uint8).tobytes()}

    return _per_chunk(inner.join(filled, CHUNK, "left"), f"{_KEYS}, d int, h int, w int, sample binary", solid)


def clean_pores(pores: DataFrame, least: int = 8) -> DataFrame:
    """The voxels of 26-connected pores of ``least`` voxels or more that extend over two voxels or more on every axis."""
    labels = saved(labelled_runs(runs(pores), 26), "pores")
    return spread(labels.join(sizes(labels).where(_is_pore(least)), ["volume_id", "label"], "left_semi").drop("label"))


def _is_pore(least: int) -> Column:
    return (F.col("size") >= least) & (F.col("dz") >= 2) & (F.col("dy") >= 2) & (F.col("dx") >= 2)


def segmented_pores(chunks: DataFrame, frontwall: int = 0, backwall: int = 0, window: int = 30, k: float = 0.125, least: int = -1, size: int = 64) -> DataFrame:
    """(volume_id, cz, cy, cx, d, h, w, pore, sample, binary): bytes 0 or 1 of the volumes that hold anything above 0.

    Local threshold and material mask see the box of the data only; wall slices count from the box's first slice and are
    material. A pore is what the local threshold leaves inside the sample; ``least`` > 0 removes small and flat ones.
    """
    return _segmented(saved(chunks.select(*CHUNK, *EXTENT, "xct"), "chunks"), frontwall, backwall, window, k, least, size)  # six passes read them


def _segmented(chunks: DataFrame, frontwall: int = 0, backwall: int = 0, window: int = 30, k: float = 0.125, least: int = -1, size: int = 64) -> DataFrame:
    box = saved(box_of(chunks, size), "box")
    local = local_threshold(chunks, window, k, size, box).select(*CHUNK, *EXTENT, "binary").join(box, "volume_id")
    both = local.join(material_mask(chunks, size, box).select(*CHUNK, "sample"), CHUNK, "left")

    def combined(r: dict) -> dict:
        binary = _cube(r, "binary").astype(bool)
        at = np.arange(r["d"])[:, None, None] + r["cz"] * size - r["z0"]
        wall = ((at < frontwall) if frontwall > 0 else at != at) | ((at >= backwall) if backwall > 0 else at != at)
        where = _inside(r, size)
        binary[where] |= np.broadcast_to(wall, binary.shape)[where]
        sample = _cube(r, "sample").astype(bool) if r["sample"] is not None else np.zeros(binary.shape, bool)
        masks = {"pore": sample & ~binary, "sample": sample, "binary": binary}
        return {c: r[c] for c in (*CHUNK, *EXTENT)} | {c: m.astype(np.uint8).tobytes() for c, m in masks.items()}

    schema = f"{_KEYS}, d int, h int, w int, pore binary, sample binary, binary binary"
    out = saved(_per_chunk(both, schema, combined), "segmented")
    if least <= 0:
        return out
    pore = lambda r: _cube(r, "pore").astype(bool)
    found = saved(chunk_labels.labelled(chunk_labels.pieces(out.select(*CHUNK, *EXTENT, "pore"), pore, 26, size), 26, size), "pores")
    kept = chunk_labels.by_chunk(found, _is_pore(least), "kept")
    redrawn = lambda r: {c: r[c] for c in (*CHUNK, *EXTENT, "sample", "binary")} | {"pore": chunk_labels.chosen(r, pore(r), 26, size, "kept").astype(np.uint8).tobytes()}
    return _per_chunk(out.join(kept, CHUNK, "left"), schema, redrawn)


def masks(chunks: DataFrame, size: int = 64, **options) -> DataFrame:
    """(volume_id, cz, cy, cx, d, h, w, mask, sample) of every chunk; a volume without data has no pores and is all sample."""
    chunks = saved(chunks.select(*CHUNK, *EXTENT, "xct"), "chunks")
    found = _segmented(chunks, size=size, **options).select(*CHUNK, "pore", "sample")
    n = (F.col("d") * F.col("h") * F.col("w")).cast("int")
    filled = lambda c, byte: F.coalesce(F.col(c), F.unhex(F.repeat(F.lit(byte), n)))
    return chunks.select(*CHUNK, *EXTENT).join(found, CHUNK, "left").select(*CHUNK, *EXTENT, filled("pore", "00").alias("mask"), filled("sample", "01").alias("sample"))
