"""Connected components of masks in chunks: each chunk is labelled in its task, and chunks are joined at their faces.

A task finds the components of its own chunk by union-find over runs of voxels along x. What leaves it is a row for each of
them (its extents and size), and the runs that lie in the chunk's six faces. Runs of neighbouring chunks that touch tie two
components together; ``components`` joins those ties over the volume. So the rows that are shuffled grow with the chunks'
surface and their number of components, not with their voxels. A mask is applied by finding the same components in a second
pass over the chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.components import NEIGHBOURS, components, joined
from voxloom.scratch import saved
from voxloom.sources.chunks import ROWS

#: A component is named by its first voxel in the order of z, y, x: (z << 42) + (y << 21) + x, so volumes have up to 2^21 voxels a side.
_AXIS = 21
_PIECES = "volume_id string, cz int, cy int, cx int, first long, whole boolean, size long, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int, open boolean"


class Labelled:
    """The runs along x of a mask, in the order of z, y, x, and ``root``: the first run of each run's component."""

    def __init__(self, on: np.ndarray, connectivity: int):
        self.shape = on.shape
        step = np.diff(np.pad(on.astype(np.int8), [(0, 0), (0, 0), (1, 1)]), axis=2)
        (self.z, self.y, self.x0), (_, _, end) = np.nonzero(step == 1), np.nonzero(step == -1)
        self.x1 = end - 1
        near, gap = NEIGHBOURS[connectivity]
        d, h, w = on.shape
        wide = w + 4  # lines lie so far apart that a gap never reaches the next one
        line = (self.z * h + self.y) * wide + 2
        begins, ends, own = line + self.x0, line + self.x1, np.arange(len(self.z))
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        for dz, dy in near:
            some = own[(self.z + dz < d) & (self.y + dy >= 0) & (self.y + dy < h)]
            to = ((self.z[some] + dz) * h + self.y[some] + dy) * wide + 2
            low = np.searchsorted(ends, to + self.x0[some] - gap)
            n = np.maximum(np.searchsorted(begins, to + self.x1[some] + gap, side="right") - low, 0)
            a.append(np.repeat(some, n))
            b.append(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
        self.root = joined(len(own), np.concatenate(a), np.concatenate(b))

    def first(self, r: dict, size: int) -> np.ndarray:
        """The name of each run's component."""
        at = lambda values, c: (values[self.root] + r[c] * size).astype(np.int64)
        return (at(self.z, "cz") << 2 * _AXIS) + (at(self.y, "cy") << _AXIS) + at(self.x0, "cx")

    def drawn(self, runs: np.ndarray) -> np.ndarray:
        """The mask of the given runs (a boolean for each)."""
        d, h, w = self.shape
        edge = np.zeros((d, h, w + 1), np.int8)
        edge[self.z[runs], self.y[runs], self.x0[runs]] = 1
        np.subtract.at(edge, (self.z[runs], self.y[runs], self.x1[runs] + 1), 1)
        return np.cumsum(edge, axis=2, dtype=np.int8)[:, :, :w].astype(bool)


def _rows(r: dict, on: np.ndarray, connectivity: int, size: int) -> pa.RecordBatch | None:
    """The components of a chunk, and their runs in its faces."""
    found = Labelled(on, connectivity)
    if not len(found.z):
        return None
    first = found.first(r, size)
    roots, which = np.unique(found.root, return_inverse=True)

    def extreme(f: np.ufunc, values: np.ndarray) -> np.ndarray:
        out = values[roots]
        f.at(out, which, values)
        return out

    border = np.zeros(len(found.z), bool)
    if "z0" in r:
        for a, low, high in (("z", found.z, found.z), ("y", found.y, found.y), ("x", found.x0, found.x1)):
            border |= (low == r[f"{a}0"] - r[f"c{a}"] * size) | (high == r[f"{a}1"] - r[f"c{a}"] * size)
    lengths = found.x1 - found.x0 + 1
    wholes = [first[roots], np.ones(len(roots), bool), np.bincount(which, lengths).astype(np.int64)]
    wholes += [extreme(np.minimum, found.z), extreme(np.maximum, found.z), extreme(np.minimum, found.y), extreme(np.maximum, found.y), extreme(np.minimum, found.x0), extreme(np.maximum, found.x1)]
    wholes.append(np.bincount(which, border) > 0)
    d, h, w = on.shape
    flat = (found.z == 0) | (found.z == d - 1) | (found.y == 0) | (found.y == h - 1)
    sides = [np.flatnonzero(flat), np.flatnonzero(~flat & (found.x0 == 0)), np.flatnonzero(~flat & (found.x1 == w - 1))]
    at = np.concatenate(sides)
    x0 = np.concatenate([found.x0[sides[0]], found.x0[sides[1]], found.x1[sides[2]]])
    x1 = np.concatenate([found.x1[sides[0]], found.x0[sides[1]], found.x1[sides[2]]])
    faces = [first[at], np.zeros(len(at), bool), np.zeros(len(at), np.int64), found.z[at], found.z[at], found.y[at], found.y[at], x0, x1, np.zeros(len(at), bool)]
    columns = [np.concatenate(p) for p in zip(wholes, faces, strict=True)]
    for k, a in enumerate("zzyyxx", 3):
        columns[k] = columns[k] + r[f"c{a}"] * size
    n = len(columns[0])
    arrays = [pa.array([r["volume_id"]] * n, pa.string()), *(pa.array(np.full(n, r[c], np.int32)) for c in ("cz", "cy", "cx"))]
    arrays += [pa.array(c if c.dtype == bool else c.astype(np.int32 if 3 <= k <= 8 else np.int64)) for k, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, [c.split(" ")[0] for c in _PIECES.split(", ")])


def pieces(chunks: DataFrame, on: Callable[[dict], np.ndarray], connectivity: int, size: int) -> DataFrame:
    """A written table of the components of each chunk (``whole``) and of their runs in its faces; ``on`` gives a chunk's
    mask. Where chunks have columns z0 ... x1 (a box in the volume), a component at the box's border is open."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                found = [out for r in batch.slice(k, ROWS).to_pylist() if (out := _rows(r, on(r), connectivity, size)) is not None]
                if found:
                    yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    return saved(chunks.mapInArrow(mapped, _PIECES), "pieces")


def ties(found: DataFrame, connectivity: int, size: int) -> DataFrame:
    """(a, b): components (volume_id, first) of neighbouring chunks that touch."""
    near, gap = NEIGHBOURS[connectivity]
    node = F.struct("volume_id", "first")
    faces = found.where(~F.col("whole")).select("volume_id", "cz", "cy", "cx", F.col("z0").alias("z"), F.col("y0").alias("y"), "x0", "x1", node.alias("node"))
    # A run meets runs of its own chunk's place along x, and of the next place if it touches that face.
    to = lambda c, on: F.when(on, F.array(F.struct((F.col("cx") + c).cast("int").alias("cx"), F.lit(gap).alias("gap")))).otherwise(F.array())
    beside = F.concat(F.array(F.struct(F.col("cx").alias("cx"), F.lit(gap).alias("gap"))), to(1, F.col("x1") % size == size - 1), to(-1, F.col("x0") % size == 0)) if gap else F.array(F.struct(F.col("cx").alias("cx"), F.lit(0).alias("gap")))
    lines = F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in near])
    across = faces.select("*", F.explode(lines).alias("d")).select("*", F.explode(beside).alias("to"))
    along = faces.where(F.col("x1") % size == size - 1).select("*", F.struct(F.lit(0).alias("dz"), F.lit(0).alias("dy")).alias("d"), F.struct((F.col("cx") + 1).cast("int").alias("cx"), F.lit(1).alias("gap")).alias("to"))
    moved = across.unionByName(along).select("volume_id", (F.col("z") + F.col("d.dz")).alias("z"), (F.col("y") + F.col("d.dy")).alias("y"), F.col("to.cx").alias("cx"), F.col("cz").alias("_cz"), F.col("cy").alias("_cy"), F.col("cx").alias("_cx"), F.col("node").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("to.gap").alias("gap"))
    touch = (F.col("x0") <= F.col("a1") + F.col("gap")) & (F.col("a0") <= F.col("x1") + F.col("gap"))
    other = (F.col("cz") != F.col("_cz")) | (F.col("cy") != F.col("_cy")) | (F.col("cx") != F.col("_cx"))
    return moved.join(faces.withColumnRenamed("node", "b"), ["volume_id", "z", "y", "cx"]).where(touch & other).select("a", "b").distinct()


def labelled(found: DataFrame, connectivity: int, size: int) -> DataFrame:
    """The rows of components in ``pieces`` with ``label``, the first voxel of the whole component."""
    names = components(ties(found, connectivity, size)).select(F.col("node.volume_id").alias("volume_id"), F.col("node.first").alias("first"), F.col("label.first").alias("_label"))
    return found.where("whole").drop("whole").join(names, ["volume_id", "first"], "left").withColumn("label", F.coalesce("_label", "first")).drop("_label")


def measured(rows: DataFrame) -> DataFrame:
    """(volume_id, label, size, dz, dy, dx, open) of each whole component."""
    extent = lambda a: (F.max(f"{a}1") - F.min(f"{a}0") + 1).alias(f"d{a}")
    return rows.groupBy("volume_id", "label").agg(F.sum("size").alias("size"), *[extent(a) for a in "zyx"], F.max("open").alias("open"))


def by_chunk(rows: DataFrame, which: Column, name: str) -> DataFrame:
    """(volume_id, cz, cy, cx, name): for each chunk the names of its components that belong to whole ones for which ``which`` holds."""
    good = measured(rows).where(which).select("volume_id", "label")
    return rows.join(good, ["volume_id", "label"], "left_semi").groupBy("volume_id", "cz", "cy", "cx").agg(F.collect_list("first").alias(name))


def chosen(r: dict, on: np.ndarray, connectivity: int, size: int, name: str) -> np.ndarray:
    """The voxels of a chunk's components that are named in the row's list ``name``."""
    if not r[name]:
        return np.zeros(on.shape, bool)
    found = Labelled(on, connectivity)
    return found.drawn(np.isin(found.first(r, size), np.array(r[name], np.int64)))
