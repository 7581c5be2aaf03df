"""Connected components: of an edge table, and of voxels by way of their runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.scratch import saved

#: Lines that touch a line, as (dz, dy), and how far runs may be apart along x. Each pair of lines is named once.
NEIGHBOURS = {4: ([(0, 1)], 0), 8: ([(0, 1)], 1), 6: ([(0, 1), (1, 0)], 0), 26: ([(0, 1), (1, -1), (1, 0), (1, 1)], 1)}

#: Edges that a task joins at once.
BLOCK_EDGES = 1 << 19


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that the edges (a, b) connect each with; every round hooks larger roots under smaller ones."""
    up = np.arange(n)
    while len(a):
        ra, rb = up[a], up[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(further := up[up], up):
            up = further
    return up


def _starred(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A task's edges (a, b), about ``most`` of them at a time, as stars around the least node of what they connect."""

    def stars(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        n = sum(x.num_rows for x in block)
        ends = pa.chunked_array([x.column(c) for c in (0, 1) for x in block]).combine_chunks()
        coded = (pa.concat_arrays(ends.chunks) if isinstance(ends, pa.ChunkedArray) else ends).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        code = rank[coded.indices.to_numpy()]
        root = joined(len(order), code[:n], code[n:])
        leaf = np.flatnonzero(root != np.arange(len(order)))
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(order[x])) for x in (root[leaf], leaf)], ["a", "b"])

    block, size = [], 0
    for batch in batches:
        block.append(batch)
        size += batch.num_rows
        if size >= most:
            yield stars(block)
            block, size = [], 0
    if size:
        yield stars(block)


def components(edges: DataFrame, on_round: Callable[[int], None] | None = None, block: int = BLOCK_EDGES) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); label is the smallest node of its component.

    Each round hooks every node under the first of its neighbours and itself, follows the hooks once more, and contracts:
    edges become edges between the hooks' ends, without loops and repeats. Before they are written, each task joins its own
    edges by union-find, a block at a time, and leaves stars: a graph that fits into one block is done after one round.
    Rounds take the nodes' own order, in which stars collapse, and a hash's, anew each time, in turns. By a hash's order
    a node is left only if another one is hooked under it, so the nodes fall to less than half in the mean, whatever the
    shape and the numbering: log n rounds, without a limit on them. The rounds' hooks are then followed back from the last,
    smallest, table to the first.

    The groupings combine on the map side, so a node with very many edges is no hot key; the joins have a shuffle on either
    side, which adaptive execution may split. Each round's tables are written. Nodes are integers, strings, or structs of
    them; loops don't count, so a node with nothing but loops isn't there. ``on_round`` is told each round's number of edges.
    """
    kind = edges.schema["a"].dataType
    packed = isinstance(kind, T.StructType)
    key = (lambda c: F.to_json(c)) if packed else F.col
    node = (lambda c: F.from_json(c, kind).alias(c)) if packed else F.col
    schema = T.StructType([T.StructField(c, T.StringType() if packed else kind) for c in "ab"])

    def written(pairs: DataFrame) -> DataFrame:
        return saved(pairs.where("a <> b").distinct().mapInArrow(lambda batches: _starred(batches, block), schema), "edges")

    rest, hooks = written(edges.select(key("a").alias("a"), key("b").alias("b"))), []
    while n_edges := rest.count():
        if on_round:
            on_round(n_edges)
        order = lambda c, seed=len(hooks): F.struct(F.xxhash64(F.lit(seed), c).alias("h") if seed % 2 else F.lit(0).alias("h"), F.col(c).alias("node"))
        ends = rest.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e")).select("e.*")
        first = ends.groupBy("node").agg(F.min(order("near")).alias("near")).select("node", F.least("near", order("node"))["node"].alias("up"))
        further = first.select(F.col("node").alias("up"), F.col("up").alias("further"))
        hook = saved(first.join(further, "up").select("node", F.col("further").alias("up")), "hooks")
        hooks.append(hook)
        moved = rest.join(hook.withColumnsRenamed({"node": "a", "up": "_a"}), "a").join(hook.withColumnsRenamed({"node": "b", "up": "_b"}), "b")
        rest = written(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))
    if not hooks:
        return rest.select(node("a").alias("node"), node("b").alias("label"))
    roots = hooks.pop()
    while hooks:
        above = roots.select(F.col("up").alias("root"), F.col("node").alias("up"))
        roots = saved(hooks.pop().join(above, "up", "left").select("node", F.coalesce("root", "up").alias("up")), "roots")
    roots = roots.select(node("node"), "up")
    least = roots.groupBy("up").agg(F.min("node").alias("label"))
    return saved(roots.join(least, "up").select("node", "label"), "labels")


def runs(voxels: DataFrame) -> DataFrame:
    """(volume_id, z, y, x0, x1): the maximal runs along x of the set voxels; voxels that repeat count once."""
    line = Window.partitionBy("volume_id", "z", "y").orderBy("x")
    numbered = voxels.select("volume_id", "z", "y", "x").distinct().withColumn("_run", F.col("x") - F.row_number().over(line))
    return numbered.groupBy("volume_id", "z", "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")


def merged(pieces: DataFrame) -> DataFrame:
    """(volume_id, z, y, x0, x1): the maximal runs of runs that may overlap, touch or repeat within a line."""
    line = Window.partitionBy("volume_id", "z", "y").orderBy("x0", "x1")
    before = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = pieces.select("volume_id", "z", "y", "x0", "x1", F.when(F.col("x0") <= before + 1, 0).otherwise(1).alias("_fresh"))
    numbered = fresh.withColumn("_run", F.sum("_fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("volume_id", "z", "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def labelled_runs(lines: DataFrame, connectivity: int) -> DataFrame:
    """(volume_id, z, y, x0, x1, label) of maximal runs; label is the (z, y, x) of the component's first voxel in that order.

    Runs, not voxels, are the nodes: a solid of n voxels has about n ** (2/3) of them. Connectivity 4 and 8 stay within a
    slice of equal z, 6 and 26 go across.
    """
    near, gap = NEIGHBOURS[connectivity]
    own = saved(lines.select("volume_id", "z", "y", "x0", "x1", F.struct("volume_id", "z", "y", "x0").alias("node")), "runs")
    step = F.explode(F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in near])).alias("d")
    moved = own.select("volume_id", "node", "x0", "x1", "z", "y", step).select("volume_id", F.col("node").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), (F.col("z") + F.col("d.dz")).alias("z"), (F.col("y") + F.col("d.dy")).alias("y"))
    edges = moved.join(own.select("volume_id", "z", "y", F.col("node").alias("b"), "x0", "x1"), ["volume_id", "z", "y"]).where((F.col("x0") <= F.col("a1") + gap) & (F.col("a0") <= F.col("x1") + gap))
    found = components(edges.select("a", "b"))
    named = own.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.struct(F.col("label.z").alias("z"), F.col("label.y").alias("y"), F.col("label.x0").alias("x"))
    return named.select("volume_id", "z", "y", "x0", "x1", first.alias("label"))


def spread(lines: DataFrame) -> DataFrame:
    """The voxels of runs: (volume_id, z, y, x) and the other columns of the run."""
    rest = [c for c in lines.columns if c not in ("volume_id", "z", "y", "x0", "x1")]
    return lines.select("volume_id", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *rest)


def labelled(voxels: DataFrame, connectivity: int) -> DataFrame:
    """(volume_id, z, y, x, label) of set voxels."""
    return spread(labelled_runs(runs(voxels), connectivity))


def sizes(lines: DataFrame) -> DataFrame:
    """(volume_id, label, size, dz, dy, dx) of labelled runs: voxels and extents of each component."""
    extent = lambda a: (F.max(a) - F.min(a) + 1).alias(f"d{a}")
    return lines.groupBy("volume_id", "label").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("size"), extent("z"), extent("y"), (F.max("x1") - F.min("x0") + 1).alias("dx"))
