"""Evaluation of whole volumes: stitching, two-point correlation, pore sizes, distances, morphology, reports."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.arrays import sigmoid
from voxloom.operators.components import labelled_runs, runs, sizes
from voxloom.scratch import saved


def stitched(tiles: DataFrame, ps: int) -> DataFrame:
    """(volume_id, z, y, x, xct, mask): voxels of non-overlapping tiles (z0, y0, x0, d, h, w and arrays of ps ** 3).

    Tiles that stick out of the multiple of ``ps`` that fits into the volume are left out. xct is clamped to [0, 1].
    """
    fit = F.lit(True)
    for a, n in (("z0", "d"), ("y0", "h"), ("x0", "w")):
        fit = fit & (F.col(a) + ps <= F.floor(F.col(n) / ps) * ps)
    voxel = tiles.where(fit).select("volume_id", "z0", "y0", "x0", F.posexplode(F.arrays_zip("xct_logits", "mask_logits")).alias("i", "t"))
    at = lambda origin, part: (F.col(origin) + part).cast("int")
    return voxel.select("volume_id", at("z0", F.floor(F.col("i") / (ps * ps))).alias("z"), at("y0", F.floor(F.col("i") / ps) % ps).alias("y"), at("x0", F.col("i") % ps).alias("x"), F.least(F.greatest("t.xct_logits", F.lit(0.0)), F.lit(1.0)).alias("xct"), sigmoid(F.col("t.mask_logits")).alias("mask"))


def _reach(n: int, r_max: float) -> int:
    return min(math.ceil(r_max), n // 2)


def shell_pairs(own: np.ndarray, wide: np.ndarray, shape: list[int], r_max: float, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each shell: pairs of a set voxel of a block and one of the volume, and how many lags of the volume it has.

    ``wide`` is the block with its surroundings, ``_reach`` voxels more on each end, periodic.
    """
    axes = range(own.ndim)
    product = np.conj(np.fft.rfftn(own.astype(np.float64), wide.shape, axes=axes)) * np.fft.rfftn(wide.astype(np.float64))
    found = np.rint(np.fft.irfftn(product, wide.shape, axes=axes))
    lags = []
    for a, n in enumerate(shape):
        reach = _reach(n, r_max)
        lag = np.arange(max(-reach, -((n - 1) // 2)), reach + 1)
        found = np.take(found, lag + reach, axis=a)
        lags.append(lag)
    distance = np.sqrt(sum(a**2 for a in np.meshgrid(*lags, indexing="ij", sparse=True)))
    shell = np.searchsorted(np.linspace(0, r_max, n_bins + 1), distance, side="right") - 1
    inside = shell < n_bins
    return np.bincount(shell[inside], found[inside], minlength=n_bins), np.bincount(shell[inside], minlength=n_bins)


def shared_blocks(voxels: DataFrame, shapes: DataFrame, r_max: float, side: int) -> DataFrame:
    """Blocks of set voxels for ``two_point_curves``: a row for each block (to_z, to_y, to_x) that sees this one, with its
    bits, and the places (at_z, at_y, at_x) where it does along each axis."""
    cell = shapes.select("volume_id", *[F.col(c).cast("int").alias(c) for c in "dhw"]).join(voxels.select("volume_id", "z", "y", "x"), "volume_id")
    keys = [F.floor(F.col(a) / side).cast("int").alias(f"b{a}") for a in "zyx"]

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        first = t.slice(0, 1).to_pylist()[0]
        bits = np.zeros([min(side, first[n] - first[f"b{a}"] * side) for a, n in zip("zyx", "dhw", strict=True)], bool)
        bits[tuple(t.column(a).to_numpy() % side for a in "zyx")] = True
        return t.slice(0, 1).select(["volume_id", "d", "h", "w", "bz", "by", "bx"]).append_column("bits", pa.array([np.packbits(bits).tobytes()]))

    own = cell.select("*", *keys).groupBy("volume_id", "bz", "by", "bx").applyInArrow(packed, "volume_id string, d int, h int, w int, bz int, by int, bx int, bits binary")
    sent = own
    for a, n in zip("zyx", "dhw", strict=True):
        # Every block that has a set voxel of this one within reach, and the places where this one stands as seen from there.
        reach = f"least({math.ceil(r_max)}, {n} div 2)"
        places = f"transform(sequence(-1, 1), m -> cast(m * {n} + b{a} * {side} - t * {side} as int))"
        seen = f"filter({places}, at -> at < least({side}, {n} - t * {side}) + {reach} and at + least({side}, {n} - b{a} * {side}) > -{reach})"
        sent = sent.withColumn(f"s{a}", F.explode(F.expr(f"filter(transform(sequence(0, cast(({n} - 1) div {side} as int)), t -> named_struct('to', t, 'at', {seen})), s -> size(s.at) > 0)")))
    return sent.select("volume_id", "d", "h", "w", "bz", "by", "bx", "bits", *[F.col(f"s{a}.{c}").alias(f"{c}_{a}") for a in "zyx" for c in ("to", "at")])


def two_point_curves(voxels: DataFrame, shapes: DataFrame, r_max: float = 50, n_bins: int = 50, side: int = 64) -> DataFrame:
    """(volume_id, s2): the chance that two points of a volume at distance r (in ``n_bins`` shells up to r_max, periodic)
    are both set, for set voxels and shapes (volume_id, d, h, w); zeros for a volume without set voxels.

    Set voxels are packed into blocks of up to ``side`` ** 3 bits, as many as the volume has there. A block goes once to each
    block within reach of it, with all the places where that one sees it; each block counts its pairs with its surroundings,
    and the counts add up to the volume's: exact, and no task holds a volume.
    """
    sent = shared_blocks(voxels, shapes, r_max, side)

    def counted(t: pa.Table) -> pa.Table:
        first = t.slice(0, 1).to_pylist()[0]
        shape = [first[c] for c in "dhw"]
        reach = [_reach(n, r_max) for n in shape]
        extent = [min(side, n - first[f"to_{a}"] * side) for a, n in zip("zyx", shape, strict=True)]
        wide, block = np.zeros([e + 2 * r for e, r in zip(extent, reach, strict=True)], bool), np.zeros(extent, bool)
        for r in t.to_pylist():
            size = [min(side, n - r[f"b{a}"] * side) for a, n in zip("zyx", shape, strict=True)]
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=math.prod(size)).astype(bool).reshape(size)
            for at in itertools.product(*[[p + q for p in r[f"at_{a}"]] for a, q in zip("zyx", reach, strict=True)]):
                into = tuple(slice(max(0, p), min(m, p + e)) for p, m, e in zip(at, wide.shape, size, strict=True))
                wide[into] |= bits[tuple(slice(i.start - p, i.stop - p) for i, p in zip(into, at, strict=True))]
                if list(at) == reach:
                    block = bits
        if not block.any():
            return t.schema.empty_table().select(["volume_id"]).append_column("bin", pa.array([], pa.int32())).append_column("pairs", pa.array([], pa.int64())).append_column("lags", pa.array([], pa.int64()))
        pairs, lags = shell_pairs(block, wide, shape, r_max, n_bins)
        return pa.table({"volume_id": pa.array([first["volume_id"]] * n_bins), "bin": pa.array(np.arange(n_bins, dtype=np.int32)), "pairs": pa.array(pairs.astype(np.int64)), "lags": pa.array(lags.astype(np.int64))})

    around = sent.groupBy("volume_id", "to_z", "to_y", "to_x").applyInArrow(counted, "volume_id string, bin int, pairs long, lags long")
    bins = around.groupBy("volume_id", "bin").agg(F.sum("pairs").alias("pairs"), F.max("lags").alias("lags")).join(shapes.select("volume_id", (F.col("d").cast("double") * F.col("h") * F.col("w")).alias("n")), "volume_id")
    curve = bins.groupBy("volume_id").agg(F.sort_array(F.collect_list(F.struct("bin", (F.col("pairs") / F.col("n") / F.greatest("lags", F.lit(1))).alias("s2")))).alias("s")).select("volume_id", F.col("s.s2").alias("s2"))
    return shapes.select("volume_id").join(curve, "volume_id", "left").select("volume_id", F.coalesce("s2", F.array_repeat(F.lit(0.0), n_bins)).alias("s2"))


def curve_distance(a: DataFrame, b: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(volume_id, distance): the 1-Wasserstein distance of two curves, each scaled to a sum of one."""
    unit = lambda c: F.transform(c, lambda v: F.greatest(v, F.lit(0.0)) / (F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.greatest(x, F.lit(0.0))) + eps))
    both = a.select("volume_id", unit("s2").alias("p")).join(b.select("volume_id", unit("s2").alias("q")), "volume_id")
    cells = both.select("volume_id", F.zip_with("p", "q", lambda x, y: x - y).alias("diff"), F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x).alias("sp"), F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x).alias("sq"), "p", "q")
    # The distance scales each side to one exactly, so rescale by the sums (an empty curve has none).
    gap = F.zip_with("p", "q", lambda x, y: x / F.when(F.col("sp") > 0, F.col("sp")).otherwise(1.0) - y / F.when(F.col("sq") > 0, F.col("sq")).otherwise(1.0))
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("out"))
    step = lambda acc, x: F.struct((acc["cum"] + x).alias("cum"), (acc["out"] + F.abs(acc["cum"] + x)).alias("out"))
    inner = F.slice(gap, F.lit(1), F.greatest(F.size("p") - 1, F.lit(0)))
    return cells.select("volume_id", F.aggregate(inner, start, step, lambda acc: acc["out"]).alias("distance"))


def sample_distance(a: DataFrame, b: DataFrame, value: str = "size") -> DataFrame:
    """(volume_id, distance): the 1-Wasserstein distance of two samples per volume, by their distribution functions."""
    side = lambda df, n: df.select("volume_id", F.col(value).cast("double").alias("v"), F.lit(n).alias("side"))
    counts = side(a, 0).unionByName(side(b, 1)).groupBy("volume_id", "v").agg(*[F.sum((F.col("side") == n).cast("long")).alias(f"n{n}") for n in (0, 1)])
    line, whole = Window.partitionBy("volume_id").orderBy("v"), Window.partitionBy("volume_id")
    up = line.rowsBetween(Window.unboundedPreceding, 0)
    share = lambda n: F.sum(f"n{n}").over(up) / F.sum(f"n{n}").over(whole)
    gaps = counts.where("v is not null").select("volume_id", F.abs(share(0) - share(1)).alias("gap"), (F.lead("v").over(line) - F.col("v")).alias("dx"))
    return gaps.groupBy("volume_id").agg(F.coalesce(F.sum(F.col("gap") * F.col("dx")), F.lit(0.0)).alias("distance"))


def pore_sizes(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume_id, size) of the 6-connected pores; 0.0 for a volume without any."""
    found = sizes(labelled_runs(runs(voxels), 6)).select("volume_id", F.col("size").cast("double").alias("size"))
    return volumes.select("volume_id").join(found, "volume_id", "left").select("volume_id", F.coalesce("size", F.lit(0.0)).alias("size"))


def face_centres(voxels: np.ndarray) -> np.ndarray:
    """The centres of the faces of voxels; they span space even for a single voxel."""
    return np.unique(np.concatenate([voxels + 0.5 * s * np.eye(3, dtype=int)[a] for a in range(3) for s in (1, -1)]), axis=0)


def hull_voxels(points: np.ndarray) -> int:
    """How many voxel centres lie in the convex hull of the voxels' face centres (a border counts as inside)."""
    low = points.min(axis=0)
    planes, _ = hull(face_centres(points - low))
    return voxels_within(planes, points.max(axis=0) - low + 1, range(points[:, 0].max() - low[0] + 1))


def voxels_within(planes: np.ndarray, shape: np.ndarray, slices: Iterable[int]) -> int:
    """How many voxel centres of some slices along z of a box from the origin lie within outward planes (n, offset)."""
    inside, y = 0, np.arange(shape[1])[:, None]
    nz, ny, nx, off = planes.T
    flat = np.abs(nx) < 1e-12
    for z in slices:
        # On each line along x the planes leave an interval.
        left = off + 1e-8 - nz * z - ny * y
        edge = left / np.where(flat, 1, nx)
        low = np.where(~flat & (nx < 0), edge, 0).max(axis=1)
        high = np.where(~flat & (nx > 0), edge, shape[2] - 1).min(axis=1)
        n = np.floor(high) - np.ceil(low) + 1
        inside += int(np.where((left[:, flat] >= 0).all(axis=1), np.maximum(n, 0), 0).sum())
    return inside


def hull(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outward planes (n, offset) and corners of the hull of points that span space, added point by point."""
    a, b = p[p[:, 0].argmin()], p[p[:, 0].argmax()]
    c = p[np.linalg.norm(np.cross(p - a, b - a), axis=1).argmax()]
    d = p[np.abs((p - a) @ np.cross(b - a, c - a)).argmax()]
    middle = (a + b + c + d) / 4
    corners = np.array([a, b, c, d])

    def planes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v, w = (corners[f[:, k]] for k in range(3))
        n = np.cross(v - u, w - u)
        n = n / np.linalg.norm(n, axis=1)[:, None]
        off = (n * u).sum(axis=1)
        turn = n @ middle >= off
        n[turn], off[turn], f[turn] = -n[turn], -off[turn], f[turn][:, [0, 2, 1]]
        return f, n, off

    faces, normals, offs = planes(np.array([(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]))
    rest = p[np.argsort(-np.linalg.norm(p - middle, axis=1))]
    while len(rest := rest[(rest @ normals.T > offs + 1e-9).any(axis=1)]):  # what is inside now stays inside
        x, rest = rest[0], rest[1:]
        seen = normals @ x > offs + 1e-9
        edges = np.concatenate([faces[seen][:, e] for e in ([0, 1], [1, 2], [2, 0])])
        n = len(corners)
        rim = edges[~np.isin(edges[:, 0] * n + edges[:, 1], edges[:, 1] * n + edges[:, 0])]
        u, v = corners[rim[:, 0]], corners[rim[:, 1]]
        rim = rim[np.linalg.norm(np.cross(v - u, x - u), axis=1) > 1e-9]
        corners = np.concatenate([corners, x[None]])
        fresh = planes(np.column_stack([rim, np.full(len(rim), n)]))
        faces, normals, offs = (np.concatenate([old[~seen], new]) for old, new in zip((faces, normals, offs), fresh, strict=True))
    return np.column_stack([normals, offs]), corners[np.unique(faces)]


#: Shapes of parts of pores whose hulls a worker keeps: small pores are alike.
KEPT_HULLS = 4096


@lru_cache(KEPT_HULLS)
def _corners(lines: bytes) -> np.ndarray:
    """The corners of the hull of lines (z, y, x0, x1), their least z, y and x0 at 0."""
    t = np.frombuffer(lines, np.int64).reshape(-1, 4)
    return hull(face_centres(np.unique(np.concatenate([t[:, [0, 1, k]] for k in (2, 3)]), axis=0)))[1]


@lru_cache(KEPT_HULLS)
def _planes(points: bytes) -> np.ndarray:
    """The hull's planes of points (z, y, x)."""
    return hull(np.frombuffer(points, np.float64).reshape(-1, 3))[0]


def _per_row(rows: DataFrame, name: str, kind: str, made: Callable[..., object], *of: str) -> DataFrame:
    """Adds what ``made`` gives for the columns ``of`` of a row, and leaves those out; rows go to Python in batches."""
    rest = [c for c in rows.columns if c not in of]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [made(*r) for r in zip(*(part.column(c).to_pylist() for c in of), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(out, pa.int64() if kind == "long" else pa.list_(pa.float64()))], [*rest, name])

    return rows.mapInArrow(added, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest), f"{name} {kind}"]))


def hull_sizes(lines: DataFrame, side: int = 64) -> DataFrame:
    """(volume_id, label, hull): the voxels in the convex hull of each label, of its lines' ends (z, y, x0, x1).

    Hulls merge: the hull of the corners of the parts' hulls is that of the whole. So lines go to columns of ``side`` x
    ``side`` of them, each column sends its corners, and the label's planes go to slabs of ``side`` slices, which count
    voxels. No group holds more than a column's lines, the corners of all columns, or a label's planes.
    """
    keys = ["volume_id", "label"]
    # Few bytes, much work: each step is dealt out over all partitions, which adaptive execution would put into one by their size.
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.select(*keys, "z", "y", "x0", "x1", F.floor(F.col("z") / side).alias("bz"), F.floor(F.col("y") / side).alias("by")).repartition(n, *keys, "bz", "by")
    column = placed.groupBy(*keys, "bz", "by").agg(F.collect_list(F.array(*[F.col(c).cast("long") for c in ("z", "y", "x0", "x1")])).alias("lines")).drop("bz", "by")

    def corners(held: list[list[int]]) -> list[float]:
        t = np.array(sorted(held), np.int64)
        low = t.min(axis=0)[[0, 1, 2]]
        return (_corners((t - low[[0, 1, 2, 2]]).tobytes()) + low).ravel().tolist()

    found = _per_row(column, "corners", "array<double>", corners, "lines").repartition(n, *keys).groupBy(*keys).agg(F.flatten(F.collect_list("corners")).alias("points"))

    def whole(points: list[float]) -> list[float]:
        """The planes (n, offset) from the least corner, and the extent."""
        p = np.array(points).reshape(-1, 3)
        low = np.ceil(p.min(axis=0))
        return [*(np.floor(p.max(axis=0)) - low + 1), *_planes(np.unique(p - low, axis=0).tobytes()).ravel()]

    planes = _per_row(found, "planes", "array<double>", whole, "points")
    slabs = planes.withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("planes")[0] - 1) / side))))

    def count(flat: list[float], slab: int) -> int:
        shape = np.array(flat[:3]).astype(int)
        return voxels_within(np.array(flat[3:]).reshape(-1, 4), shape, range(slab * side, min(shape[0], (slab + 1) * side)))

    return _per_row(slabs, "n", "long", count, "planes", "slab").groupBy(*keys).agg(F.sum("n").alias("hull"))


def pore_shapes(voxels: DataFrame, most: int = 500) -> DataFrame:
    """(volume_id, label, size, sphericity, eq_diameter) of each volume's ``most`` largest 26-connected pores.

    Sphericity takes the hull's voxels for the surface, as an approximation. The limit is part of the measure.
    """
    labels = saved(labelled_runs(runs(voxels), 26), "pores")
    order = Window.partitionBy("volume_id").orderBy(F.col("size").desc(), "label")
    large = saved(sizes(labels).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("volume_id", "label", "size"), "large")
    # The ends of a pore's lines have the hull of all its voxels; a line's runs meet on the map side.
    ends = labels.groupBy("volume_id", "label", "z", "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).join(large.select("volume_id", "label"), ["volume_id", "label"], "left_semi")
    v = F.col("size")
    sphericity = math.pi ** (1 / 3) * F.pow(6 * v, F.lit(2 / 3)) / F.col("hull")
    return large.join(hull_sizes(ends), ["volume_id", "label"]).select("volume_id", "label", "size", sphericity.alias("sphericity"), F.pow(6 * v / math.pi, F.lit(1 / 3)).alias("eq_diameter"))


def morphology(voxels: DataFrame, volumes: DataFrame, most: int = 500) -> DataFrame:
    """(volume_id, sphericity_mean, sphericity_std, eq_diameter_mean, eq_diameter_std, n_pores); deviations are the
    population's. A volume without pores has NaN means, and null for the rest."""
    stats = pore_shapes(voxels, most).groupBy("volume_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("sphericity", "eq_diameter") for n, f in (("mean", F.avg), ("std", F.stddev_pop))], F.count(F.lit(1)).alias("n_pores"))
    nan = F.lit(float("nan"))
    return volumes.select("volume_id").join(stats, "volume_id", "left").withColumns({c: F.coalesce(F.col(c), nan) for c in ("sphericity_mean", "eq_diameter_mean")})


def volume_report(voxels: DataFrame) -> DataFrame:
    """(volume_id, porosity_gt, porosity_pred, porosity_error, xct_mae) of voxels with gt, pred, xct_gt and xct_pred."""
    out = voxels.groupBy("volume_id").agg(F.avg((F.col("gt") >= 0.5).cast("double")).alias("porosity_gt"), F.avg((F.col("pred") >= 0.5).cast("double")).alias("porosity_pred"), F.avg(F.abs(F.col("xct_gt") - F.col("xct_pred"))).alias("xct_mae"))
    return out.withColumn("porosity_error", F.abs(F.col("porosity_pred") - F.col("porosity_gt")))


def volume_record(voxels: DataFrame, shapes: DataFrame, r_max: int = 50, most: int = 500) -> DataFrame:
    """One record per volume of ``shapes`` (volume_id, d, h, w), of voxels with z, y, x and the columns of ``volume_report``:
    what that gives, s2_wasserstein, s2_gt, s2_pred (curves of ``r_max`` shells), s2_r_vals (their middles),
    psd_wasserstein, and morphology_gt and morphology_pred.

    A mask is what reaches 0.5. A curve without any pore is zeros, a volume without pores has the one size 0.
    """
    base = saved(voxels, "voxels")
    by_side = {}
    for side in ("gt", "pred"):
        on = base.where(F.col(side) >= 0.5).select("volume_id", "z", "y", "x")
        form = morphology(on, shapes, most)
        by_side[side] = (saved(two_point_curves(on, shapes, r_max, r_max), "curves"), pore_sizes(on, shapes), form.select("volume_id", F.struct(*[c for c in form.columns if c != "volume_id"]).alias(f"morphology_{side}")))
    (s2, psd, form), (s2_pred, psd_pred, form_pred) = by_side["gt"], by_side["pred"]
    middles = F.array(*[F.lit(k + 0.5) for k in range(r_max)]).alias("s2_r_vals")
    out = volume_report(base).join(curve_distance(s2, s2_pred).withColumnRenamed("distance", "s2_wasserstein"), "volume_id")
    out = out.join(s2.withColumnRenamed("s2", "s2_gt"), "volume_id").join(s2_pred.withColumnRenamed("s2", "s2_pred"), "volume_id").select("*", middles)
    out = out.join(sample_distance(psd, psd_pred).withColumnRenamed("distance", "psd_wasserstein"), "volume_id")
    return out.join(form, "volume_id").join(form_pred, "volume_id")


def across_volumes(reports: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std): over volumes, without NaN; the population's deviation."""
    long = reports.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select("m.*")
    return long.where(~F.isnan("v")).groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
