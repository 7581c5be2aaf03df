"""Segmentation, patch sums and volume measures against plain NumPy loops."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import components, ordering, patch_index, segmentation, splits, statistics, volumes
from voxloom.sources import chunks


def rows_of(volume, name="a"):
    return [(name, *map(int, at), int(volume[at])) for at in np.ndindex(volume.shape)]


def frame(spark, volume, name="a"):
    return spark.createDataFrame(rows_of(volume, name), "volume_id string, z int, y int, x int, v int")


def pieces(spark, volume, name="a", size=5):
    """Chunks of a volume."""
    rows = []
    for at in np.ndindex(*[-(-n // size) for n in volume.shape]):
        cube = volume[tuple(slice(k * size, (k + 1) * size) for k in at)]
        rows.append((name, *at, *cube.shape, bytearray(cube.astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, "volume_id string, cz int, cy int, cx int, d int, h int, w int, xct binary")


def flags(found, *columns, size=5):
    """The set of places for each column of bytes."""
    rows = chunks.voxels(found, size, {c: c for c in columns}).collect()
    return [{(r.z, r.y, r.x) for r in rows if r[c]} for c in columns]


def flood(mask, offsets):
    """Labels by flood fill, in raster order from 1."""
    label, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if label[start]:
            continue
        n += 1
        label[start], todo = n, [start]
        while todo:
            at = todo.pop()
            for d in offsets:
                to = tuple(np.add(at, d))
                if all(0 <= t < s for t, s in zip(to, mask.shape, strict=True)) and mask[to] and not label[to]:
                    label[to] = n
                    todo.append(to)
    return label


ALL = [d for d in itertools.product((-1, 0, 1), repeat=3) if any(d)]
SIX = [d for d in ALL if sum(map(abs, d)) == 1]


def plain_sauvola(image, window, k):
    w = window + (window % 2 == 0)
    wide = np.pad(image.astype(float), w // 2, mode="reflect")
    out = np.zeros(image.shape, bool)
    for i, j in np.ndindex(image.shape):
        part = wide[i : i + w, j : j + w]
        out[i, j] = image[i, j] - part.mean() * (1 + k * (part.std() / 128 - 1)) > 1e-9
    return out


def plain_otsu(values):
    hist = np.bincount(values.ravel(), minlength=256).astype(float)
    p = hist / hist.sum()
    w, mu = np.cumsum(p), np.cumsum(p * np.arange(256))
    ok = (w > 0) & (w < 1 - 1e-12)
    s = np.zeros(256)
    s[ok] = (mu[-1] * w[ok] - mu[ok]) ** 2 / (w[ok] * (1 - w[ok]))
    return int(np.flatnonzero(s >= s.max() - 1e-9)[0])


def plain_material(volume):
    on = volume > plain_otsu(volume)
    flat = flood(on.any(axis=0)[None], [d for d in ALL if d[0] == 0])[0]
    out = np.zeros(volume.shape, bool)
    ys, xs = np.nonzero(flat == 1)
    box = (slice(None), slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1))
    inner = on[box]
    label = flood(~inner, SIX)
    faces = set()
    for a in range(3):
        faces |= set(np.unique(np.take(label, [0, -1], axis=a)))
    out[box] = inner | ((label > 0) & ~np.isin(label, list(faces)))
    return out


def plain_clean(mask, least):
    label = flood(mask, ALL)
    out = np.zeros(mask.shape, bool)
    for n in range(1, label.max() + 1):
        at = np.argwhere(label == n)
        if len(at) >= least and (np.ptp(at, axis=0) >= 1).all():
            out[label == n] = True
    return out


@pytest.fixture(scope="module")
def volume():
    rng = np.random.default_rng(5)
    v = np.zeros((12, 13, 14), int)
    v[2:11, 3:12, 2:12] = rng.integers(90, 255, (9, 9, 10))
    v[5:7, 5:8, 5:8] = 3
    return v


def voxels(df):
    return {(r.z, r.y, r.x) for r in df.collect()}


def true(mask):
    return {tuple(map(int, at)) for at in np.argwhere(mask)}


@pytest.mark.parametrize(("connectivity", "offsets"), [(6, SIX), (26, ALL), (4, [d for d in SIX if d[0] == 0]), (8, [d for d in ALL if d[0] == 0])])
def test_components(spark, connectivity, offsets):
    mask = np.random.default_rng(3).random((6, 7, 8)) < 0.3
    label = flood(mask, offsets)
    first = {n: tuple(map(int, np.argwhere(label == n)[0])) for n in range(1, label.max() + 1)}
    got = components.labelled(frame(spark, mask.astype(int)).where("v = 1"), connectivity).collect()
    assert {((r.z, r.y, r.x), tuple(r.label)) for r in got} == {(at, first[label[at]]) for at in true(mask)}


def test_material_mask(spark, volume):
    assert flags(segmentation.material_mask(pieces(spark, volume), 5), "sample") == [true(plain_material(volume))]


@pytest.mark.parametrize(("window", "size"), [(3, 5), (8, 3), (30, 4), (4, 20)])
def test_local_threshold_over_chunks(spark, volume, window, size):
    want = np.stack([plain_sauvola(volume[:, y, :], window, 0.125) for y in range(volume.shape[1])], axis=1)
    assert flags(segmentation.local_threshold(pieces(spark, volume, size=size), window, 0.125, size), "binary", size=size) == [true(want)]


def test_histogram_of_chunks(spark, volume):
    got = {r.v: r.n for r in segmentation.histogram(pieces(spark, volume)).collect()}
    assert got == dict(Counter(volume.ravel().tolist()))


def test_runs_that_touch_or_overlap_are_merged(spark):
    rows = [("a", 0, 0, 0, 4), ("a", 0, 0, 2, 3), ("a", 0, 0, 5, 6), ("a", 0, 0, 8, 9), ("a", 0, 0, 8, 9), ("a", 0, 1, 1, 1)]
    got = components.merged(spark.createDataFrame(rows, "volume_id string, z int, y int, x0 int, x1 int")).collect()
    assert {(r.y, r.x0, r.x1) for r in got} == {(0, 0, 6), (0, 8, 9), (1, 1, 1)} and len(got) == 3


def test_segmented_pores(spark, volume):
    got = segmentation.segmented_pores(pieces(spark, volume), frontwall=2, backwall=9, window=4, k=0.125, least=2, size=5)
    at = np.argwhere(volume > 0)
    lo, hi = np.maximum(at.min(axis=0) - 4, 0), np.minimum(at.max(axis=0) + 4, np.array(volume.shape) - 1) + 1
    box = tuple(slice(a, b) for a, b in zip(lo, hi, strict=True))
    crop = volume[box]
    local = np.stack([plain_sauvola(crop[:, y, :], 4, 0.125) for y in range(crop.shape[1])], axis=1)
    local[:2], local[9:] = True, True
    binary, sample = np.zeros(volume.shape, bool), np.zeros(volume.shape, bool)
    binary[box], sample[box] = local, plain_material(crop)
    pores = plain_clean(~binary & sample, 2)
    assert flags(got, "binary", "sample", "pore") == [true(binary), true(sample), true(pores)] and pores.any()
    assert chunks.voxels(got, 5, {"pore": "pore"}).count() == volume.size


def test_empty_volume_has_no_pores_and_is_all_sample(spark):
    got = segmentation.masks(pieces(spark, np.zeros((3, 6, 3), int)), size=5)
    assert flags(got, "mask", "sample") == [set(), true(np.ones((3, 6, 3)))]


def test_statistics(spark, volume):
    both = frame(spark, volume).unionByName(frame(spark, np.zeros((2, 2, 2), int), "dark"))
    got = {r.volume_id: r for r in statistics.streamed_stats(both).collect()}
    t = plain_otsu(volume)
    above = volume[volume > t]
    assert got["a"].otsu_threshold == t and got["a"].n_foreground == len(above)
    assert np.isclose(got["a"]["mean"], above.mean()) and np.isclose(got["a"]["std"], above.std())
    assert (got["dark"]["mean"], got["dark"]["std"], got["dark"].n_foreground) == (128.0, 50.0, 0)


@pytest.mark.parametrize(("shape", "ps", "stride", "n"), [((12, 12, 12), 6, 6, 8), ((12, 12, 12), 6, 3, 27), ((10, 20, 30), 4, 2, 4 * 9 * 14), ((6, 6, 6), 6, 6, 1), ((5, 6, 6), 6, 6, 0), ((7, 7, 7), 6, 6, 1), ((9, 8, 11), 5, 3, 12)])
def test_patch_sums(spark, shape, ps, stride, n):
    mask = np.random.default_rng(1).random(shape) < 0.3
    shapes = spark.createDataFrame([("a", *shape)], "volume_id string, d int, h int, w int")
    got = patch_index.patch_sums(frame(spark, mask.astype(int)).where("v = 1"), shapes, ps, stride).collect()
    assert len(got) == n
    assert all(r.total == mask[r.z0 : r.z0 + ps, r.y0 : r.y0 + ps, r.x0 : r.x0 + ps].sum() for r in got)


def test_box_sums(spark):
    """All ones, all zeros, and a single voxel."""
    one = np.zeros((8, 8, 8), int)
    one[5, 7, 3] = 1
    boxes = spark.createDataFrame([("a", 0, 0, 0), ("a", 4, 4, 0), ("b", 4, 4, 4), ("c", 2, 2, 2)], "volume_id string, z0 int, y0 int, x0 int")
    dense = frame(spark, one).unionByName(frame(spark, one * 0 + 1, "b")).unionByName(frame(spark, one * 0, "c")).withColumnRenamed("v", "mask")
    got = {(r.volume_id, r.z0): r.total for r in patch_index.box_sums(patch_index.integral(dense), boxes, 4).collect()}
    assert got == {("a", 0): 0, ("a", 4): 1, ("b", 4): 64, ("c", 2): 0}


@pytest.mark.parametrize(("shape", "side", "r_max"), [((5, 6, 7), 3, 6), ((9, 4, 10), 4, 3), ((7, 7, 7), 16, 2.5), ((1, 8, 5), 2, 20)])
def test_two_point_curves(spark, shape, side, r_max):
    mask = np.random.default_rng(2).random(shape) < 0.4
    sums, counts = np.zeros(6), np.zeros(6)
    for lag in np.ndindex(mask.shape):
        r = np.sqrt(sum(min(d, n - d) ** 2 for d, n in zip(lag, mask.shape, strict=True)))
        if r < r_max:
            at = np.searchsorted(np.linspace(0, r_max, 7), r, side="right") - 1
            sums[at] += (mask & np.roll(mask, lag, (0, 1, 2))).mean()
            counts[at] += 1
    shapes = spark.createDataFrame([("a", *shape), ("empty", 2, 2, 2)], "volume_id string, d int, h int, w int")
    got = {r.volume_id: r.s2 for r in volumes.two_point_curves(frame(spark, mask.astype(int)).where("v = 1"), shapes, r_max, 6, side).collect()}
    assert np.allclose(got["a"], sums / np.maximum(counts, 1)) and got["empty"] == [0.0] * 6


def test_hull():
    rng = np.random.default_rng(4)
    solid = np.argwhere(np.ones((3, 4, 5)))
    assert volumes.hull_voxels(solid) == 60
    assert volumes.hull_voxels(np.array([[4, 4, 4]])) == 1
    assert volumes.hull_voxels(np.array([[0, 0, 0], [0, 0, 4]])) == 5
    ball = np.argwhere(sum((g - 6) ** 2 for g in np.meshgrid(*[np.arange(13)] * 3, indexing="ij")) <= 30)
    assert len(ball) <= volumes.hull_voxels(ball) <= 1.2 * len(ball)
    ends = np.array([p for p in ball.tolist() if [*p[:2], p[2] + 1] not in ball.tolist() or [*p[:2], p[2] - 1] not in ball.tolist()])
    assert len(ends) < len(ball) and volumes.hull_voxels(ends) == volumes.hull_voxels(ball)
    shell = ball[rng.permutation(len(ball))[: len(ball) // 2]]
    assert len(shell) < volumes.hull_voxels(shell) <= volumes.hull_voxels(ball)


def test_splits(spark):
    ids = [f"vol_{i:03d}" for i in range(20)]
    v = spark.createDataFrame([(i,) for i in ids], "volume_id string")
    a, b, c = ({r.volume_id: r.split for r in splits.counted_split(v, 14, 3, 3, s).collect()} for s in (42, 42, 99))
    assert a == b != c and Counter(a.values()) == {"train": 14, "val": 3, "test": 3}
    assert Counter(splits.dealt_like_numpy(ids, 8, 2, 2, 7).values()) == {"train": 8, "val": 2, "test": 2}
    with pytest.raises(ValueError, match="24 volumes can't be dealt from 20"):
        splits.counted_split(v, 18, 3, 3, 1)
    with pytest.raises(ValueError, match="from 5"):
        splits.dealt_like_numpy(ids[:5], 4, 3, 3, 1)


def test_stratified_split(spark):
    edges, targets = (0.0, 0.005, 0.01, 0.02, 0.06, 0.12), {f"b{i}": {"n_train": 1, "n_val": 1, "n_test": 1} for i in range(5)}
    values = [0.001, 0.002, 0.003, 0.006, 0.007, 0.008, 0.011, 0.012, 0.015, 0.03, 0.04, 0.05, 0.07, 0.08, 0.11]
    rows = [(f"v{i}", x) for i, x in enumerate(values)] + [("out", 0.013), ("v0", 0.004)]
    df = spark.createDataFrame(rows, "volume_id string, phi_median double")
    got = splits.stratified_split(df, edges, targets, 42, ["out"]).collect()
    assert Counter((r.bin, r.split) for r in got if r.split != "excluded") == {(f"b{i}", s): 1 for i in range(5) for s in ("train", "val", "test")}
    assert [r.volume_id for r in got if r.split == "excluded"] == ["out"]
    assert {r.phi_median for r in got if r.volume_id == "v0"} == {0.001}  # of rows that repeat, the first in the given order
    assert {r.phi_median for r in splits.stratified_split(df, edges, targets, 42, ["out"], [-F.col("phi_median")]).collect() if r.volume_id == "v0"} == {0.004}
    assert {tuple(r) for r in splits.split_summary(splits.stratified_split(df, edges, targets, 42, ["out"]), targets).collect()} == {(f"b{i}", 1, 1, 1, 3, 3) for i in range(5)}
    with pytest.warns(UserWarning, match="bin b2 has 4 volumes"):
        splits.stratified_split(df, edges, targets, 42)
    with pytest.raises(ValueError, match="no bin holds"):
        splits.stratified_split(spark.createDataFrame([("x", 0.12)], "volume_id string, phi_median double"), edges, targets, 1)
    with pytest.raises(ValueError, match="want"):
        splits.stratified_split(df.where("phi_median < 0.06"), edges, targets, 1)
    with pytest.raises(KeyError):
        splits.porosity_medians(df)
    assert splits.split_column(" V2 ") == "split_v2"
    with pytest.raises(ValueError):
        splits.split_column("v3")


def test_hulls_merge(spark):
    """A pore's hull from columns of lines is that of all its voxels."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for k in range(6):
        centre, spread = rng.integers(0, 40, 3), rng.integers(1, 14, 3)
        points = np.unique(np.rint(centre + rng.normal(size=(150, 3)) * spread).astype(int), axis=0)
        points = points - np.minimum(points.min(axis=0), 0)
        rows += [("v", k, *map(int, p), int(p[2])) for p in points]
        want[k] = volumes.hull_voxels(points)
    rows += [("v", 9, 5, 5, 3, 3), ("w", 9, 0, 0, 0, 20)]
    lines = spark.createDataFrame(rows, "volume_id string, label int, z int, y int, x0 int, x1 int")
    got = {(r.volume_id, r.label): r.hull for r in volumes.hull_sizes(lines, 8).collect()}
    assert got == {("v", k): n for k, n in want.items()} | {("v", 9): 1, ("w", 9): 21}


@pytest.mark.parametrize("n", [0, 1, 2, 777])
def test_percentiles_and_batches(spark, n):
    rng = np.random.default_rng(n)
    values = [None if k % 50 == 3 else float("nan") if k % 97 == 5 else float(rng.integers(0, 40)) / 8 for k in range(n)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").repartition(5)
    shares = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1]
    want = df.agg(*[F.percentile("v", F.lit(s)) for s in shares]).first()
    assert [str(x) for x in ordering.percentiles(df, "v", shares)] == [str(x) for x in want]
    with pytest.raises(ValueError, match="shares"):
        ordering.percentiles(df, "v", [1.5])
    plain = {r.k: r.batch_id for r in ordering.batched(df, 50, ["k"]).collect()}
    assert plain == {k: k // 50 for k in range(n)}
    a, b, c = ({r.k: r.batch_id for r in ordering.batched(df, 50, ["k"], seed, drop_last=True).collect()} for seed in (1, 1, 2))
    assert a == b and sorted(Counter(a.values()).items()) == [(k, 50) for k in range(n // 50)] and (a != c or n < 50)
