"""Latent space analysis: sampling, scaling, principal components, neighbours and silhouettes.

Comparisons of all rows with all others go block by block, a task for each pair of blocks; searches for nearest neighbours
leave out the cells of rows that can't hold one. What goes through the driver is a matrix of dimension x dimension, or the
pivots of the cells, ``MOST_PIVOTS`` at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.scratch import saved

#: Rows of a block when all rows are compared with all others.
BLOCK_ROWS = 4000
#: Rows of a cell in the mean when nearest neighbours are searched, and the largest number of cells.
CELL_ROWS, MOST_PIVOTS = 4000, 4096
#: Cells are used if they leave this share of all pairs at most; else blocks of up to so many rows meet each other.
CELL_SHARE, WIDE_ROWS = 0.3, 50_000
#: Rows that are compared at once within a block: left, and right.
TILE = 256, 4096


def reservoir(rows: DataFrame, label: str, key: str, most: int = 1024, seed: int = 42) -> DataFrame:
    """Up to ``most`` rows of each class, chosen by hash: a uniform sample that doesn't depend on order."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(label).orderBy(order, key))).where(F.col("_nth") <= most).drop("_nth")


def correlations(rows: DataFrame, channels: list[str], against: str) -> DataFrame:
    """(channel, r): Pearson's r of each channel, over the rows where both are numbers; largest absolute value first."""
    pair = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])).alias("c"), F.col(against).alias("d"))
    real = pair.select("c.channel", "c.v", "d").where(~F.isnan("v") & ~F.isnan("d") & F.col("v").isNotNull() & F.col("d").isNotNull())
    return real.groupBy("channel").agg(F.corr("v", "d").alias("r")).orderBy(F.abs("r").desc(), "channel")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) if len(column) else np.zeros((0, size))


def sums(rows: DataFrame, vector: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and Gram matrix of vectors, added up task by task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            m = _matrix(batch.column(0), size)
            n, s, g = n + len(m), s + m.sum(axis=0), g + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array([[float(n)], s.tolist(), *g.tolist()], pa.list_(pa.float64()))], ["row", "v"])

    cells = rows.select(vector).mapInArrow(part, "row long, v array<double>").select("row", F.posexplode("v").alias("col", "x"))
    found = cells.groupBy("row", "col").agg(F.sum("x").alias("x")).toPandas()
    table = np.zeros((size + 2, size))
    table[found["row"], found["col"]] = found["x"]
    return int(table[0, 0]), table[1], table[2:]


def scaled(rows: DataFrame, vector: str, size: int, out: str = "scaled") -> DataFrame:
    """Adds the vector with mean 0 and population deviation 1 in each dimension (a constant one keeps deviation 0)."""
    n, s, g = sums(rows, vector, size)
    mean = s / max(1, n)
    std = np.sqrt(np.maximum(np.diag(g) / max(1, n) - mean**2, 0))
    std[std == 0] = 1
    m, d = (F.array(*map(F.lit, x.tolist())) for x in (mean, std))
    return rows.withColumn(out, F.zip_with(F.zip_with(F.col(vector), m, lambda a, b: a.cast("double") - b), d, lambda a, b: a / b))


def principal(rows: DataFrame, vector: str, size: int, share: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, explained variance ratios): as many components as explain ``share`` of the variance."""
    n, s, g = sums(rows, vector, size)
    mean = s / max(1, n)
    values, vectors = np.linalg.eigh((g - n * np.outer(mean, mean)) / max(1, n - 1))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    ratios = values / max(values.sum(), 1e-300)
    k = int(np.searchsorted(np.cumsum(ratios), share) + 1)
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1) < 0, -1, 1)
    return mean, vectors[:k], ratios[:k]


def projected(rows: DataFrame, vector: str, mean: np.ndarray, components: np.ndarray, out: str = "pc") -> DataFrame:
    """Adds the coordinates of the vector along the components."""
    shift = F.array(*map(F.lit, mean.tolist()))
    centred = F.zip_with(F.col(vector), shift, lambda a, b: a.cast("double") - b)
    axis = lambda c: F.aggregate(F.zip_with(centred, F.array(*map(F.lit, c.tolist())), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return rows.withColumn(out, F.array(*[axis(c) for c in components]))


def _distances(m: np.ndarray, block: np.ndarray) -> Iterator[np.ndarray]:
    """Euclidean distances of a few rows of m at a time to all of block."""
    square = (block**2).sum(axis=1)
    for at in range(0, len(m), 256):
        part = m[at : at + 256]
        yield np.sqrt(np.maximum((part**2).sum(axis=1)[:, None] + square - 2 * part @ block.T, 0))


def _in_blocks(left: DataFrame, right: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str, size: int | None = None) -> DataFrame:
    """``compare`` for all pairs of a block of left rows and a block of right rows, ``size`` (``BLOCK_ROWS``) rows each, a
    task a pair.

    Exact for any number of rows; what a task holds doesn't grow with it. Both frames have a column ``key``.
    """
    n = [max(1, -(-df.count() // (size or BLOCK_ROWS))) for df in (left, right)]
    block = lambda k: F.pmod(F.xxhash64("key"), F.lit(n[k])).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(n[k] - 1)))
    a = left.withColumn("_i", block(0)).withColumn("_j", every(1))
    b = right.withColumn("_j", block(1)).withColumn("_i", every(0))
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInArrow(compare, schema)


def _pivots(rows: DataFrame, size: int) -> np.ndarray:
    """Vectors of a few rows, chosen by hash: one for ``CELL_ROWS`` rows, ``MOST_PIVOTS`` at most; none if one block holds all."""
    n = rows.count()
    k = min(MOST_PIVOTS, -(-n // CELL_ROWS)) if n > BLOCK_ROWS else 0
    found = [r.v for r in rows.orderBy(F.xxhash64("key"), "key").limit(k).select("v").collect()] if k else []
    return np.array(found, dtype=np.float64).reshape(-1, size)


def _in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot, as ``cell``, and the distance to it, as ``gap``."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [(d.argmin(axis=1), d.min(axis=1)) for d in _distances(_matrix(batch.column("v"), pivots.shape[1]), pivots)]
            cell, gap = (np.concatenate([b[k] for b in best]) if best else np.zeros(0) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], [*batch.schema.names, "cell", "gap"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "cell int", "gap double"])
    return rows.mapInArrow(assigned, schema)


def _reached(rows: DataFrame, pivots: np.ndarray, inner: np.ndarray, outer: np.ndarray, counted: bool = False) -> DataFrame:
    """Replaces ``cell`` by each other cell that may hold a row within ``bound``; ``inner`` and ``outer`` are the least
    and largest gap of a cell's rows (infinite and minus infinite for a cell without rows). With ``counted``, gives no more
    than numbers of rows (cell, n), which add up.

    A row x of cell j is no nearer to q than |d(q, p_j) - gap(x)|, by the triangle inequality; and as x is nearer to its
    own pivot than to q's, d(q, x) is at least (d(q, p_j)^2 - d(q, p_q)^2) / 2 d(p_q, p_j). Rounding is allowed for.
    """
    apart = np.concatenate(list(_distances(pivots, pivots)))
    longest = float(np.sqrt((pivots**2).sum(axis=1)).max())

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, own, bound = _matrix(batch.column("v"), pivots.shape[1]), batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
            found = []
            for k, d in enumerate(_distances(m, pivots)):
                part = slice(k * 256, k * 256 + len(d))
                at, q = np.arange(len(d)), own[part]
                scale = 1 + longest + np.sqrt((m[part] ** 2).sum(axis=1))[:, None]
                u = bound[part][:, None] + 1e-6 * scale
                near = (d - outer <= u) & (inner - d <= u) & (d**2 - (d[at, q] ** 2)[:, None] <= 2 * apart[q] * u + 1e-9 * scale**2) & np.isfinite(inner)
                near[at, q] = False
                found += [np.flatnonzero(n) for n in near]
            if counted:
                cells, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(n)], ["cell", "n"])
                continue
            times = np.array([len(f) for f in found], dtype=np.int64)
            again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))
            cells = pa.array(np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([cells if n == "cell" else c for n, c in zip(again.schema.names, again.columns, strict=True)], again.schema.names)

    return rows.mapInArrow(others, "cell int, n long" if counted else rows.schema)


def _met_in_cells(left: DataFrame, right: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``compare`` for all left and right rows with the same ``cell``, ``BLOCK_ROWS`` rows of either side at a time."""
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
    both = F.broadcast(saved(parts(left, "_l").join(parts(right, "_r"), "cell", "left"), "cells").select("cell", "_l", F.coalesce("_r", F.lit(1)).alias("_r")))  # a row a cell
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(both, "cell").withColumn("_i", block("_l")).withColumn("_j", every("_r")).drop("_l", "_r")
    b = right.join(both, "cell").withColumn("_j", block("_r")).withColumn("_i", every("_l")).drop("_l", "_r")
    keys = ["cell", "_i", "_j"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(compare, schema)


def neighbours(left: DataFrame, right: DataFrame, size: int, k: int, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``compare`` gives for blocks of ``left`` and ``right`` (key, v, ...), among it for every left key (``key``) its
    k nearest right rows, with their ``distance``.

    Exact for any number of rows. Right rows lie in the cells of pivots. A left row first meets its own cell, where the
    k-th distance is a ``bound`` (a column that ``compare`` may use), and then only the cells that may hold a nearer row
    (``_reached``). Where these leave more than ``CELL_SHARE`` of all pairs, all rows meet in wide blocks instead: a row is
    sent once for a block, not for a cell. Right rows that fit into one block are compared as they are.
    """
    pivots = _pivots(right, size)
    if not len(pivots):
        return _in_blocks(left, right, compare, schema)
    a, b = (saved(_in_cells(df, pivots), "cells") for df in (left, right))
    inner, outer, rows = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots))
    for r in b.groupBy("cell").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count(F.lit(1)).alias("n")).collect():  # a row a pivot
        inner[r.cell], outer[r.cell], rows[r.cell] = r.low, r.high, r.n
    own = saved(_met_in_cells(a.drop("gap"), b.drop("gap"), compare, schema), "own")
    bounds = own.groupBy("key").agg(F.get(F.array_sort(F.collect_list("distance")), F.lit(k - 1)).alias("bound"))
    bounded = saved(a.drop("gap").join(bounds, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "bounded")
    times = {r.cell: r.n for r in _reached(bounded, pivots, inner, outer, counted=True).groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = bounded.count(), int(rows.sum())
    if sum(t * rows[c] for c, t in times.items()) > CELL_SHARE * n[0] * n[1]:
        wide = max(BLOCK_ROWS, min(WIDE_ROWS, max(n) // 8))
        return _in_blocks(bounded.drop("cell"), b.drop("cell", "gap"), compare, schema, wide)
    reached = saved(_reached(bounded, pivots, inner, outer), "reached")
    return own.unionByName(_met_in_cells(reached, b.drop("gap"), compare, schema))


def _nearest(m: np.ndarray, block: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, distance): for each row of m its k nearest rows of block that are no farther than the row's bound, of
    equally near ones the first; by row, nearest first. NaN is no distance.

    Scores |b|^2 - 2 ab in single precision leave few pairs, as they are compared to the bound and the k-th distance so far,
    with what rounding may add; of those the distances are taken exactly.
    """
    real = np.flatnonzero(np.isfinite(block).all(axis=1))
    block = block[real]
    middle = block.mean(axis=0) if len(block) else 0.0
    a, b = m - middle, block - middle
    length, square = np.sqrt((a**2).sum(axis=1)), (b**2).sum(axis=1)
    longest = np.sqrt(square.max(initial=0.0))
    top = max(length.max(initial=0.0, where=np.isfinite(length)), longest)
    kind, unit = (np.float32, 1.2e-7) if 1e-15 < top < 1e15 else (np.float64, 2.3e-16)
    left = np.concatenate([-2 * a, np.ones((len(a), 1))], axis=1).astype(kind)
    right = np.ascontiguousarray(np.concatenate([b, square[:, None]], axis=1).astype(kind).T)
    slack = (m.shape[1] + 8) * unit * (length + longest) ** 2 + 1e-15 * np.abs(middle).sum() * (length + longest)
    done = []
    for low in range(0, len(m), TILE[0]):
        part = slice(low, low + TILE[0])
        own, off, extra = m[part], length[part] ** 2, slack[part]
        limit = bound[part].astype(np.float64) ** 2 - off + extra
        row, at, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for first in range(0, len(block), TILE[1]):
            score = left[part] @ right[:, first : first + TILE[1]]
            if score.shape[1] > k and np.isinf(limit).any():
                kth = np.partition(score, k - 1, axis=1)[:, k - 1].astype(np.float64) + 2 * extra
                limit = np.fmin(limit, kth)
            hit = np.flatnonzero(score <= limit.astype(kind)[:, None])
            if not len(hit):
                continue
            r, c = hit // score.shape[1], hit % score.shape[1] + first
            d = np.concatenate([np.sqrt(((own[r[x : x + 65536]] - block[c[x : x + 65536]]) ** 2).sum(axis=1)) for x in range(0, len(hit), 65536)])
            row, at, far = np.concatenate([row, r]), np.concatenate([at, c]), np.concatenate([far, d])
            order = np.lexsort((at, far, row))
            row, at, far = row[order], at[order], far[order]
            start = np.searchsorted(row, np.arange(len(own)))
            nth = np.arange(len(row)) - start[row]
            last = np.flatnonzero(nth == k - 1)
            limit[row[last]] = np.minimum(limit[row[last]], far[last] ** 2 - off[row[last]] + extra[row[last]])
            row, at, far = (x[nth < k] for x in (row, at, far))
        near = np.isfinite(far)
        done.append((row[near] + low, real[at[near]], far[near]))
    return tuple(np.concatenate([np.zeros(0, t), *[x[i] for x in done]]) for i, t in enumerate((np.int64, np.int64, np.float64)))


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _all_distances(a: pa.Table, b: pa.Table, size: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, b.num_rows)), *_distances(_matrix(a.column("v").combine_chunks(), size), _matrix(b.column("v").combine_chunks(), size))])


def _matrices(a: pa.Table, b: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(a.column("v").combine_chunks(), size), _matrix(b.column("v").combine_chunks(), size)


def _bounds(a: pa.Table) -> np.ndarray:
    return _column(a, "bound") if "bound" in a.column_names else np.full(a.num_rows, np.inf)


def nearest(test: DataFrame, train: DataFrame, vector: str, key: str, size: int) -> DataFrame:
    """(key, distance): each test row's distance to the nearest of the training rows; infinite if there are none."""

    def least(a: pa.Table, b: pa.Table) -> pa.Table:
        out = np.full(a.num_rows, np.inf)
        row, _, far = _nearest(*_matrices(a, b, size), 1, _bounds(a))
        out[row] = far
        return pa.table({"key": a.column("key"), "distance": pa.array(out)})

    rows = [df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")) for df in (test, train)]
    return neighbours(*rows, size, 1, least, "key long, distance double").groupBy(F.col("key").alias(key)).agg(F.min("distance").alias("distance"))


def memorisation(test: DataFrame, train: DataFrame, vector: str, key: str, size: int, n_test: int = 1000, n_train: int = 5000) -> DataFrame:
    """(nn_mean, nn_std, n): mean and sample deviation of nearest distances from a sample of test to a sample of train."""
    pick = lambda df, n: df.withColumn("_h", F.md5(F.concat_ws("|", F.lit("nn"), F.col(key).cast("string")).cast("binary"))).orderBy("_h", key).limit(n)
    return nearest(pick(test, n_test), pick(train, n_train), vector, key, size).agg(F.avg("distance").alias("nn_mean"), F.stddev_samp("distance").alias("nn_std"), F.count(F.lit(1)).alias("n"))


def silhouettes(sample: DataFrame, vector: str, key: str, label: str, size: int) -> DataFrame:
    """(key, silhouette) of all rows, Euclidean; a class of one row, or a single class, has 0."""

    def totals(a: pa.Table, b: pa.Table) -> pa.Table:
        names, which = np.unique(np.array(b.column("label").to_pylist(), object).astype(str), return_inverse=True)
        sums = _all_distances(a, b, size) @ np.eye(len(names))[which]
        keys, own = (np.repeat(np.array(a.column(c).to_pylist(), object), len(names)) for c in ("key", "label"))
        return pa.table({"key": pa.array(keys, pa.int64()), "label": pa.array(own, pa.string()), "other": pa.array(np.tile(names, a.num_rows).tolist(), pa.string()), "total": pa.array(sums.ravel())})

    rows = sample.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    sizes = rows.groupBy(F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    sums = _in_blocks(rows, rows, totals, "key long, label string, other string, total double").groupBy("key", "label", "other").agg(F.sum("total").alias("total")).join(sizes, "other")
    own = F.col("label") == F.col("other")
    means = sums.groupBy(F.col("key").alias(key)).agg(F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    return means.select(key, F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300)), F.lit(0.0)).alias("silhouette"))


def folds(sample: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """Adds fold 0 to k - 1, dealt within each class by hash."""
    order = F.md5(F.concat_ws("|", F.lit("fold"), F.col(key).cast("string")).cast("binary"))
    return sample.withColumn("fold", (F.row_number().over(Window.partitionBy(label).orderBy(order, key)) - 1) % k)


def knn_accuracy(sample: DataFrame, vector: str, key: str, label: str, size: int, k: int = 5, n_folds: int = 5) -> DataFrame:
    """(fold, accuracy): each row is classed by the majority of its k nearest rows of other folds, ties by class name; of
    equally near rows those with the smaller key come first."""

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        """The k nearest of a block for each row."""
        b = b.sort_by("key")
        (m, block), bound, fold, others = _matrices(a, b, size), _bounds(a), _column(a, "fold"), _column(b, "fold")
        found = []
        for f in np.unique(fold):
            rows, ats = np.flatnonzero(fold == f), np.flatnonzero(others != f)
            row, at, far = _nearest(m[rows], block[ats], k, bound[rows])
            found.append((rows[row], ats[at], far))
        row, at, far = (np.concatenate([np.zeros(0, t), *[x[i] for x in found]]) for i, t in enumerate((np.int64, np.int64, np.float64)))
        mine, other = a.select(["key", "label", "fold"]).take(pa.array(row)), b.select(["key", "label"]).take(pa.array(at))
        return pa.table([*mine.columns, *other.columns, pa.array(far)], ["key", "label", "fold", "near", "class", "distance"])

    dealt = folds(sample, label, key, n_folds)
    rows = dealt.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col("fold").cast("long").alias("fold"), F.col(vector).alias("v"))
    found = neighbours(rows, rows, size, k, near, "key long, label string, fold long, near long, class string, distance double")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("distance", "near"))
    votes = found.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("key", "label", "fold", "class").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy("key", "label", "fold").agg(F.min_by("class", F.struct(-F.col("n"), F.col("class"))).alias("chosen"))
    return chosen.groupBy("fold").agg(F.avg((F.col("chosen") == F.col("label")).cast("double")).alias("accuracy"))


def shape_columns(side: int, halvings: Column, channels: int, first: int) -> list[Column]:
    """What follows from an encoder's number of halvings: factor, side and number of latents, and the widest stage."""
    shift = lambda how, x: F.call_function(how, F.lit(x).cast("long"), halvings.cast("int"))
    left = shift("shiftright", side)
    return [shift("shiftleft", 1).alias("factor"), left.alias("side"), (channels * left * left * left).alias("latents"), shift("shiftleft", first).alias("widest")]


def separation_verdict(accuracy: Column, silhouette: Column) -> Column:
    return F.when((accuracy > 0.65) & (silhouette > 0.05), "separated").otherwise("not separated")


def reparameterised(rows: DataFrame, seed: int, mu: str = "mu", logvar: str = "logvar", noise: str | None = None) -> DataFrame:
    """Adds z = mu + sigma * noise, with one normal draw per value from the row's own hash and the seed, or the numbers of
    the array column ``noise``."""
    uniform = lambda i, salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("vec_id"), i), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    drawn = lambda i: F.sqrt(-2 * F.log(uniform(i, 1))) * F.cos(2 * np.pi * uniform(i, 2))
    at = drawn if noise is None else lambda i: F.get(F.col(noise), i)
    return rows.withColumn("z", F.transform(F.col(mu), lambda m, i: m + F.exp(0.5 * F.get(F.col(logvar), i)) * at(i)))
