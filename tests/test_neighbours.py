"""Nearest neighbours by cells against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import latent as la

SIZE = 16


def cloud(n, groups, seed):
    """Rows around a few centres (``groups`` = 0: without any), some of them equal."""
    g = np.random.default_rng(seed)
    v = g.normal(size=(n, SIZE))
    v = v + 12 * np.random.default_rng(0).normal(size=(groups, SIZE))[g.integers(0, groups, n)] if groups else v
    v[n // 2 : n // 2 + n // 10] = v[0]
    return v


def table(spark, v, label=None):
    return spark.createDataFrame([(k, [float(y) for y in x], str(k % 3)) for k, x in enumerate(v)], "id long, v array<double>, label string").repartition(3)


def distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(la, "CELL_ROWS", 40)
    monkeypatch.setattr(la, "BLOCK_ROWS", 30)


@pytest.mark.parametrize("groups", [0, 8])
def test_nearest(spark, small_cells, groups):
    a, b = cloud(200, groups, 1), cloud(600, groups, 2)
    found = {r.id: r.distance for r in la.nearest(table(spark, a), table(spark, b), "v", "id", SIZE).collect()}
    want = distances(a, b).min(axis=1)
    assert len(found) == 200 and np.allclose([found[k] for k in range(200)], want, atol=1e-6)


def test_without_training_rows(spark):
    rows = table(spark, cloud(5, 0, 1))
    assert [r.distance for r in la.nearest(rows, rows.where("false"), "v", "id", SIZE).collect()] == [np.inf] * 5
    assert la.nearest(rows.where("false"), rows, "v", "id", SIZE).count() == 0


def test_far_cells_are_not_shipped(spark, small_cells, monkeypatch):
    shipped, plain = [], la._met_in_cells

    def counted(left, right, *rest):
        shipped.append(left.join(right.groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0] or 0)
        return plain(left, right, *rest)

    monkeypatch.setattr(la, "_met_in_cells", counted)
    rows = table(spark, cloud(800, 8, 3))
    assert la.nearest(rows, rows, "v", "id", SIZE).agg(F.max("distance")).first()[0] < 1e-5
    assert len(shipped) == 2 and sum(shipped) < 0.35 * 800 * 800


@pytest.mark.parametrize("groups", [0, 6])
def test_knn_accuracy(spark, small_cells, groups):
    v = cloud(300, groups, 4)
    rows = table(spark, v)
    dealt = {r.id: r.fold for r in la.folds(rows, "label", "id").collect()}
    fold, label = np.array([dealt[k] for k in range(300)]), np.arange(300) % 3
    d = distances(v, v)
    d[d < 1e-9] = 0
    right = {f: [] for f in range(5)}
    for q in range(300):
        order = sorted((d[q, x], x) for x in range(300) if fold[x] != fold[q])[:5]
        votes = [sum(label[x] == c for _, x in order) for c in range(3)]
        right[fold[q]].append(int(np.argmax(votes)) == label[q])
    found = {r.fold: r.accuracy for r in la.knn_accuracy(rows, "v", "id", "label", SIZE).collect()}
    assert found == pytest.approx({f: np.mean(r) for f, r in right.items()})
