"""What leaves a task, and how much of it: small checks of what made large inputs slow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom import scratch
from voxloom.operators import latent, segmentation, volumes
from voxloom.schemas import VOLUME_CHUNKS
from voxloom.sources import chunks


def test_blocks_have_the_extent_of_their_volume(spark):
    """A volume of one block sends itself one row of its own bits, with the 27 places where it sees itself."""
    shapes = spark.createDataFrame([("a", 8, 8, 8)], "volume_id string, d int, h int, w int")
    voxels = spark.createDataFrame([("a", 1, 2, 3), ("a", 7, 7, 7)], "volume_id string, z int, y int, x int")
    rows = volumes.shared_blocks(voxels, shapes, 5, 64).collect()
    assert [len(r.bits) for r in rows] == [64]
    assert [len(r[f"at_{a}"]) for r in rows for a in "zyx"] == [3, 3, 3]


def stored(spark, ids, value):
    return spark.createDataFrame([(i, 0, 0, 0, 1, 1, 1, bytearray([value]), bytearray([0])) for i in ids], VOLUME_CHUNKS)


def test_a_store_has_a_folder_for_a_write_and_the_newest_chunks(spark, tmp_path):
    chunks.write(stored(spark, [f"v{k}" for k in range(200)], 1).repartition(3), f"{tmp_path}/store")
    assert len([f for f in (tmp_path / "store").rglob("*") if not f.name.startswith((".", "_"))]) <= 4
    chunks.write(stored(spark, ["v7", "w"], 2), f"{tmp_path}/store")
    found = {r.volume_id: r.xct[0] for r in chunks.read(spark, f"{tmp_path}/store").collect()}
    assert found == {f"v{k}": 1 for k in range(200)} | {"v7": 2, "w": 2}


def test_local_thresholds_have_no_group_for_each_chunk(spark):
    rows = segmentation.local_threshold(stored(spark, ["a", "b"], 9), 2, 0.125, 4)
    assert "InArrow" in (plan := rows._jdf.queryExecution().toString()) and "FlatMapGroupsInArrow" not in plan
    assert [len(r.binary) for r in rows.collect()] == [1, 1]


def test_large_written_tables_do_not_go_through_the_driver(spark, monkeypatch):
    rows = spark.range(500).withColumn("x", F.lit("the same in every row"))
    plan = lambda: rows.join(scratch.saved(rows, "rows").groupBy("id").count(), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 100)
    assert "BroadcastHashJoin" not in plan() and "SortMergeJoin" in plan()
    assert scratch.saved(rows.where("false"), "none").count() == 0


def test_hulls_are_dealt_out(spark):
    """Few bytes of lines are much work: no group for each pore, and all partitions take part."""
    lines = spark.createDataFrame([("v", k, k, 0, 0, k % 3) for k in range(40)], "volume_id string, label int, z int, y int, x0 int, x1 int")
    plan = (rows := volumes.hull_sizes(lines))._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "FlatMapGroupsInArrow" not in plan
    assert {r.label: r.hull for r in rows.collect()} == {k: k % 3 + 1 for k in range(40)}


def test_rows_meet_in_wide_blocks_where_cells_save_nothing(spark, monkeypatch):
    """Uniform rows of many dimensions: no row is sent once for each of the cells, and none farther than its bound comes back."""
    for name, n in {"CELL_ROWS": 40, "BLOCK_ROWS": 30, "WIDE_ROWS": 200}.items():
        monkeypatch.setattr(latent, name, n)
    sides, met, plain = [], [], latent._in_blocks
    monkeypatch.setattr(latent, "_in_blocks", lambda *rest: sides.append(rest[4:]) or plain(*rest))
    cells = latent._met_in_cells
    monkeypatch.setattr(latent, "_met_in_cells", lambda *rest: met.append(1) or cells(*rest))
    v = np.random.default_rng(1).normal(size=(900, 32))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").repartition(3)
    found = {r.id: r.distance for r in latent.nearest(rows.where("id < 100"), rows.where("id >= 100"), "v", "id", 32).collect()}
    want = np.sqrt(((v[:100, None] - v[None, 100:]) ** 2).sum(axis=2)).min(axis=1)
    assert np.allclose([found[k] for k in range(100)], want, atol=1e-12)
    assert sides == [(100,)] and len(met) == 1


@pytest.mark.parametrize(("scale", "shift"), [(1, 0), (1, 1000), (1e-20, 0), (1e20, 0)])
def test_nearest_in_a_block(scale, shift):
    """Exact, ties by place, whatever single precision makes of the numbers."""
    g = np.random.default_rng(2)
    a, b = ((g.normal(size=(n, 8)) + shift) * scale for n in (300, 6000))
    b[100:400], a[3] = b[5], b[5]
    a[9, 2] = b[77, 1] = np.nan
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    d[np.isnan(d)] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    far = np.take_along_axis(d, order, 1)
    bound = np.where(np.arange(300) % 2, far[:, 4], np.inf)
    row, at, found = latent._nearest(a, b, 5, bound)
    assert np.array_equal(at, order[np.isfinite(far)]) and np.allclose(found, far[np.isfinite(far)], rtol=1e-12, atol=0)
    assert np.array_equal(np.unique(row), np.flatnonzero(np.isfinite(far[:, 0])))


def test_strips_go_to_chunks_that_are_there(spark, monkeypatch):
    """A window far wider than the volume: two chunks send a strip to themselves and one to each other, not 81 each."""
    sent, plain = [], segmentation._per_chunk

    def counted(chunks, schema, rows):
        out = plain(chunks, schema, rows)
        if "part binary" in schema:
            sent.append(out.count())
        return out

    monkeypatch.setattr(segmentation, "_per_chunk", counted)
    rows = spark.createDataFrame([("a", 0, 0, k, 4, 4, 4, bytearray(range(k, 64 + k))) for k in range(2)], "volume_id string, cz int, cy int, cx int, d int, h int, w int, xct binary")
    assert segmentation.local_threshold(rows, 30, 0.125, 4).count() == 2 and sent == [4]
