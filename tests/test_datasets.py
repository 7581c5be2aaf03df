"""Derived dataset folders, configurations, schedules, and the model registry."""

import json

import pytest
from pyspark.sql import functions as F

from voxloom import config
from voxloom.operators import inference, splits
from voxloom.schemas import PATCH_INDEX, VOLUME_STATS
from voxloom.sources import datasets, json_files


def test_derived_root(spark, tmp_path):
    a, b, c = (f"{tmp_path}/{n}" for n in ("one", "two", "three"))
    index = spark.createDataFrame([(v, "g", "train", 0, 0, 0, 8, 8, 0.1) for v in ("vol_a", "vol_b")], PATCH_INDEX)
    stats = spark.createDataFrame([("vol_a", 1.0, 2.0, 3, None), ("vol_b", 1.0, 2.0, 3, 4)], VOLUME_STATS)
    datasets.write_root(spark, a, index, spark.createDataFrame([("vol_a", "train"), ("vol_b", "train")], "volume_id string, split string"), stats, 1)
    keep = spark.createDataFrame([("vol_a", "val")], "volume_id string, split string")
    datasets.derive_root(spark, a, b, keep, 42)
    rows = spark.read.parquet(f"{b}/patch_index").collect()
    assert [(r.volume_id, r.split) for r in rows] == [("vol_a", "val")]
    doc = json.loads(spark.read.text(f"{b}/splits", wholetext=True).first()[0])
    assert doc["counts"] == {"train": 0, "val": 1, "test": 0} and doc["seed"] == 42
    assert [r.volume_id for r in spark.read.schema(VOLUME_STATS).json(f"{b}/volume_stats").collect()] == ["vol_a"]
    assert datasets.voxel_path(spark, b) == f"{a}/voxels" and datasets.voxel_path(spark, a) == f"{a}/voxels"
    datasets.derive_root(spark, b, c)
    assert datasets.voxel_path(spark, c) == f"{a}/voxels"
    assert {tuple(r) for r in json_files.read_splits(spark, f"{c}/splits").collect()} == {("vol_a", "val")}
    with pytest.raises(ValueError, match="seed"):
        datasets.derive_root(spark, a, c, keep)
    with pytest.raises(ValueError, match="no patches"):
        datasets.derive_root(spark, a, c, keep.replace("vol_a", "vol_z", "volume_id"), 1)


def test_report(spark):
    report = spark.createDataFrame([("a", 0.5), ("b", float("nan"))], "volume_id string, error double")
    lines = [json.loads(r.value) for r in datasets.report_document(report, report.selectExpr("count(*) n")).collect()]
    assert lines[0] == {"kind": "summary", "n": 2} and {x["volume_id"] for x in lines[1:]} == {"a", "b"}


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("data: {split_version: V2, dataset_root: null}\nloss: {beta: 1}\n")
    got = config.load(str(path), **{"loss.beta": 3})
    assert got == {"data": {"split_version": "v2", "dataset_root": "split_v2"}, "loss": {"beta": 3}}
    assert config.settled({"data.dataset_root": "split_v1"})["data.split_version"] == "v1"
    assert config.settled({"data.dataset_root": "elsewhere"}) == {"data.dataset_root": "elsewhere"} and config.settled({"a.b": 1}) == {"a.b": 1}
    for bad in ("loss", "loss.none", "none.beta", "a.b.c"):
        with pytest.raises(KeyError):
            config.load(str(path), **{bad: 1})
    for version, root in (("v2", "split_v1"), ("v9", None), ("v1", "elsewhere")):
        with pytest.raises(ValueError):
            config.settled({"data.split_version": version, "data.dataset_root": root})
    assert config.latent_shape(64, 2, 8, 32) == {"factor": 4, "side": 16, "latents": 32768, "stages": [32, 64, 128]}


def test_migrated(spark, tmp_path):
    old, one, two = (f"{tmp_path}/{n}" for n in ("old", "m1", "m2"))
    index = spark.createDataFrame([(v, "g", "train", 0, 0, 0, 8, 8, 0.1) for v in ("vol_a", "vol_b")], PATCH_INDEX)
    datasets.write_root(spark, old, index, spark.createDataFrame([("vol_a", "train"), ("vol_b", "train")], "volume_id string, split string"), spark.createDataFrame([], VOLUME_STATS), 1)
    datasets.migrated(spark, old, one, two, spark.createDataFrame([("vol_a", "val"), ("vol_b", "test")], "volume_id string, split string"), 42)
    assert {r.split for r in spark.read.parquet(f"{one}/patch_index").collect()} == {"train"}
    assert {(r.volume_id, r.split) for r in spark.read.parquet(f"{two}/patch_index").collect()} == {("vol_a", "val"), ("vol_b", "test")}
    assert datasets.voxel_path(spark, two) == datasets.voxel_path(spark, one) == f"{old}/voxels"
    with pytest.raises(ValueError, match="already"):
        datasets.migrated(spark, old, one, two, spark.createDataFrame([("vol_a", "val")], "volume_id string, split string"), 42)


def test_large_documents(spark, monkeypatch):
    monkeypatch.setattr(json_files, "MOST_VOLUMES", 1)
    with pytest.raises(ValueError, match="document"):
        json_files.splits_document(spark.createDataFrame([("a", "val"), ("b", "val")], "volume_id string, split string"), 1)


def test_folders_of_many_volumes(spark, tmp_path, monkeypatch):
    """Beyond the limit of a document a folder's splits are lines, and folders are derived and copied as ever."""
    monkeypatch.setattr(json_files, "MOST_VOLUMES", 2)
    rows = [("a", "val"), ("b", "train"), ("c", "test"), ("d", "train")]
    index = spark.createDataFrame([(v, "g", s, 8 * k, 0, 0, 8, 8, 0.1) for v, s in rows for k in range(2)], PATCH_INDEX)
    given = spark.createDataFrame(rows, "volume_id string, split string")
    one, two, copy = (str(tmp_path / n) for n in ("one", "two", "copy"))
    datasets.write_root(spark, one, index, given, spark.createDataFrame([], VOLUME_STATS), 1)
    datasets.derive_root(spark, one, copy)
    turned = given.withColumn("split", F.when(F.col("volume_id") == "d", "excluded").otherwise("val"))
    datasets.derive_root(spark, one, two, turned, 7)
    for root, want in ((one, given), (copy, given), (two, turned)):
        assert sorted(datasets.root_splits(spark, root).collect()) == sorted(want.collect())
    doc = json.loads(spark.read.text(f"{one}/splits", wholetext=True).first()[0])
    assert doc["seed"] == 1 and doc["counts"]["train"] == 2 and "volumes" not in doc
    assert {r.volume_id for r in spark.read.parquet(f"{two}/patch_index").collect()} == {"a", "b", "c"}


def test_bins_like_numpy():
    import numpy as np

    bins = {"low": ["c", "a", "b", "d"], "high": ["x", "z", "y"]}
    got = splits.binned_like_numpy(bins, {"low": {"n_val": 1, "n_test": 1}, "high": {"n_val": 1, "n_test": 1}}, 42)
    rng, want = np.random.default_rng(42), {}
    for ids in (["a", "b", "c", "d"], ["x", "y", "z"]):
        rng.shuffle(ids)
        want |= {v: "val" if k == 0 else "test" if k == 1 else "train" for k, v in enumerate(ids)}
    assert got == want
    with pytest.raises(ValueError, match="want"):
        splits.binned_like_numpy({"low": ["a"]}, {"low": {"n_val": 1, "n_test": 1}}, 1)


def test_models():
    assert "mean_encoder" in inference.names()
    with pytest.raises(KeyError):
        inference.build("none")
    with pytest.raises(TypeError):
        inference.build("mean_encoder", width=3)
