"""Files: TIFF volumes, chunk stores, JSON documents, samples, archives, streams."""

import io
import json
import struct
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from voxloom.operators import patch_metrics
from voxloom.schemas import PATCH_INDEX
from voxloom.sources import catalogue, chunks, file_sink, json_files, samples, tiff
from voxloom.streaming import log_monitor


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float32])
def test_tiff_pages(spark, tmp_path, kind):
    volume = np.random.default_rng(1).integers(0, 400 if kind == np.uint16 else 255, (7, 5, 9)).astype(kind)
    tiff.write_file(f"{tmp_path}/a/one.tif", volume)
    tiff.write_file(f"{tmp_path}/two.TIFF", volume[:1])
    assert np.array_equal(tiff.decoded(tiff.encoded(volume)), volume)
    rows = tiff.read(spark, str(tmp_path), 3).collect()
    assert len(rows) == 8
    for r in rows:
        if r.path.endswith("one.tif"):
            assert np.array_equal(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width), volume[r.z].astype(np.uint8))
    with pytest.raises(ValueError, match="no TIFF"):
        tiff.decoded(b"PK\3\4 whatever")


def packed_bits(data: bytes) -> bytes:
    out = b""
    while data:
        n = len(data) - len(data.lstrip(data[:1]))
        k = min(n, 128) if n > 1 else min(len(data), 3)
        out += (bytes([257 - k]) + data[:1]) if n > 1 else bytes([k - 1]) + data[:k]
        data = data[k:]
    return out + b"\x80"


def packed_lzw(data: bytes) -> bytes:
    bits, table, width, word = [(256, 9)], {bytes([k]): k for k in range(256)}, 9, b""
    for k in range(len(data)):
        one = data[k : k + 1]
        if word + one in table:
            word += one
            continue
        bits.append((table[word], width))
        table[word + one] = len(table) + 2
        n = len(table) + 2
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        word = one
        if n >= 4094:
            bits.append((table[word], width))
            bits.append((256, width))
            table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    bits += ([(table[word], width)] if word else []) + [(257, width)]
    text = "".join(f"{c:0{w}b}" for c, w in bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


PACK = {tiff.PLAIN: bytes, tiff.LZW: packed_lzw, tiff.DEFLATE: zlib.compress, tiff.PACKBITS: packed_bits}


def tiff_of(volume, order="<", big=False, compression=tiff.PLAIN, predictor=1, tile=None, rows=3) -> bytes:
    """Another encoder, for what the library reads but doesn't write."""
    place, number, wide = ("Q", "Q", 8) if big else ("I", "H", 4)
    out = io.BytesIO(struct.pack(order + ("2sHHHQ" if big else "2sHI"), {"<": b"II", ">": b"MM"}[order], *((43, 8, 0, 16) if big else (42, 8))))
    out.seek(0, 2)
    for k, image in enumerate(volume):
        h, w = image.shape
        down, across = tile or (rows, w)
        parts = []
        for y in range(0, h, down):
            for x in range(0, w, across):
                part = image[y : y + down, x : x + across]
                if tile:
                    part = np.pad(part, [(0, down - part.shape[0]), (0, across - part.shape[1])])
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                if predictor == 3:
                    planes = np.frombuffer(part.astype(part.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(*part.shape, -1).transpose(0, 2, 1).reshape(len(part), -1)
                    raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).tobytes()
                parts.append(PACK[compression](raw))
        names = (tiff.TILE_OFFSETS, tiff.TILE_COUNTS) if tile else (tiff.OFFSETS, tiff.COUNTS)
        tags = {tiff.WIDTH: w, tiff.HEIGHT: h, tiff.BITS: image.itemsize * 8, tiff.COMPRESSION: compression, tiff.SAMPLES: 1, tiff.PREDICTOR: predictor, tiff.SAMPLE_FORMAT: "uif".index(image.dtype.kind) + 1}
        tags |= {tiff.TILE_WIDTH: across, tiff.TILE_HEIGHT: down} if tile else {tiff.ROWS: rows}
        begin, size = out.tell(), struct.calcsize(number) + (len(tags) + 2) * (4 + 2 * wide) + wide
        lists, data = begin + size, begin + size + 2 * wide * len(parts)
        offsets = [data + sum(map(len, parts[:i])) for i in range(len(parts))]
        entries = [(t, 3 if t != tiff.WIDTH else 4, 1, v, None) for t, v in tags.items()]
        entries += [(names[i], 16 if big else 4, len(parts), lists + i * wide * len(parts), values) for i, values in enumerate((offsets, [len(x) for x in parts]))]
        out.write(struct.pack(order + number, len(entries)))
        for tag, kind, count, value, values in sorted(entries, key=lambda e: e[0]):
            if values is not None and count == 1:
                value = values[0]
            held = struct.pack(order + ({3: "H", 4: "I", 16: "Q"}[kind] if values is None else place), value)
            out.write(struct.pack(f"{order}HH{place}", tag, kind, count) + held.ljust(wide, b"\0"))
        out.write(struct.pack(order + place, data + sum(map(len, parts)) if k + 1 < len(volume) else 0))
        out.write(struct.pack(f"{order}{2 * len(parts)}{place}", *offsets, *[len(x) for x in parts]))
        out.write(b"".join(parts))
    return out.getvalue()


def test_tiff_formats(spark, tmp_path):
    rng = np.random.default_rng(3)
    options = [{"order": o, "big": b, "compression": c, "tile": t} for o in "<>" for b in (False, True) for c in PACK for t in (None, (16, 16))]
    options += [{"compression": tiff.LZW, "predictor": 2}, {"compression": tiff.DEFLATE, "predictor": 3, "kind": np.float32, "tile": (16, 32)}, {"order": ">", "predictor": 2, "kind": np.int16}]
    want = {}
    for k, o in enumerate(options):
        kind = o.pop("kind", [np.uint8, np.uint16, np.float32][k % 3])
        smooth = np.add.outer(np.arange(20), np.arange(90))[None] + rng.integers(0, 3, (3, 20, 90))
        volume = np.where(rng.random(smooth.shape) < 0.2, 7, smooth).astype(kind)
        data = tiff_of(volume, **o)
        assert np.array_equal(tiff.decoded(data), volume), o
        (tmp_path / f"v {k}.tif").write_bytes(data)
        want |= {(k, z): image.astype(np.uint8).tobytes() for z, image in enumerate(volume)}
    long = rng.integers(0, 4, 30_000, np.uint8).tobytes()
    assert tiff.unpacked_lzw(packed_lzw(long)) == long and tiff.unpacked_bits(packed_bits(long)) == long
    got = {(int(r.path.rsplit(" ", 1)[-1].removesuffix(".tif").rsplit("%20", 1)[-1]), r.z): bytes(r.pixels) for r in tiff.read(spark, str(tmp_path), 2).collect()}
    assert got == want


def test_files_are_committed_together(spark, tmp_path):
    """A task that fails after its first file and is tried again, another that runs twice, and a job that is given up."""
    def broken():
        yield Row(path="a/1", content=b"half")
        raise RuntimeError("lost")

    rows = [Row(path="a/1", content=b"one"), Row(path="b/2", content=b"two")]
    writer = file_sink.FileWriter(str(tmp_path))
    with pytest.raises(RuntimeError):
        writer.write(broken())
    first, twice = writer.write(iter(rows)), writer.write(iter(rows))
    assert first.folder != twice.folder and not (tmp_path / "a").exists()
    writer.commit([twice, None])
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {"a/1": b"one", "b/2": b"two"}
    assert {p.name for p in tmp_path.iterdir()} == {"a", "b"}
    other = file_sink.FileWriter(str(tmp_path))
    done = other.write(iter([Row(path="c", content=None)]))
    other.abort([done, None])
    assert {p.name for p in tmp_path.iterdir()} == {"a", "b"}
    df = spark.createDataFrame([(f"d/{k}", bytes([k])) for k in range(40)] + [("d/0", b"\0")], "path string, content binary").repartition(4)
    file_sink.write_files(df, str(tmp_path))
    assert sorted(int(p.name) for p in (tmp_path / "d").iterdir()) == list(range(40))
    with pytest.raises(Exception, match="no path below"):
        file_sink.write_files(df.selectExpr("'../x' path", "content"), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"a", "b", "d"}


def test_volume_shapes():
    assert tiff.volume_of(np.zeros((1, 1, 2, 3, 4))).shape == (2, 3, 4)
    with pytest.raises(ValueError):
        tiff.volume_of(np.zeros((2, 2, 2, 2)))


def test_discovery(spark, tmp_path):
    for name in ("top.tif", "MedidasDB/a b.TIF", "other/deep/c.tiff", "other/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r.volume_id: r.source_group for r in catalogue.discovered(spark, str(tmp_path)).collect()}
    assert got == {"top": "others/ungrouped", "MedidasDB__a_b": "MedidasDB", "other__deep__c": "others/other"}


def test_chunks_and_patches(spark, tmp_path):
    rng = np.random.default_rng(2)
    cube, mask = rng.integers(0, 256, (9, 10, 11)).astype(np.uint8), (rng.random((9, 10, 11)) < 0.3).astype(np.uint8)
    pages = spark.createDataFrame([("v", z, 10, 11, bytearray(cube[z].tobytes()), bytearray(mask[z].tobytes())) for z in range(9)], "volume_id string, z int, height int, width int, pixels binary, mask binary")
    chunks.write(chunks.chunked(pages, 4), f"{tmp_path}/store")
    chunks.write(chunks.chunked(pages.replace("v", "w", "volume_id"), 4), f"{tmp_path}/store")
    stored = chunks.read(spark, f"{tmp_path}/store")
    assert {r.volume_id for r in stored.select("volume_id").distinct().collect()} == {"v", "w"}
    long = chunks.voxels(stored.where("volume_id = 'v'"), 4).collect()
    assert len(long) == cube.size and all(r.v == cube[r.z, r.y, r.x] and r["mask"] == mask[r.z, r.y, r.x] for r in long)
    index = spark.createDataFrame([("v", "g", "val", 2, 3, 5, 6, 1, 0.5), ("v", "g", "val", 0, 0, 0, 6, 1, 1.5), ("v", "g", "train", 0, 0, 0, 6, 1, 0.5), ("v", "g", "val", 1, 1, 1, 6, 1, float("nan"))], PATCH_INDEX)
    got = {(r.z0, r.y0, r.x0): r for r in chunks.patches(index, stored, "val", 4).collect()}
    assert set(got) == {(2, 3, 5), (1, 1, 1)}
    for (z, y, x), r in got.items():
        at = (slice(z, z + 6), slice(y, y + 6), slice(x, x + 6))
        assert np.allclose(r.xct, cube[at].ravel() / 255, atol=1e-7) and r["mask"] == mask[at].ravel().tolist()
    assert [r.volume_id for r in chunks.missing(spark.createDataFrame([("v",), ("x",)], "volume_id string"), stored).collect()] == ["x"]


def test_json_documents(spark, tmp_path):
    splits = spark.createDataFrame([("a", "train"), ("b", "val")], "volume_id string, split string")
    text = json_files.splits_document(splits, 7, '{"note": 1, "seed": 3}')
    assert json.loads(text) == {"note": 1, "seed": 7, "counts": {"train": 1, "val": 1, "test": 0}, "volumes": {"a": "train", "b": "val"}}
    (tmp_path / "s.json").write_text(text)
    assert {tuple(r) for r in json_files.read_splits(spark, f"{tmp_path}/s.json").collect()} == {("a", "train"), ("b", "val")}
    (tmp_path / "s2.json").write_text('{"split_v2": {"a": "test", "b": {"split": "val", "x": 1}}}')
    assert {tuple(r) for r in json_files.read_splits(spark, f"{tmp_path}/s2.json", "v2").collect()} == {("a", "test"), ("b", "val")}
    stats = spark.createDataFrame([("a", 1.5, 2.0, 3, None), ("b", 1.0, 2.0, 3, 9)], "volume_id string, mean double, std double, n_foreground long, otsu_threshold int")
    (tmp_path / "t.json").write_text(json_files.stats_document(stats))
    assert {tuple(r) for r in json_files.read_stats(spark, f"{tmp_path}/t.json").collect()} == {tuple(r) for r in stats.collect()}
    assert json_files.read_stats(spark, f"{tmp_path}/none.json").count() == 0


def test_samples(spark, tmp_path):
    arrays = {n: np.random.default_rng(k).random(64).tolist() for k, n in enumerate(samples.ARRAYS)}
    rows = [{"sample_id": f"sample_{i:03d}", "volume_id": "v", "z0": i, "y0": 0, "x0": 0, "porosity": 0.5, "source_group": "g", **arrays} for i in range(2)]
    schema = samples.MANIFEST + ", " + ", ".join(f"{n} array<double>" for n in samples.ARRAYS)
    df = spark.createDataFrame(rows, schema)
    samples.write_manifest(samples.export(df, f"{tmp_path}/out", 4), f"{tmp_path}/out")
    assert {r.sample_id for r in spark.read.json(f"{tmp_path}/out/index").collect()} == {"sample_000", "sample_001"}
    assert len(list((tmp_path / "out" / "sample_001").glob("*.tif"))) == 4
    back = tiff.decoded((tmp_path / "out" / "sample_001" / "xct_gt.tif").read_bytes())
    assert np.allclose(back.ravel(), arrays["xct_gt"])
    assert json.loads((tmp_path / "out" / "sample_001" / "meta.json").read_text())["z0"] == 1
    with pytest.raises(KeyError):
        samples.export(df.drop("xct_gt"), f"{tmp_path}/out", 4)
    with pytest.raises(Exception, match="voxels"):
        samples.export(df, f"{tmp_path}/out", 5).collect()


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "val.npz", xct_gt=np.ones((2, 1, 4, 4, 4)), mask_gt=np.zeros((2, 4, 4, 4)))
    (tmp_path / "val_meta.json").write_text("[]")
    assert [r.n for r in samples.convert_archives(spark, str(tmp_path), delete=True).collect()] == [2]
    assert not (tmp_path / "val.npz").exists() and not (tmp_path / "val_meta.json").exists()
    assert tiff.decoded((tmp_path / "val" / "sample_001" / "xct_gt.tif").read_bytes()).shape == (4, 4, 4)


def test_streams(spark, tmp_path):
    log = [(i, "val" if i % 3 else "train", float(i), i / 7) for i in range(40)]
    df = spark.createDataFrame(log, "step long, split string, elapsed double, total double")
    json_files.append_log(df.where("step < 25"), f"{tmp_path}/log")
    stream = lambda: log_monitor.running_moments(log_monitor.logs(spark, f"{tmp_path}/log"), "split", "total")
    log_monitor.kept_current(stream(), f"{tmp_path}/now", f"{tmp_path}/cp").awaitTermination()
    assert sum(r.n for r in spark.read.parquet(f"{tmp_path}/now").collect()) == 25
    json_files.append_log(df.where("step >= 25"), f"{tmp_path}/log")
    log_monitor.kept_current(stream(), f"{tmp_path}/now", f"{tmp_path}/cp").awaitTermination()
    got = {r.split: r for r in spark.read.parquet(f"{tmp_path}/now").collect()}
    train = [t for _, s, _, t in log if s == "train"]
    assert got["train"].n == len(train) and np.isclose(got["train"].q, sum(t * t for t in train))
    due = log_monitor.logs(spark, f"{tmp_path}/log").where(log_monitor.is_due(F.col("step"), 10)).select("step")
    log_monitor.appended(due, f"{tmp_path}/due", f"{tmp_path}/cp2").awaitTermination()
    assert {r.step for r in spark.read.json(f"{tmp_path}/due").collect()} == {9, 19, 29, 39}


def test_rolling_moments(spark, tmp_path):
    """Several triggers, a restart from the checkpoint, and lines that come twice."""
    rng = np.random.default_rng(8)
    rows = [(b, c, 16, float(rng.normal()), float(rng.random() * 3)) for b in range(30) for c in range(4)]
    df = spark.createDataFrame(rows, log_monitor.MOMENTS)
    for low, high in ((0, 7), (5, 20), (20, 30)):
        df.where(f"batch_id >= {low} and batch_id < {high}").repartition(2).write.mode("append").json(f"{tmp_path}/log")
        log_monitor.appended(log_monitor.rolling_moments(log_monitor.logs(spark, f"{tmp_path}/log", log_monitor.MOMENTS), 5), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.schema(log_monitor.MOMENTS).json(f"{tmp_path}/out")
    assert got.count() == len(rows)
    by = {(b, c): (n, s, q) for b, c, n, s, q in rows}
    for r in got.collect():
        last = [by[b, r.ch] for b in range(max(0, r.batch_id - 4), r.batch_id + 1)]
        assert np.allclose([r.n, r.s, r.q], np.sum(last, axis=0))
    want = {tuple(r) for r in patch_metrics.rolling_active(df, 5, 0.1).collect()}
    assert {tuple(r) for r in patch_metrics.counted_active(got, 0.1).collect()} == want and len(want) == 30


def test_windows_close_behind_the_watermark(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    events.repartition(3, "event_id").write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    log_monitor.appended(log_monitor.windowed(stream, "ts", "event_type", "value"), f"{tmp_path}/w", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.json(f"{tmp_path}/w").collect()
    truth = {(r.d, r.event_type): r.n for r in events.selectExpr("date(ts) d", "event_type").groupBy("d", "event_type").count().withColumnRenamed("count", "n").collect()}
    assert got and all(truth[(date.fromisoformat(r.start[:10]), r.event_type)] == r.n for r in got)


def test_tasks_move_files(spark, tmp_path):
    """The commit in the driver only lists the attempts; a task that moves them twice finds them moved."""
    writer = file_sink.FileWriter(str(tmp_path), "j")
    done = [writer.write(iter([Row(path=f"a/{k}", content=bytes([k]))])) for k in range(3)]
    writer.commit([*done[:2], None])
    assert not (tmp_path / "a").exists() and (tmp_path / "_writing-j" / file_sink.LIST).read_text().count("\n") == 2
    for _ in range(2):
        file_sink._move(done[0], str(tmp_path), again=True)
    assert (tmp_path / "a" / "0").read_bytes() == b"\0"
    with pytest.raises(OSError, match="0 files of 1"):
        file_sink._move(done[0], str(tmp_path))
    file_sink.write_files(spark.createDataFrame([("b/1", b"x")], file_sink.SCHEMA), f"{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["b"] and (tmp_path / "out" / "b" / "1").read_bytes() == b"x"


def test_files_are_listed_by_tasks(spark, tmp_path):
    for name in ("a/1.tif", "a/2.tif", "b/c/3.tif", "d/4.tif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = samples.files_of(spark.createDataFrame([("a", 1), ("b", 2), ("b/c", 3), ("nowhere", 4)], "own string, n long"), str(tmp_path))
    assert sorted((r.n, r.file[len(str(tmp_path)) :]) for r in rows.collect()) == [(1, "/a/1.tif"), (1, "/a/2.tif"), (3, "/b/c/3.tif")]
    assert "binaryFile" not in rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives_are_read_in_slices(spark, tmp_path, save):
    """Slices of two samples, in C's and Fortran's order; an archive without samples goes too."""
    x = np.random.default_rng(3).random((5, 2, 3, 4)).astype(np.float32)
    save(tmp_path / "val.npz", x=x, y=np.asfortranarray(x[:3] * 2))
    save(tmp_path / "none.npz", x=x[:0])
    with open(tmp_path / "val.npz", "rb") as f:
        assert [(r["name"], r["low"], r["high"]) for r in samples.archive_slices(f, 48)] == [("x.npy", 0, 2), ("x.npy", 2, 4), ("x.npy", 4, 5), ("y.npy", 0, 2), ("y.npy", 2, 3)]
    assert sorted(r.n for r in samples.convert_archives(spark, str(tmp_path), delete=True, most=48).collect()) == [0, 5]
    for name, a in (("x", x), ("y", x[:3] * 2)):
        for k, one in enumerate(a):
            assert np.array_equal(tiff.decoded((tmp_path / "val" / f"sample_{k:03d}" / f"{name}.tif").read_bytes()), one)
    assert {p.name for p in tmp_path.iterdir()} == {"val"}
