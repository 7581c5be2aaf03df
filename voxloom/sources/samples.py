"""Exported patch samples: four TIFF volumes and a description each, a manifest per split; old archives converted."""

from __future__ import annotations

import json
import math
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.scratch import saved
from voxloom.sources.file_sink import SCHEMA, write_files
from voxloom.sources.tiff import encoded, opened, volume_of

ARRAYS = ("xct_gt", "mask_gt", "xct_recon", "mask_recon")
META = ("volume_id", "z0", "y0", "x0", "porosity", "source_group")
MANIFEST = "sample_id string, volume_id string, z0 long, y0 long, x0 long, porosity double, source_group string"


FILES = pa.schema([("path", pa.string()), ("content", pa.binary())])
#: Bytes of files that are handed on at once, and voxels of an archive that one row asks for.
HANDED, SLICE = 1 << 22, 1 << 22


def _handed(files: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of files, about ``HANDED`` bytes each."""
    held, size = [], 0
    for path, content in files:
        held.append({"path": path, "content": content})
        size += len(path) + len(content)
        if size >= HANDED:
            yield pa.RecordBatch.from_pylist(held, FILES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, FILES)


def export(samples: DataFrame, folder: str, side: int) -> DataFrame:
    """Writes samples (sample_id, the META columns, ARRAYS of side ** 3 numbers) and returns their manifest.

    A missing column is a KeyError, an array of another length a ValueError. The files of all samples are committed
    together (``file_sink``).
    """
    lost = [c for c in ("sample_id", *META, *ARRAYS) if c not in samples.columns]
    if lost:
        raise KeyError(f"missing: {lost}")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                for name in ARRAYS:
                    if len(r[name]) != side**3:
                        raise ValueError(f"{name} of {r['sample_id']} doesn't hold {side}^3 voxels")
                    yield f"{r['sample_id']}/{name}.tif", encoded(volume_of(np.array(r[name]).reshape(side, side, side)))
                yield f"{r['sample_id']}/meta.json", json.dumps({k: r[k] for k in META}).encode()

    # Few bytes are many files: all shuffle partitions take part.
    dealt = samples.select("sample_id", *META, *ARRAYS).repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sample_id")
    write_files(dealt.mapInArrow(lambda batches: _handed(made(batches)), SCHEMA), folder)
    return samples.selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in (x.split(" ") for x in MANIFEST.split(", "))])


def write_manifest(manifest: DataFrame, folder: str) -> None:
    manifest.write.mode("overwrite").json(f"{folder}/index")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/index")


def files_of(folders: DataFrame, folder: str) -> DataFrame:
    """The rows of ``folders`` with ``file``, a file in each row's folder (``own``, below ``folder``): tasks list the folders.

    Spark's readers list them all for the driver, in up to 10,000 tasks, and read 32 small files a task.
    """
    system, top = opened(folder)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in folders.schema]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(f.path for f in system.get_file_info(pafs.FileSelector(f"{top}/{own}", allow_not_found=True)) if f.is_file) for own in batch.column("own").to_pylist()]
            again = batch.take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array([x for f in found for x in f], pa.string())], [*batch.schema.names, "file"])

    return folders.mapInArrow(listed, ", ".join([*columns, "file string"]))


def archive_slices(archive, most: int) -> Iterator[dict]:
    """(name, n, low, high): slices of about ``most`` voxels of the arrays of an open ``.npz`` archive, from their heads."""
    with zipfile.ZipFile(archive) as z:
        for member in z.namelist():
            with z.open(member) as f:
                shape = _head(f)[0]
            n = shape[0] if shape else 0
            step = max(1, most // max(1, math.prod(shape[1:])))
            yield from ({"name": member, "n": n, "low": low, "high": min(n, low + step)} for low in range(0, max(1, n), step))


def _head(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether in Fortran's order, and type of the array that a stream begins with."""
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject:
        raise ValueError("arrays of objects can't be read")
    return shape, fortran, kind


def archive_slice(archive, name: str, low: int, high: int) -> np.ndarray:
    """Rows low to high of an array of an open ``.npz`` archive; what comes before is passed over."""
    with zipfile.ZipFile(archive) as z, z.open(name) as f:
        shape, fortran, kind = _head(f)
        if fortran:
            return np.frombuffer(f.read(), kind).reshape(shape[::-1]).transpose()[low:high]
        row = math.prod(shape[1:]) * kind.itemsize
        f.seek(low * row, 1)
        return np.frombuffer(f.read((high - low) * row), kind).reshape(high - low, *shape[1:])


def convert_archives(spark: SparkSession, folder: str, delete: bool = False, most: int = SLICE) -> DataFrame:
    """(path, n): every ``.npz`` archive below a folder becomes a folder of TIFF volumes beside it, one per array and
    sample. Slices of ``most`` voxels are dealt out, so an archive is read by many tasks and held by none. The volumes of all
    archives are committed together (``file_sink``); with ``delete``, archives and their ``_meta.json`` go after that, by the
    written list of them: a job that fails has lost nothing, one that is repeated goes on.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(folder).select("path")
    _, top = opened(folder)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            system, own = opened(path)
            with system.open_input_file(own) as f:
                rows = [{"path": path} | r for r in archive_slices(f, most)] or [{"path": path, "name": None, "n": 0, "low": 0, "high": 0}]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("name", pa.string()), *[(c, pa.int64()) for c in ("n", "low", "high")]]))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            system, own = opened(r["path"])
            stem = own[len(top.rstrip("/")) + 1 :].removesuffix(".npz")
            with system.open_input_file(own) as f:
                part = archive_slice(f, r["name"], r["low"], r["high"])
            for k, one in enumerate(part, r["low"]):
                yield f"{stem}/sample_{k:03d}/{r['name'].removesuffix('.npy')}.tif", encoded(volume_of(one))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for old in (path, f"{path.removesuffix('.npz')}_meta.json"):
                    system, name = opened(old)
                    if system.get_file_info(name).is_file:
                        system.delete_file(name)
            yield batch

    slices = saved(archives.mapInArrow(cut, "path string, name string, n long, low long, high long"), "archives")
    found = saved(slices.groupBy("path").agg(F.max("n").alias("n")), "found")
    some = slices.where("low < high")
    write_files(some.repartition(max(1, some.count())).mapInArrow(lambda batches: _handed(made(batches)), SCHEMA), folder)
    return saved(found.mapInArrow(removed, "path string, n long"), "removed") if delete else found
