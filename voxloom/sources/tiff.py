"""Multi-page TIFF volumes: an index of pages, a reader on top of it, and an encoder.

``index`` walks the files' directories in tasks, each file once, into a table of pages with the places of their strips or
tiles; ``read`` deals its rows out, so one large file is read by many tasks. The driver opens no file. Classic and 64-bit
files, either byte order, strips and tiles, plain, PackBits, LZW and Deflate, horizontal and floating-point prediction; one
channel of 8 to 64 bits. Values are cast to uint8 as they are (they wrap, nothing is rescaled).
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.scratch import saved

PAGES_PER_RANGE = 64
SCHEMA = "path string, z int, height int, width int, pixels binary"
LAYOUT = "order string, width int, height int, bits int, form int, compression int, predictor int, across int, down int, offsets array<long>, counts array<long>"
# Tags, types and compressions of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 16: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def opened(path: str):
    """The file system of a path or URI, and the path's name in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def directories(f) -> Iterator[dict[int, tuple]]:
    """The tags of each page; 0 is the byte order."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else None
    if version not in (42, 43):
        raise ValueError("this is no TIFF file")
    place, number, wide = ("Q", "Q", 8) if version == 43 else ("I", "H", 4)
    at, seen = struct.unpack(order + place, head[8:16] if version == 43 else head[4:8])[0], set()
    entry = struct.Struct(f"{order}HH{place}{wide}s")
    while at:
        if at in seen:
            raise ValueError("the pages of this TIFF file run in a circle")
        seen.add(at)
        f.seek(at)
        n = struct.unpack(order + number, f.read(struct.calcsize(number)))[0]
        raw = f.read(n * entry.size + wide)
        tags: dict[int, tuple] = {0: (order,)}
        for tag, kind, count, data in entry.iter_unpack(raw[: n * entry.size]):
            if kind not in TYPES:
                continue
            size = struct.calcsize(TYPES[kind]) * count if kind != 2 else count
            if size > wide:
                f.seek(struct.unpack(order + place, data)[0])
                data = f.read(size)
            tags[tag] = (data[:count],) if kind == 2 else struct.unpack(f"{order}{count}{TYPES[kind]}", data[:size])
        yield tags
        at = struct.unpack(order + place, raw[n * entry.size :])[0]


def layout(tags: dict[int, tuple]) -> dict:
    """What has to be known to read a page: the columns of ``LAYOUT``."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(SAMPLES, 1) != 1:
        raise ValueError("only pages of a single channel can be read")
    width, height, tiled = one(WIDTH, 0), one(HEIGHT, 0), TILE_OFFSETS in tags
    return {
        "order": one(0, "<"), "width": width, "height": height, "bits": one(BITS, 1), "form": one(SAMPLE_FORMAT, 1), "compression": one(COMPRESSION, PLAIN), "predictor": one(PREDICTOR, 1),
        "across": one(TILE_WIDTH, width) if tiled else width, "down": one(TILE_HEIGHT, height) if tiled else min(one(ROWS, height), height),
        "offsets": list(tags[TILE_OFFSETS if tiled else OFFSETS]), "counts": list(tags[TILE_COUNTS if tiled else COUNTS]),
    }


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: runs of bytes as they are, or of one byte."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first, that widen one code early; 256 clears the table, 257 ends."""
    out, table, last = bytearray(), [], b""
    held, bits, width = 0, 0, 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise ValueError("an LZW strip has to begin with a clear code")
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


UNPACK = {PLAIN: bytes, LZW: unpacked_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpacked_bits}


def page(f, at: dict) -> np.ndarray:
    """The pixels of a page in their own type; ``at`` is its layout."""
    if at["compression"] not in UNPACK or at["bits"] not in (8, 16, 32, 64) or at["form"] not in (1, 2, 3) or at["predictor"] not in (1, 2, 3):
        raise ValueError(f"a page of {at['bits']} bits, format {at['form']}, compression {at['compression']}, predictor {at['predictor']} can't be read")
    size, across = at["bits"] // 8, at["across"]
    kind = np.dtype(f"{at['order']}{'uif'[at['form'] - 1]}{size}")
    out = np.zeros((at["height"], at["width"]), kind.newbyteorder("="))
    columns = max(1, -(-at["width"] // max(1, across)))
    for k, (offset, count) in enumerate(zip(at["offsets"], at["counts"], strict=True)):
        if not count:
            continue
        f.seek(offset)
        raw = UNPACK[at["compression"]](f.read(count))
        y, x = k // columns * at["down"], k % columns * across
        rows = min(at["down"], len(raw) // max(1, across * size))
        raw = raw[: rows * across * size]
        if at["predictor"] == 3:
            sums = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8)
            part = np.ascontiguousarray(sums.reshape(rows, size, across).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, across)
        else:
            part = np.frombuffer(raw, kind).reshape(rows, across).astype(out.dtype)
            part = np.cumsum(part, axis=1, dtype=out.dtype) if at["predictor"] == 2 else part
        part = part[: at["height"] - y, : at["width"] - x]
        out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


def index(spark: SparkSession, path: str) -> DataFrame:
    """(path, z, and the columns of ``LAYOUT``) of every page of the .tif and .tiff files at a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").where(F.lower("path").rlike(r"\.tiff?$"))
    columns = [c.split(" ")[0] for c in LAYOUT.split(", ")]
    schema = pa.schema([("path", pa.string()), ("z", pa.int32()), ("order", pa.string()), *[(c, pa.int32()) for c in columns[1:-2]], *[(c, pa.list_(pa.int64())) for c in columns[-2:]]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, own = opened(name)
                with system.open_input_file(own) as f:
                    rows = [{"path": name, "z": k} | layout(tags) for k, tags in enumerate(directories(f))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(walk, f"path string, z int, {LAYOUT}")


def read(spark: SparkSession, path: str, pages_per_range: int = PAGES_PER_RANGE) -> DataFrame:
    """(path, z, height, width, pixels) of every page; pixels are uint8, row by row."""
    ranges = saved(index(spark, path), "pages").repartition("path", F.floor(F.col("z") / pages_per_range)).sortWithinPartitions("path", "z")

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, name = None, None
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    r = batch.slice(k, 1).to_pylist()[0]
                    if r["path"] != name:
                        if f is not None:
                            f.close()
                        name, (system, own) = r["path"], opened(r["path"])
                        f = system.open_input_file(own)
                    image = page(f, r).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), *[pa.array([x], pa.int32()) for x in (r["z"], *image.shape)], pa.array([image.tobytes()])], ["path", "z", "height", "width", "pixels"])
        finally:
            if f is not None:
                f.close()

    return ranges.mapInArrow(pixels, SCHEMA)


def volume_of(array: np.ndarray) -> np.ndarray:
    """A (z, y, x) volume in single precision; leading axes of length one go, any other rank is an error."""
    while array.ndim > 3 and array.shape[0] == 1:
        array = array[0]
    if array.ndim != 3:
        raise ValueError(f"expected a volume, got shape {array.shape}")
    return array.astype(np.float32)


@lru_cache(64)
def _heads(shape: tuple[int, int, int], kind: str, item: int) -> list[bytes]:
    """What stands before each page's pixels, and the file's beginning before the first."""
    form, size, at, heads = {"u": 1, "i": 2, "f": 3}[kind], shape[1] * shape[2] * item, 8, []
    note = f"ImageJ=1.11a\nimages={shape[0]}\nslices={shape[0]}\n\0".encode()
    for k in range(shape[0]):
        out = io.BytesIO()
        tags = [(WIDTH, 4, 1, shape[2]), (HEIGHT, 4, 1, shape[1]), (BITS, 3, 1, item * 8), (COMPRESSION, 3, 1, 1), (PHOTOMETRIC, 3, 1, 1), (OFFSETS, 4, 1, 0), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, shape[1]), (COUNTS, 4, 1, size), (SAMPLE_FORMAT, 3, 1, form)]
        tags += [(DESCRIPTION, 2, len(note), 0)] * (k == 0)
        end = at + 2 + 12 * len(tags) + 4
        data = end + len(note) * (k == 0)
        place = {OFFSETS: data, DESCRIPTION: end}
        out.write(struct.pack("<H", len(tags)))
        for tag, wide, count, value in sorted(tags):
            out.write(struct.pack("<HHII", tag, wide, count, place.get(tag, value)))
        out.write(struct.pack("<I", data + size if k + 1 < shape[0] else 0))
        out.write(note if k == 0 else b"")
        heads.append(out.getvalue())
        at = data + size
    return [struct.pack("<2sHI", b"II", 42, 8) + b"".join(heads[:1]), *heads[1:]]


def encoded(volume: np.ndarray) -> bytes:
    """A multi-page TIFF file of a (z, y, x) array, one strip per page, described as an ImageJ stack."""
    volume = np.ascontiguousarray(volume).astype(volume.dtype.newbyteorder("<"))
    heads = _heads(volume.shape, volume.dtype.kind, volume.itemsize)
    return b"".join(x for k, head in enumerate(heads) for x in (head, volume[k].tobytes() if len(volume) else b""))


def write_file(path: str, volume: np.ndarray) -> None:
    system, name = opened(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name) as f:
        f.write(encoded(volume))


def decoded(data: bytes) -> np.ndarray:
    f = io.BytesIO(data)
    return np.stack([page(f, layout(t)) for t in list(directories(f))])


