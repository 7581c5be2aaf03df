"""WARC archives: written with Spark's text sink, read with a Python data source.

``spark.read.format("warc").load(path)`` plans whole files into partitions of about ``partition_bytes``. A reader parses a
record's headers first. Predicates on header columns are pushed down to it (type, id, address and so on: equality,
membership, beginnings, null tests), and a record that fails them, or whose payload isn't in the schema, is passed over:
its block is skipped by a seek in plain files, and inflated but neither kept nor decoded in ``.gz`` files.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith
from pyspark.sql.types import StructType

from voxloom.scratch import fresh_path

# The names of the format, version 1.1.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"

DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are never replaced by a reference.
LEAST_SHARED = 100
RECORDS_PER_FILE = 20_000
PARTITION_BYTES = 32 << 20
BATCH_BYTES, BATCH_RECORDS = 4 << 20, 4096


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        unknown = [c for c in self.columns if c not in HEADERS and c != "payload"]
        if unknown:
            raise ValueError(f"no such column in a WARC record: {unknown}")
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull, IsNull)):
                self.tests.append((HEADERS[column], type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, base = _opened(self.path)
        found = [f for f in system.get_file_info(pafs.FileSelector(base, recursive=True)) if f.is_file and f.size and not f.base_name.startswith(("_", "."))] if system.get_file_info(base).type == pafs.FileType.Directory else [system.get_file_info(base)]
        out, room = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if room < f.size or not out:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].paths.append(f.path)
            room -= f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in partition.paths:
            for row in self._records(path):
                rows.append(row)
                held += len(row[-1] or b"") if "payload" in self.columns else 0
                if held >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = [*(c for c in self.columns if c != "payload"), *(c for c in self.columns if c == "payload")]
        arrays = dict(zip(names, (pa.array(c, pa.binary() if n == "payload" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)), strict=True))
        return pa.RecordBatch.from_arrays([arrays[c] for c in self.columns], self.columns)

    def _records(self, path: str) -> Iterator[tuple]:
        """The header columns of each record that passes, then its payload if that is wanted."""
        system, name = _opened(self.path)
        wanted = [HEADERS[c] for c in self.columns if c != "payload"]
        with system.open_input_file(path) as raw:
            f = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
            while True:
                head = _head(f, first=True)
                if head is None:
                    return
                if not head.get("content-length", "").isdigit():
                    raise ValueError(f"a record in {path} doesn't say how long it is")
                size = int(head["content-length"])
                if not self._passes(head):
                    _skip(f, size)
                elif "payload" not in self.columns:
                    _skip(f, size)
                    yield tuple(head.get(h) for h in wanted)
                else:
                    block = f.read(size)
                    if len(block) < size:
                        raise ValueError(f"{path} ends within a record")
                    yield (*(head.get(h) for h in wanted), _payload(head, block))

    def _passes(self, head: dict[str, str]) -> bool:
        for name, test, value in self.tests:
            got = head.get(name)
            ok = {"EqualTo": lambda: got is not None and got == value, "In": lambda: got is not None and got in value, "StringStartsWith": lambda: got is not None and got.startswith(value), "IsNotNull": lambda: got is not None, "IsNull": lambda: got is None}  # noqa: B023
            if not ok[test]():
                return False
        return True


def _line(f) -> bytes:
    if hasattr(f, "peek") or isinstance(f, gzip.GzipFile):
        return f.readline()
    out = bytearray()  # Arrow's files have no readline: read a little and go back
    while True:
        at, part = f.tell(), f.read(1024)
        end = part.find(b"\n")
        if end >= 0:
            f.seek(at + end + 1)
            return bytes(out + part[: end + 1])
        if not part:
            return bytes(out)
        out += part


def _head(f, first: bool) -> dict[str, str] | None:
    """The headers of the next record, by lower-case name; None at the end of the file."""
    line = _line(f)
    while line in (b"\r\n", b"\n"):
        line = _line(f)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"a record begins with {line[:40]!r}")
    head = {}
    while (line := _line(f)) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8").partition(":")
        value = value.strip()
        head[name.strip().lower()] = value[1:-1] if value.startswith("<") and value.endswith(">") else value
    return head


def _skip(f, size: int) -> None:
    if not isinstance(f, gzip.GzipFile):
        f.seek(f.tell() + size)
        return
    while size > 0:
        got = len(f.read(min(size, 1 << 20)))
        if not got:
            return
        size -= got


def _payload(head: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP headers."""
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _header(name: str, value: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "%", "%25"), "\r", "%0D"), "\n", "%0A")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n"))).otherwise(F.lit(""))


def unescaped(value: Column) -> Column:
    """A header's value as it was before line breaks and percent signs were escaped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "%0A", "\n"), "%0D", "\r"), "%25", "%")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> DataFrame:
    """One text column ``value``: the record of each row, without the line ends that close it.

    Of rows with equal payloads of ``LEAST_SHARED`` bytes or more the one with the smallest id is the response; the others
    are revisits that refer to it. Rows that repeat the smallest id, and rows with a null id among only such, are responses.
    """
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.octet_length(html).alias("bytes"), F.sha2(html, 256).alias("digest"))
    heads = rows.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    typed = rows.join(heads, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    size = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    value = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), F.lit("\r\n"),
        _header("WARC-Record-ID", urn("id")), _header("WARC-Target-URI", F.col("url")), _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(_header("WARC-Refers-To", urn("first")), _header("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit(END), http, F.when(F.col("revisit"), "").otherwise(F.col("html")),
    )
    return typed.select(value.alias("value"))


def write(pages: DataFrame, path: str, compression: str | None = "gzip", **columns: str) -> None:
    """Writes the ``records`` of ``pages`` under ``path`` by Spark's committer: a lost task's files are never seen."""
    records(pages, **columns).write.option("lineSep", END).option("compression", compression or "none").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The records under ``path``; payloads are decoded only if ``schema`` has the column."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(schema).load(path)


def archived(pages: DataFrame, id_col: str = "page_id", path: str | None = None) -> DataFrame:
    """Writes ``pages`` as WARC files and reads them back: (id_col, payload_bytes, payload_digest, record_type, refers_to).

    Length and digest are of the payload that was read: a revisit's is its response's. Null payloads are empty ones; null
    ids come back null. Repeated rows come out as often as they came in. An empty table gives an empty result; pages of any
    length are written whole; other columns, whatever their names, don't matter.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages, path, id_col=id_col)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    whole = read(spark, path, "record_type string, record_id string, payload_digest string, payload binary").where("record_type = 'response'")
    whole = whole.select("record_type", "record_id", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("sha"))
    others = read(spark, path, "record_type string, record_id string, payload_digest string, refers_to string").where("record_type = 'revisit'")
    named = whole.groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("sha").alias("sha"))
    found = others.join(named, ["refers_to", "payload_digest"], "left")
    out = [number("record_id").alias(id_col), "payload_bytes", F.col("sha").alias("payload_digest"), "record_type"]
    first = whole.select(*out, F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(found.select(*out, number("refers_to").alias("refers_to")))


#: The same rows in DuckDB's SQL.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, payload_bytes >= 100 AND page_id <> min(page_id) OVER (PARTITION BY payload_digest) AS again, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM m
"""
