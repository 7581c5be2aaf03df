"""A sink for files of any kind: rows (path, content) become files below a folder, all of them or none.

A Python data source writer. Each attempt of a task writes into a folder of its own below ``_writing-<job>``. The commit moves
the files of the attempts that Spark reports as done to their names and removes the rest; an abort removes everything.
So a lost executor, a task that runs twice or a job that fails leaves no half file and none of another attempt.

``write_files`` lets tasks move the files, one for each attempt: there the commit only lists the attempts. A task that moves
and is repeated goes on with what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from voxloom.sources.tiff import opened

FORMAT = "voxloom_files"
SCHEMA = "path string, content binary"
#: Moves at a time.
MOVES = 16
#: The list of a job's attempts, where tasks move their files.
LIST = "_attempts"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


def _files(system: fs.FileSystem, folder: str) -> list[str]:
    return [f.path for f in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if f.is_file]


def _move(done: Attempt, folder: str, again: bool = False) -> None:
    """Moves an attempt's files to their names, ``again`` if some may have been moved before."""
    system, source = opened(done.folder)
    _, target = opened(folder)
    files = _files(system, source)
    if len(files) != done.files and not again:
        raise OSError(f"{done.folder} has {len(files)} files of {done.files}")
    places = [(f, f"{target}/{f[len(source):].lstrip('/')}") for f in files]
    for parent in sorted({p.rpartition("/")[0] for _, p in places}):
        system.create_dir(parent, recursive=True)

    def moved(part: list[tuple[str, str]]) -> None:
        for old, new in part:
            try:
                system.move(old, new)
            except OSError:  # a second run of the task may have been faster
                if not again or not system.get_file_info(new).is_file or system.get_file_info(old).is_file:
                    raise

    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(moved, [places[k::MOVES] for k in range(min(MOVES, len(places)))]))


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, job: str | None = None):
        """With ``job``, a name for the folder of the job, the commit leaves a list of the attempts in it."""
        self.folder, self.later = folder.rstrip("/"), job is not None
        self.job = f"{self.folder}/_writing-{job or uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Attempt:
        own, names, made = f"{self.job}/{uuid.uuid4().hex}", set(), set()
        for row in iterator:
            if not row.path or row.path.startswith(("/", "_writing-")) or ".." in row.path.split("/"):
                raise ValueError(f"no path below the folder: {row.path!r}")
            system, name = opened(f"{own}/{row.path}")
            parent = name.rpartition("/")[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            with system.open_output_stream(name) as f:
                f.write(bytes(row.content or b""))
            names.add(name)
        return Attempt(own, len(names))

    def commit(self, messages: list[Attempt | None]) -> None:
        """Moves each file to its name; one that was there is replaced."""
        some = [done for done in messages if done and done.files]
        if self.later:
            system, name = opened(self.job)
            system.create_dir(name, recursive=True)
            with system.open_output_stream(f"{name}/{LIST}") as f:
                f.write("".join(f"{done.folder.rpartition('/')[2]} {done.files}\n" for done in some).encode())
            return
        for done in some:
            _move(done, self.folder)
        self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, name = opened(self.job)
        if system.get_file_info(name).type == fs.FileType.Directory:
            system.delete_dir(name)


class FileSink(DataSource):
    """``df.write.format("voxloom_files").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added; remove the folder first")
        return FileWriter(self.options["path"], self.options.get("job"))


def write_files(files: DataFrame, folder: str) -> None:
    """Writes rows (path, content) below ``folder``; a path that repeats is one file, of one of its rows."""
    spark, job = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(FileSink)
    files.select("path", "content").write.format(FORMAT).mode("append").option("job", job).save(folder)
    writer = FileWriter(folder, job)
    system, name = opened(writer.job)
    with system.open_input_stream(f"{name}/{LIST}") as f:
        attempts = [Attempt(f"{writer.job}/{own}", int(n)) for own, n in (x.split(" ") for x in f.read().decode().splitlines())]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _move(Attempt(**r), writer.folder, again=True)
                system, own = opened(r["folder"])
                if system.get_file_info(own).type == fs.FileType.Directory:
                    system.delete_dir(own)
                yield pa.RecordBatch.from_pydict({"files": pa.array([r["files"]], pa.int64())})

    try:
        if attempts:  # a row a task
            rows = spark.createDataFrame([(a.folder, a.files) for a in attempts], "folder string, files long").repartition(len(attempts))
            rows.mapInArrow(moved, "files long").agg({"files": "sum"}).collect()
    finally:
        writer._clear()
