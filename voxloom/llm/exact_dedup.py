"""Exact duplicates: polynomial fingerprints that compose, and a comparison of what they hold to be equal.

A text's fingerprint is its UTF-8 bytes (each plus one) read as the digits of a number in two bases, modulo the prime
2^61 - 1. The fingerprint of two strings in a row is the first one's, shifted by the second one's length, plus the second
one's, so chunks are hashed side by side and added up. A text of more than ``PIECE`` bytes is cut into pieces, which are
hashed in tasks of their own and added up by Spark.

Texts of equal length and fingerprints are a group. Its members are compared with its head, piece by piece: pieces of one
place stream past the head's piece. Large groups are dealt out in parts, each with a copy of the head, so no task's work or
memory depends on the size of a group. Texts that differ from their head make new groups among themselves, until none do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.scratch import saved

PRIME = (1 << 61) - 1
#: Two bases below the prime, without a relation to each other.
BASES = (1_948_657_204_113_760_931, 874_406_251_930_447_219)
CHUNK = 4096
PIECE = 1 << 20
#: A part of a group that is compared in one task has at most so many bytes of a place, or texts.
PART_BYTES, PART_ROWS = 16 << 20, 100
#: Members of groups that are named in a broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000

_P, _LOW = np.uint64(PRIME), np.uint64((1 << 31) - 1)
_MID, _30, _31, _61 = np.uint64((1 << 30) - 1), np.uint64(30), np.uint64(31), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it, by halves: 2^61 is 1, so what overflows comes back at the low end."""
    a1, a0, b1, b0 = a >> _31, a & _LOW, b >> _31, b & _LOW
    middle = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (middle >> _30) + ((middle & _MID) << _31) + a0 * b0)


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.uint64), np.array([base % PRIME], np.uint64), exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = times(out[odd], square)
        square, left = times(square, square), left >> np.uint64(1)
    return out


def _added(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums modulo the prime of values[starts[k]:starts[k + 1]], none of them empty."""
    low, high = np.add.reduceat(values & _LOW, starts), np.add.reduceat(values >> _31, starts)
    return _reduced(times(_reduced(high), np.uint64(1 << 31)) + _reduced(low))


def fingerprints(raw: np.ndarray, offsets: np.ndarray, bases: Sequence[int] = BASES, after: np.ndarray | None = None) -> list[np.ndarray]:
    """For each base the fingerprints of the strings raw[offsets[k]:offsets[k + 1]], shifted by ``after[k]`` bytes that follow."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    chunks = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(n), chunks)
    first = np.cumsum(chunks) - chunks
    begin = offsets[owner] + CHUNK * (np.arange(len(owner)) - first[owner])
    end = np.minimum(begin + CHUNK, offsets[1:][owner])
    out = []
    for base in bases:
        total = np.zeros(n, np.uint64)
        if len(owner):
            ladder = power(base, np.arange(CHUNK))
            back = np.repeat(end, end - begin) - 1 - np.arange(offsets[0], offsets[-1])
            value = raw[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
            at = begin - offsets[0]
            low, high = (np.add.reduceat(value * half[back], at) for half in (ladder & _LOW, ladder >> _31))
            hashed = _reduced(times(_reduced(high), np.uint64(1 << 31)) + _reduced(low))
            left = offsets[1:][owner] - end + (0 if after is None else after[owner])
            total[chunks > 0] = _added(times(hashed, power(base, left)), first[chunks > 0])
        out.append(total)
    return out


def _hashed(rows: DataFrame, bases: Sequence[int]) -> DataFrame:
    """(id, sha, n, at, piece) to (id, sha, n, at, f1, f2)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            wide = pa.types.is_large_binary(column.type)
            offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
            after = batch.column(2).to_numpy() - batch.column(3).to_numpy() - np.diff(offsets)
            cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(offsets[0], offsets[-1], PIECE)), [0, len(column)]))
            parts = [fingerprints(raw, offsets[a : b + 1], bases, after[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            found = [np.concatenate([p[k] for p in parts] or [np.zeros(0, np.uint64)]).astype(np.int64) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(f) for f in found)], ["id", "sha", "n", "at", "f1", "f2"])

    return rows.mapInArrow(mapped, "id long, sha string, n long, at long, f1 long, f2 long")


def _places(piece: int) -> Column:
    """Where each piece of a text of n bytes begins; an empty text has one empty piece."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(piece).cast("long"))).alias("at")


def _piece(piece: int) -> Column:
    return F.expr(f"substring(raw, int(at) + 1, {piece})").alias("piece")


def signed(docs: DataFrame, id_col: str, text_col: str, bases: Sequence[int] = BASES, piece: int = PIECE) -> DataFrame:
    """(id, sha, n, f1, f2, copies): the distinct rows, how often they occur, bytes and fingerprints of their texts."""
    rows = _texts(docs, id_col, text_col)
    key = ["id", "sha", "n"]
    small = _hashed(rows.where(F.col("n") <= piece).select(*key, F.lit(0).cast("long").alias("at"), F.col("raw").alias("piece")), bases)
    small = small.groupBy(*key, "f1", "f2").agg(F.count(F.lit(1)).alias("copies"))
    pieces = rows.where(F.col("n") > piece).select(*key, "raw", _places(piece)).select(*key, "at", _piece(piece))
    hashed = _hashed(pieces.repartition("id", "sha", "at"), bases).groupBy(*key, "at").agg(F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.count(F.lit(1)).alias("copies"))
    whole = lambda f: (F.sum(F.col(f).cast("decimal(19,0)")) % F.lit(PRIME).cast("decimal(19,0)")).cast("long").alias(f)
    return small.unionByName(hashed.groupBy(*key).agg(whole("f1"), whole("f2"), F.max("copies").alias("copies")))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(raw, 256).alias("sha"), F.octet_length(raw).cast("long").alias("n"), raw.alias("raw"))


PRINT = ["n", "f1", "f2"]


def unequal(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, piece: int = PIECE) -> DataFrame:
    """(id, sha) of the rows whose texts differ from the head of their group, the row of the largest id."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) * F.least("n", F.lit(piece)) / PART_BYTES, F.count(F.lit(1)) / PART_ROWS)).cast("int")
    groups = saved(rows.where("n > 0").groupBy(*PRINT).agg(F.count(F.lit(1)).alias("members"), parts.alias("parts"), F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "sha")).alias("head")).where("members > 1"), "groups")
    head = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("sha") == F.col("head.sha"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    placed = rows.join(groups, PRINT).select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), *[F.col(c).alias(f"_{c}") for c in PRINT], head.alias("head"), F.explode(F.when(head, every).otherwise(F.array(F.pmod(F.xxhash64("id", "sha"), F.col("parts")).cast("int")))).alias("part"))
    placed = saved(placed, "members")
    side = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    texts = _texts(docs, id_col, text_col).join(side, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")))
    pieces = texts.select("id", "sha", *[f"_{c}" for c in PRINT], "part", "head", "raw", _places(piece)).select("*", _piece(piece)).drop("raw")
    past = Window.partitionBy(*[f"_{c}" for c in PRINT], "part", "at").orderBy(F.col("head").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pieces.withColumn("first", F.first("piece").over(past)).where("first <> piece").select("id", "sha").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bases: Sequence[int] = BASES, piece: int = PIECE) -> DataFrame:
    """Every row's (id_col, keep_id, group_size, kept, text_sha256): of rows with equal texts the one with the largest id stays.

    Null counts as an empty text. A null id is less than any other; where no row of a group has an id, keep_id is null. Rows
    that repeat, id and text, come out as often as they came in, and at most one of them is kept. Texts of any length are
    compared whole; an empty table gives an empty result; other columns, whatever their names, don't matter.
    """
    rows, turn, settled = saved(signed(docs, id_col, text_col, bases, piece), "prints"), 0, None
    while True:
        differ = saved(unequal(docs, rows, id_col, text_col, piece), "unequal")
        empty = differ.isEmpty()
        named = differ.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"))
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
        here = (rows if empty else rows.join(named, same, "left_anti")).withColumn("turn", F.lit(turn))
        settled = here if settled is None else settled.unionByName(here)
        if empty:
            break
        rows, turn = saved(rows.join(named, same, "left_semi"), "prints"), turn + 1
    key = [*PRINT, "turn"]
    groups = saved(settled.groupBy(*key).agg(F.sum("copies").alias("group_size"), F.max("id").alias("keep_id")), "groups")
    out = settled.join(groups, key).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


#: The same rows in DuckDB's SQL.
SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
