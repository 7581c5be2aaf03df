"""Resampling towards a target distribution: documents are drawn by their importance weight, by sorting and counting.

1. ``bucketed`` turns each text once into its features' buckets: a written table whose rows are blocks of documents, each a
   packed stream of 16-bit buckets with the documents' ends in it.
2. ``counted_buckets`` sorts each stream, takes the lengths of its runs, and merges the runs: one row a bucket and task is
   shuffled. That is done for the corpus and for the target.
3. The gain of a bucket is the log of its share in the target to that in the corpus; there are ``BUCKETS`` of them,
   whatever the corpus. ``weighed`` reads the streams again, looks the gains up and adds them up between the documents' ends.
4. Scores are weights with Gumbel noise from the id, so that the highest ones are a draw without replacement. Ranks come
   from ranges of the scores and the ranges' sizes (``voxloom.operators.ordering``); no task sorts all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.text import Texts, Words, filled, slices
from voxloom.operators.ordering import numbered
from voxloom.scratch import saved

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words go byte by byte together up to this length, and one by one beyond it.
_TOGETHER = 64

_GAPS = np.ones(256, bool)
_GAPS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False
_GAPS[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def _further(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The states of CRC-32 registers after the bytes ``raw[starts:ends]``; all words take each byte together."""
    order = np.argsort(starts - ends, kind="stable")
    s, at, lengths = state[order], starts[order], (ends - starts)[order]
    for k in range(min(_TOGETHER, int(lengths[0]) if len(lengths) else 0)):
        m = int(np.searchsorted(-lengths, -k))  # lengths fall; so many are longer than k
        s[:m] = _CRC[(s[:m] ^ raw[at[:m] + k]) & 0xFF] ^ (s[:m] >> np.uint32(8))
    for j in range(int(np.searchsorted(-lengths, -_TOGETHER))):
        begin = at[j] + _TOGETHER
        s[j] = zlib.crc32(raw[begin : at[j] + lengths[j]].tobytes(), int(s[j]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(words: Words, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, CRC-32) of each run of 1 to ``longest`` words of a text, joined by a space, by text."""
    raw, owner, n = _LOWER[words.texts.bytes], words.text_of(), len(words.starts)
    state = _further(np.full(n, 0xFFFFFFFF, np.uint32), raw, words.starts, words.ends)
    docs, found = [owner], [state]
    for k in range(1, longest):
        if n <= k:
            break
        state = state[:-1]
        state = _CRC[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> np.uint32(8))
        state = _further(state, raw, words.starts[k:], words.ends[k:])
        whole = owner[: n - k] == owner[k:]
        docs.append(owner[: n - k][whole])
        found.append(state[whole])
    docs, found = np.concatenate(docs), np.concatenate(found) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(docs, kind="stable") if longest > 1 else slice(None)
    return docs[order], found[order]


def bucketed(docs: DataFrame, id_col: str, text_col: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(ids, words, ends, stream): blocks of documents. Document k of a block has words[k] words and the features
    ends[k - 1] to ends[k] of the stream, which holds the features' buckets as 16-bit numbers, least byte first."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket has to fit into 16 bits")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = filled(batch.column(1))
            for low, high in slices(column):
                words = Texts(column.slice(low, high - low)).words(_GAPS)
                owner, crc = features(words, longest)
                ends = np.cumsum(np.bincount(owner, minlength=high - low))
                stream = (crc % np.uint32(buckets)).astype("<u2").tobytes()
                lists = [batch.column(0).slice(low, high - low), pa.array(words.counts.astype(np.int64)), pa.array(ends.astype(np.int64))]
                whole = pa.array([0, high - low], pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(whole, x) for x in lists), pa.array([stream], pa.binary())], ["ids", "words", "ends", "stream"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(packed, "ids array<long>, words array<long>, ends array<long>, stream binary")


def counted_buckets(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                stream = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
                first = np.flatnonzero(np.diff(stream, prepend=stream[:1].astype(np.int64) - 1))
                total[stream[first]] += np.diff(np.append(first, len(stream)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = streams.select("stream").mapInArrow(runs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found.bucket] = found.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """In thousandths, rounded down: the log of a bucket's smoothed share in the target to that in the corpus."""
    n, of, own = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (of + n) / ((s + 1) * (own + n)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weighed(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every document."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, ends = (batch.column(c)[k].values for c in range(3))
                stream = np.frombuffer(batch.column(3)[k].as_buffer(), "<u2")
                ends = ends.to_numpy()
                sizes = np.diff(ends, prepend=0)
                some = sizes > 0
                weight = np.zeros(len(ends), np.int64)
                if some.any():
                    weight[some] = np.add.reduceat(gain[stream], (ends - sizes)[some])
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(sizes), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return streams.select("ids", "words", "ends", "stream").mapInArrow(added, "id long, n_words long, n_features long, weight long")


def noise(of: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the id's SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(of.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's (id_col, n_features, weight, score, rank): of the N rows with ``least_words`` words or more,
    floor(percent * N / 100) are drawn and have a rank, 1 for the highest score; the others' rank is null.

    Words are runs of ASCII letters and digits and of everything beyond ASCII; A to Z count as a to z. Null and empty texts
    have no features and weight 0. Scores that tie go by id, null ids last; rows that repeat are drawn one by one. A null
    id's noise is that of the empty string. An empty target, or corpus, counts as one of equal shares. Texts of any length
    are read whole; an empty table gives an empty result; other columns, whatever their names, don't matter.
    """
    streams = saved(bucketed(docs, id_col, text_col, longest, buckets), "streams")
    wanted = bucketed(target.select(F.lit(None).cast("long").alias("_id"), F.col(target_col).alias("_text")), "_id", "_text", longest, buckets)
    gain = gains(counted_buckets(streams, buckets), counted_buckets(wanted, buckets))
    scored = saved(weighed(streams, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("able", F.col("n_words") >= least_words), "scored")
    drawn = percent * scored.where("able").count() // 100
    ranked = numbered(scored, F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), name="n")
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("able") & (F.col("n") <= drawn), F.col("n")).alias("rank"))


#: The same rows in DuckDB's SQL; the CRC is folded byte by byte over a table made from its polynomial.
SQL = rf"""
WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
lowered AS (SELECT 0 AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, id, w, count(*) AS n FROM (SELECT side, id, unnest(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM lowered) GROUP BY ALL),
hexed AS (SELECT w, hex(w) AS x FROM (SELECT DISTINCT w FROM words)),
coded AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket FROM hexed, crc),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM words JOIN coded USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM sums),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM words JOIN coded USING (w) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON doc_id = id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= {PERCENT} * n // 100 THEN r::BIGINT END AS rank FROM ranked
"""
