"""Quality rules: word and line rules, then a log-likelihood ratio between trusted texts and the whole corpus.

Every text's words and word pairs fall into ``BUCKETS`` hashed buckets. Two multinomials over the buckets are counted,
one over all documents (raw) and one over those that are labelled as good (target); both counts cover every document.
A text's score is its log-likelihood ratio, target against raw, divided by its number of n-grams, so that length doesn't
count. The verdict compares the score with a fixed threshold and depends on nothing else: all documents are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.text import SPACES, Texts, Words, counted, filled, mix, slices
from voxloom.scratch import saved

BUCKETS = 1 << 16
#: Spread like the raw counts, so many n-grams are added to each one of the target: what is rare in both says little. A share,
#: so that a corpus of any size, with the same texts in the same proportions, is judged alike.
PRIOR_SHARE = 1.0
THRESHOLD = -0.06
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Labels are broadcast up to this many rows (24 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
# The symbols of the base rule.
SYMBOLS = "#*$%&|<>"

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
_NOT_NEWLINE = np.zeros(256, bool)
_NOT_NEWLINE[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated_words(words: Words, hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """Per text, the words in windows of ``size`` words that the text has twice or more."""
    n, owner = len(hashes), words.text_of()
    if n < size:
        return np.zeros(words.texts.n, np.int64)
    key = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        key = mix(key ^ hashes[k : n - size + 1 + k])
    at = np.flatnonzero(owner[: len(key)] == owner[size - 1 :])
    order = at[np.lexsort((key[at], owner[at]))]
    same = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    for k in range(1, size):
        covered[k:] |= twice[:-k]
    return np.bincount(owner[covered], minlength=words.texts.n)


def _repeated_lines(texts: Texts) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    lines = texts.words(_NOT_NEWLINE)
    full = np.concatenate([[0], np.cumsum(~SPACES[texts.bytes])])
    some = full[lines.ends] > full[lines.starts]
    owner = lines.text_of()[some]
    docs, _, _ = counted(owner, lines.hashes()[some])
    return np.bincount(owner, minlength=texts.n) - np.bincount(docs, minlength=texts.n)


def ngrams(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and of each pair of neighbours."""
    owner = words.text_of()
    pair = mix(hashes[:-1] ^ mix(hashes[1:])) if len(hashes) else hashes
    whole = owner[1:] == owner[:-1]
    keys = np.concatenate([hashes, pair[whole]]) % np.uint64(BUCKETS)
    return np.concatenate([owner, owner[:-1][whole]]) if len(owner) else owner, keys.astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, good) to (bucket, raw, target): one task's sums."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        column, good = filled(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for low, high in slices(column):
            words = Texts(column.slice(low, high - low)).words()
            docs, keys = ngrams(words, words.hashes())
            raw += np.bincount(keys, minlength=BUCKETS)
            target += np.bincount(keys[good[low:high][docs]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> np.ndarray:
    """The log-likelihood ratio of each bucket: ``BUCKETS`` numbers, whatever the corpus."""
    good = saved(labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).where("_id is not null").distinct(), "trusted")
    few = good.count() <= BROADCAST_ROWS
    flagged = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(good.withColumn("good", F.lit(True))) if few else good.withColumn("good", F.lit(True)), "_id", "left")
    sums = flagged.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = sums.toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[found.bucket], target[found.bucket] = found.raw, found.target
    if not target.sum():
        return np.zeros(BUCKETS)
    share, own = raw / raw.sum(), target / target.sum()
    return np.log(np.divide(own + PRIOR_SHARE * share, (1 + PRIOR_SHARE) * share, out=np.ones(BUCKETS), where=share > 0))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Every row's (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept).

    Null and empty texts have no words and fail the base rules; their score is 0. Without any trusted text every score is
    0. Rows with a null id are never trusted, but judged; repeated rows count and come out as often as they came in.
    Labels that repeat count once. Empty tables give empty results; texts of any length are read whole; other columns,
    whatever their names, don't matter.
    """
    ratios = log_ratios(docs, labels, id_col, text_col, label_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = filled(batch.column(1))
            for low, high in slices(column):
                texts = Texts(column.slice(low, high - low))
                words = texts.words()
                hashes = words.hashes()
                n_words = words.counts
                chars = _sums(~SPACES[texts.bytes] & ((texts.bytes & 0xC0) != 0x80), texts.offsets)
                repeated = _repeated_words(words, hashes)
                failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
                owner, keys = ngrams(words, hashes)
                score = np.bincount(owner, ratios[keys], minlength=texts.n) / np.maximum(1, np.bincount(owner, minlength=texts.n))
                columns = [n_words, chars, _sums(_SYMBOL[texts.bytes], texts.offsets), _repeated_lines(texts), repeated, failed, score, ~failed & (score >= threshold)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(x) for x in columns)], [id_col, *NAMES])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(judge, f"`{id_col}` long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
