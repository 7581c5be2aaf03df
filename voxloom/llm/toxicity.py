"""Toxicity by non-negative positive-unlabelled learning: numpy classifiers over hashed words and word beginnings.

Only confirmed toxic examples count as labels; the texts at large are unlabelled, and a share ``prior`` of them is toxic.
With P the mean over the examples and U that over the unlabelled texts, the risk of a classifier g is

    prior * P[loss(g, toxic)] + max(0, U[loss(g, clean)] - prior * P[loss(g, clean)])

The second term is the risk on clean texts, estimated without any; it can't be negative, and where training drives the
estimate below zero its gradient is turned round (Kiryo et al. 2017). The loss is the logistic one, so the sigmoid of g
is the chance of being toxic.

The unlabelled texts are a sample of all texts, confirmed examples among them, as the estimate asks for: U is the mean over
the texts as they come, and P over the toxic ones.

The fit reads all texts that aren't held out. A hash deals them to shards of about ``SHARD`` texts; in each shard's task
classifiers are fitted to its texts and the examples, and Spark averages the weights of all shards (parameter mixing,
Zinkevich et al. 2010), as fixed-point numbers, so that their order doesn't matter. Only the examples are bounded: about
``MOST_EXAMPLES``, chosen by a hash, go to every shard. The prior is counted over all labels, and the features are counted
over all examples and all texts that aren't held out. A shard gets only the numbers of the chosen features that a text
has, and repeated rows as one with their number. Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.text import Texts, counted, filled, mix, slices
from voxloom.scratch import saved

BITS = 22
#: Lengths in bytes of the word beginnings that are features, besides whole words.
BEGINNINGS = (4, 5, 6, 7)
MOST_EXAMPLES, SHARD = 5_000, 10_000
#: Weights are added up in units of 1 / FIXED.
FIXED = 1 << 30
#: A feature is used if its count in the examples has so much log-likelihood ratio against the rate in unlabelled texts.
LEAST_EVIDENCE = 14.0
MODELS, EPOCHS, RATE, DECAY, PENALTY = 3, 60, 0.3, 1e-6, 2e-5
FOLDS, HELD_OUT = 5, 0
#: The share of toxic texts where no label tells it.
UNKNOWN_PRIOR = 0.1
#: Labels are broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_GAPS = np.ones(256, bool)
_GAPS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, by text: hashes of words and their beginnings, and of those that it has twice or more.

    Only ASCII letters fold case. A word mentioned once and a word that comes again are different evidence.
    """
    words = texts.words(_GAPS)
    owner, hashes = words.text_of(), words.hashes(_FOLD)
    docs, keys = [owner], [hashes]
    sizes = words.ends - words.starts
    for n in BEGINNINGS:
        long = np.flatnonzero(sizes >= n)
        key = np.full(len(long), n, np.uint64)
        for k in range(n):
            key = mix(key ^ _FOLD[texts.bytes[words.starts[long] + k]].astype(np.uint64))
        docs.append(owner[long])
        keys.append(key)
    spots, ids, times = counted(np.concatenate(docs), np.concatenate(keys))
    again = times > 1
    spots, ids = np.concatenate([spots, spots[again]]), np.concatenate([ids, mix(ids[again])]) >> np.uint64(64 - BITS)
    spots, ids, _ = counted(spots, ids)
    return spots, ids.astype(np.int64)


class Sparse:
    """Rows of distinct columns: (row, column) pairs by row. ``times``: how often each row occurs, once if not given."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, n: int, times: np.ndarray | None = None):
        self.rows, self.columns, self.n = rows, columns, n
        self.times = np.ones(n) if times is None else times

    def margin(self, weight: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.rows, weight[self.columns], minlength=self.n) + bias

    def pull(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, g[self.rows], minlength=size)

    def dealt(self, part: np.ndarray, parts: int) -> list[Sparse]:
        """The rows of each part, in their order; ``part``: the part of each row."""
        part = part.astype(np.uint8)
        of_pair = part[self.rows]
        pairs, rows = np.argsort(of_pair, kind="stable"), np.argsort(part, kind="stable")
        pair_ends, row_ends = (np.append(0, np.cumsum(np.bincount(x, minlength=parts))) for x in (of_pair, part))
        place = np.empty(self.n, np.int64)
        place[rows] = np.arange(self.n)
        own, columns, times = place[self.rows[pairs]], self.columns[pairs], self.times[rows]
        cuts = zip(pair_ends, pair_ends[1:], row_ends, row_ends[1:], strict=False)
        return [Sparse(own[a:b] - low, columns[a:b], high - low, times[low:high]) for a, b, low, high in cuts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def risk_gradient(p: Sparse, u: Sparse, weight: np.ndarray, bias: float, prior: float) -> tuple[float, np.ndarray, float]:
    """The risk on clean texts as estimated from a batch, and the gradient for weights and bias of the step to take."""
    mp, mu = p.margin(weight, bias), u.margin(weight, bias)
    clean = np.average(np.logaddexp(0, mu), weights=u.times) - prior * np.average(np.logaddexp(0, mp), weights=p.times)
    share = p.times * (prior / p.times.sum())
    sp = sigmoid(mp)
    away_p, away_u = -sp * share, sigmoid(mu) * u.times / u.times.sum()
    # Where the estimate is too low to be true: step back.
    gp, gu = ((sp - 1) * share + away_p, away_u) if clean >= 0 else (-away_p, -away_u)
    return clean, p.pull(gp, len(weight)) + u.pull(gu, len(weight)), gp.sum() + gu.sum()


def fitted(p: Sparse, u: Sparse, size: int, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk on the given texts, by proximal steps over random part batches."""
    rng = np.random.default_rng(seed)
    weight, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    scale_w, scale_b = np.full(size, 1e-8), 1e-8
    parts = max(1, min(8, p.n // 50, u.n // 50))
    for _ in range(EPOCHS):
        in_p, in_u = rng.integers(0, parts, p.n), rng.integers(0, parts, u.n)
        for some_p, some_u in zip(p.dealt(in_p, parts), u.dealt(in_u, parts), strict=True):
            if not some_p.n or not some_u.n:
                continue
            _, grad, slope = risk_gradient(some_p, some_u, weight, bias, prior)
            grad = grad + DECAY * weight
            scale_w += grad * grad
            scale_b += slope * slope
            step = RATE / np.sqrt(scale_w)
            weight = weight - step * grad
            weight = np.sign(weight) * np.maximum(0, np.abs(weight) - step * PENALTY)
            bias -= RATE / np.sqrt(scale_b) * slope
    return weight, bias


def _counted(texts: Iterator[pa.RecordBatch], known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(text) to (feature, n): how many of a task's texts have each feature, of ``known`` ones only if given."""
    seen = np.zeros(1 << BITS if known is None else len(known), np.int64)
    for batch in texts:
        column = filled(batch.column(0))
        for low, high in slices(column):
            own = Texts(column.slice(low, high - low))
            if known is None:
                ids, n = np.unique(features(own)[1], return_counts=True)
                seen[ids] += n
            else:
                seen += np.bincount(_hits(own, known)[1], minlength=len(known))
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some if known is None else known[some]), pa.array(seen[some])], ["feature", "n"])


def evidence(in_p: Column, in_u: Column, ratio: float) -> Column:
    """The log-likelihood ratio of a count in the examples against the rate in all texts; 0 where it is below that rate."""
    expected = (in_u + 1) * ratio
    return F.when(in_p > expected, in_p * F.log(in_p / expected) - (in_p - expected)).otherwise(0.0)


def chosen(rows: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The features whose counts in examples stand out, in order; at most 2 ** BITS numbers. rows: text, example.

    All examples and all texts count. Texts are searched only for features that the examples have so often that they
    could stand out: with in_p of n_p examples, in_u is in_p at least, as examples are texts too.
    """
    spark, ratio = rows.sparkSession, n_p / max(1, n_u)
    in_p = rows.where("example").select("text").mapInArrow(lambda b: _counted(b, None), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("in_p"))
    in_p = saved(in_p.where(evidence(F.col("in_p"), F.col("in_p"), ratio) >= LEAST_EVIDENCE), "features")
    known = np.sort(in_p.select("feature").toPandas()["feature"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(known)
    in_u = rows.select("text").mapInArrow(lambda b: _counted(b, shared.value), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("in_u"))
    strong = in_p.join(in_u, "feature").where(evidence(F.col("in_p"), F.col("in_u"), ratio) >= LEAST_EVIDENCE)
    return np.sort(strong.select("feature").toPandas()["feature"].to_numpy(np.int64))


def _hits(texts: Texts, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in ``used``) of the chosen features of each text."""
    rows, ids = features(texts)
    if not len(used):
        return rows[:0], ids[:0]
    at = np.minimum(np.searchsorted(used, ids), len(used) - 1)
    hit = used[at] == ids
    return rows[hit], at[hit]


def _side(rows: pd.DataFrame) -> Sparse:
    """Rows at, n, hits (places of the chosen features), in the order of ``at``, a hash, so that every run draws the same batches."""
    rows = rows.sort_values("at", kind="stable")
    hits = [np.asarray(h, np.int64) for h in rows["hits"]]
    columns = np.concatenate(hits) if hits else np.zeros(0, np.int64)
    return Sparse(np.repeat(np.arange(len(hits)), [len(h) for h in hits]), columns, len(hits), rows["n"].to_numpy(np.float64))


def bounded(prior: float) -> float:
    return float(np.clip(prior, 1e-3, 1 - 1e-3))


def mixed(texts: DataFrame, examples: pd.DataFrame, size: int, prior: float, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, model) and biases: the mean over all shards of ``texts`` (at, n, hits) of the classifiers fitted to each.

    The weights of a model are followed by its bias. Shards send what isn't 0, and a number of their own.
    """
    prior, p = bounded(prior), _side(examples)
    untaught = np.zeros((size, MODELS)), np.full(MODELS, np.log(prior / (1 - prior)))
    if not p.n:
        return untaught
    shared = texts.sparkSession.sparkContext.broadcast(p)

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        u = _side(rows)
        models = [fitted(shared.value, u, size, prior, seed) for seed in range(MODELS)]
        flat = np.rint(np.concatenate([np.append(w, b) for w, b in models]) * FIXED).astype(np.int64)
        some = np.flatnonzero(flat)
        return pd.DataFrame({"place": np.append(some, -1), "w": np.append(flat[some], 1)})

    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards)))
    total = dealt.groupBy("shard").applyInPandas(shard, "place long, w long").groupBy("place").agg(F.sum("w").alias("w")).toPandas().set_index("place")["w"]
    if not len(total):
        return untaught
    flat = np.zeros(MODELS * (size + 1))
    own = total.drop(-1)
    flat[own.index.to_numpy()] = own.to_numpy() / FIXED / total[-1]
    both = flat.reshape(MODELS, size + 1)
    return np.ascontiguousarray(both[:, :size].T), both[:, size].copy()


def scores(texts: Texts, used: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The mean of the models' chances."""
    rows, at = _hits(texts, used)
    margins = [np.bincount(rows, weights[at, k], minlength=texts.n) + bias[k] for k in range(len(bias))]
    return np.mean([sigmoid(m) for m in margins], axis=0)


def held_out(id_col: str):
    """Whether a row is kept from training: its id's CRC-32 modulo ``FOLDS``. A null id is never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", text_hash: bool = False) -> DataFrame:
    """Every row's (id_col, held_out, score, predicted), and with ``text_hash`` the hash h of its text.

    Null and empty texts score like a text without any known word. A row whose id is null counts as held out. Labels that
    repeat count once; an id with both labels counts as toxic. Repeated rows come out alike. Without examples or other
    texts every score is the prior, which is kept between 0.001 and 0.999. Empty tables give empty results; texts of any length are read whole. Other columns of
    either table, whatever their names, don't matter.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) == 1).alias("example"))
    known = saved(known, "known")
    told = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("example").cast("long")), F.lit(0)).alias("n_p")).first()
    prior = told["n_p"] / told["n"] if told["n"] else UNKNOWN_PRIOR
    side = F.broadcast(known) if told["n"] <= BROADCAST_ROWS else known
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(side, "_id", "left").select("text", "_id", F.coalesce("example", F.lit(False)).alias("example"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("example").cast("long")), F.lit(0)).alias("n_p")).first()
    used = chosen(rows, sizes["n_p"], sizes["n"]) if sizes["n_p"] else np.zeros(0, np.int64)
    shared_used = spark.sparkContext.broadcast(used)
    drawn = F.pmod(F.xxhash64("text", "_id", F.lit(1)), F.lit(1 << 30)) < MOST_EXAMPLES / max(1, sizes["n_p"]) * (1 << 30)
    read = rows.select("text", F.xxhash64("text", "_id").alias("at"), (F.col("example") & drawn).alias("in_p"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = filled(batch.column(0))
            for low, high in slices(column):
                found, at = _hits(Texts(column.slice(low, high - low)), shared_used.value)
                ends = np.searchsorted(found, np.arange(high - low + 1)).astype(np.int32)
                own = [batch.column(k).slice(low, high - low) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))], ["at", "in_p", "hits"])

    if sizes["n_p"]:
        found = read.mapInArrow(hits, "at long, in_p boolean, hits array<int>")
        texts = saved(found.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max("in_p").alias("in_p"), F.first("hits").alias("hits")), "hits")
        weights, bias = mixed(texts, texts.where("in_p").select("at", "n", "hits").toPandas(), len(used), prior, -(-sizes["n"] // SHARD))
    else:
        weights, bias = np.zeros((0, MODELS)), np.full(MODELS, np.log(bounded(prior) / (1 - bounded(prior))))
    shared = spark.sparkContext.broadcast((used, weights, bias))
    extra = ["h"] if text_hash else []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = filled(batch.column(1))
            for low, high in slices(column):
                out = scores(Texts(column.slice(low, high - low)), *shared.value)
                own = [batch.column(k).slice(low, high - low) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([own[0], own[2], pa.array(out), pa.array((out >= 0.5).astype(np.int32)), *own[3:]], [id_col, "held_out", "score", "predicted", *extra])

    columns = [F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"), held_out(id_col).alias("held_out")] + ([F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")] if text_hash else [])
    return docs.select(*columns).mapInArrow(score, f"`{id_col}` long, held_out boolean, score double, predicted int" + (", h long" if text_hash else ""))
