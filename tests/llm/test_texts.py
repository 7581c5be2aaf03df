"""Token counts, quality rules and toxicity against libraries, plain Python and held-out labels."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.plain import ODD, WORD
from voxloom.llm import quality, tokens, toxicity
from voxloom.llm.text import Texts

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, good boolean, example string, _id long"


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(i, t, None, None, 0, 1.0, True, "x", 5) for i, t in ODD], EXTRA)
    return spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd, allowMissingColumns=True)


@pytest.fixture(scope="module")
def labels(spark):
    more = spark.createDataFrame([(1, None, 1), (None, 1, 1), (3, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    return spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(more)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def test_tokens_like_the_library(docs):
    lib = library()
    got = Counter(tuple(r) for r in tokens.token_counts(docs).collect())
    want = Counter()
    for r in docs.collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 512)] += 1
    assert got == want


def test_tokens_of_random_strings():
    rnd = random.Random(5)
    alphabet = " \n\t'abcstmdrelv'sS0123.,!?éß漢字😀\x1c\x85-_<|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["a <|endoftext|> b<|endoftext|><|endoftext|>", "x<|endof", "text|>  ", "\n\n a", "''s 'll'lla", "a" * 5000, "ab" * 3000 + " don't"]
    got = tokens.tokens(Texts(pa.array(texts)), tokens.merges(tokens.vocabulary_path()))
    assert got.tolist() == [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]


def base(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), failed


def test_quality_rules(docs, labels):
    got = quality.judged(docs, labels).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    # The verdict, by counting buckets one by one.
    trusted = {r.doc_id for r in labels.where("quality = 1 and doc_id is not null").collect()}
    raw, target, each = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), []
    for r in docs.collect():
        texts = Texts(pa.array([r.text or ""]))
        words = texts.words()
        _, keys = quality.ngrams(words, words.hashes())
        np.add.at(raw, keys, 1)
        if r.doc_id in trusted:
            np.add.at(target, keys, 1)
        each.append((r.doc_id, base(r.text)[5], keys))
    share, a = np.maximum(raw, 1) / raw.sum(), quality.PRIOR_SHARE
    ratio = np.log((target / target.sum() + a * share) / (1 + a) / share)
    want = Counter((i, not failed and (ratio[k].mean() if len(k) else 0) >= quality.THRESHOLD) for i, failed, k in each)
    assert Counter((r.doc_id, r.kept) for r in got) == want


def test_quality_of_a_doubled_corpus(spark, docs, labels):
    """The same texts twice: nothing changes."""
    more = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    twice = labels.union(labels.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    once = Counter((r.doc_id, round(r.score, 9), r.kept) for r in quality.judged(docs, labels).collect())
    got = Counter((r.doc_id, round(r.score, 9), r.kept) for r in quality.judged(more, twice).collect() if r.doc_id is None or r.doc_id < 1_000_000)
    assert all(got[k] >= n for k, n in once.items())


def test_quality_verdict_follows_labels(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = quality.judged(docs, labels).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r.quality: r.kept for r in told.collect()}
    assert share[1] > 0.99 and share[0] < 0.02


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.96
    rank, n = got.score.rank(), (got.toxic == 1).sum()
    assert (rank[got.toxic == 1].sum() - n * (n + 1) / 2) / n / (len(got) - n) > 0.94


def test_more_labels_than_may_be_broadcast(docs, labels, monkeypatch):
    """The joins that shuffle give the same rows as those that broadcast."""
    few = quality.judged(docs, labels).collect(), toxicity.toxicity(docs, labels).collect()
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    assert Counter(few[0]) == Counter(quality.judged(docs, labels).collect())
    assert Counter((r.doc_id, round(r.score, 9)) for r in few[1]) == Counter((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(docs, labels).collect())


def test_toxicity_of_another_order_of_rows(spark):
    """Partitions and the order of rows don't change a score."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    once = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(7, "n_chars").sortWithinPartitions("text"), labels.repartition(3)).collect()}
    assert once == again


def test_toxicity_of_odd_rows(docs, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_risk_and_gradient():
    """One step of the fit moves along the gradient of the risk, taken numerically; also where the clean part is negative."""
    rng = np.random.default_rng(0)
    x = {k: rng.random((n, 4)) < 0.4 for k, n in (("p", 30), ("u", 40))}
    side = lambda a: toxicity.Sparse(*np.nonzero(a), len(a))
    for prior, weight in ((0.2, np.zeros(4)), (0.45, np.array([3.0, 2.0, 2.0, 3.0]))):
        clean, grad, slope = toxicity.risk_gradient(side(x["p"]), side(x["u"]), weight, 0.3, prior)

        def parts(w, b):
            gp, gu = x["p"] @ w + b, x["u"] @ w + b
            loss = lambda g, y: np.log1p(np.exp(-y * g)).mean()
            return prior * loss(gp, 1), loss(gu, -1) - prior * loss(gp, -1)

        def target(w, b):
            toxic, rest = parts(w, b)
            return toxic + rest if clean >= 0 else -rest

        assert abs(clean - parts(weight, 0.3)[1]) < 1e-12
        step = 1e-6
        numeric = [(target(weight + step * e, 0.3) - target(weight - step * e, 0.3)) / (2 * step) for e in np.eye(4)]
        assert np.allclose(grad, numeric, atol=1e-7)
        assert abs(slope - (target(weight, 0.3 + step) - target(weight, 0.3 - step)) / (2 * step)) < 1e-7


def own_features(text):
    return set(toxicity.features(Texts(pa.array([text or ""])))[1].tolist())


def test_toxicity_features_by_brute_force(spark):
    """Counts over all examples and all texts, feature by feature."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id for r in labels.where("toxic = 1 and doc_id is not null").collect()}
    rows = [(r.text, r.doc_id in toxic) for r in docs.collect()]
    in_p, in_u = Counter(), Counter()
    for text, example in rows:
        own = own_features(text)
        in_u.update(own)
        in_p.update(own if example else ())
    n_p = sum(e for _, e in rows)
    want = set()
    for f, n in in_p.items():
        expected = (in_u[f] + 1) * n_p / len(rows)
        if n > expected and n * math.log(n / expected) - (n - expected) >= toxicity.LEAST_EVIDENCE:
            want.add(f)
    frame = docs.sparkSession.createDataFrame(rows, "text string, example boolean")
    got = toxicity.chosen(frame, n_p, len(rows))
    assert want and got.tolist() == sorted(want)


def test_toxicity_fit_reads_all_texts(spark):
    """The mean of the shards' classifiers, each fitted in this process; every text is in one shard, repeated ones with their number."""
    rnd = np.random.default_rng(3)
    rows = [(int(k), int(rnd.integers(1, 4)), [int(c) for c in np.flatnonzero(rnd.random(6) < 0.3)]) for k in rnd.integers(-(1 << 60), 1 << 60, 900)]
    examples = pd.DataFrame([(k, 1, [0, 1] if k % 3 else [1, 2]) for k in range(120)], columns=["at", "n", "hits"])
    texts = spark.createDataFrame(rows, "at long, n long, hits array<int>")
    weights, bias = toxicity.mixed(texts.repartition(5), examples, 6, 0.2, 4)
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(4))).toPandas()
    assert len(dealt) == 900 and dealt.shard.nunique() == 4
    fits = [[toxicity.fitted(toxicity._side(examples), toxicity._side(g), 6, 0.2, seed) for seed in range(toxicity.MODELS)] for _, g in dealt.groupby("shard")]
    want = np.mean([[w for w, _ in f] for f in fits], axis=0)
    assert np.allclose(weights, want.T, atol=1e-8) and np.allclose(bias, np.mean([[b for _, b in f] for f in fits], axis=0), atol=1e-8)
    one, many = toxicity._side(examples), toxicity._side(dealt)
    spread = toxicity._side(dealt.loc[dealt.index.repeat(dealt.n)].assign(n=1))
    folded, plain = (toxicity.risk_gradient(one, u, want[0], 0.1, 0.2) for u in (many, spread))
    assert all(np.allclose(a, b) for a, b in zip(folded, plain, strict=True))


def test_toxicity_in_many_shards(spark, monkeypatch):
    """Shards of 500 texts: held-out accuracy stays, and so do the scores where rows come in another order."""
    monkeypatch.setattr(toxicity, "SHARD", 500)
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).toPandas()
    told = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (told.predicted == told.toxic).mean() > 0.96
    again = toxicity.toxicity(docs.repartition(7, "n_chars"), labels).toPandas()
    assert dict(zip(got.doc_id, got.score)) == dict(zip(again.doc_id, again.score))


def test_rows_dealt_to_parts():
    rng = np.random.default_rng(7)
    x, times = rng.random((50, 6)) < 0.3, rng.integers(1, 5, 50)
    part = rng.choice([0, 1, 3], 50)
    for k, own in enumerate(toxicity.Sparse(*np.nonzero(x), 50, times).dealt(part, 4)):
        dense = np.zeros((own.n, 6), bool)
        dense[own.rows, own.columns] = True
        assert (dense == x[part == k]).all() and (own.times == times[part == k]).all()


def test_risk_is_corrected_when_negative():
    """With the prior set too high the plain estimate would go below zero; training still ends with finite weights."""
    p = toxicity.Sparse(np.arange(100), np.zeros(100, int), 100)
    u = toxicity.Sparse(np.arange(5), np.zeros(5, int), 100)
    weight, bias = toxicity.fitted(p, u, 1, 0.4, 0)
    assert np.isfinite(weight).all() and weight[0] > 0 and np.isfinite(bias)


def test_empty(spark, labels):
    none = spark.createDataFrame([], EXTRA)
    no_labels = labels.limit(0)
    assert tokens.token_counts(none).count() == 0
    assert quality.judged(none, no_labels).count() == 0
    assert toxicity.toxicity(none, no_labels).count() == 0
    some = spark.createDataFrame([(1, "a b", None, None, 0, 1.0, True, "x", 5)], EXTRA)
    assert quality.judged(some, no_labels).first().score == 0.0
    assert abs(toxicity.toxicity(some, no_labels).first().score - 0.1) < 1e-9
