"""The pipeline against a brute-force version, and its stages on hard rows."""

from collections import Counter

import corpus_pipeline
import pytest

from tests.conftest import SF as SMALL
from tests.llm.plain import ODD, secret
from tests.llm.test_corpus import classes, leaked, mix
from voxloom.llm import toxicity


SF = SMALL.replace("0.001", "0.01")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in toxic]
    least = {d: c for d, c in classes([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if least[r.doc_id] == r.doc_id]
    bad = {d for d, _ in leaked([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    rows = [r for r in rows if r.doc_id not in bad]
    assert toxic and bad and len(rows) > 100
    at = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns
    got = {r.doc_id: r for r in at.collect()}
    assert sorted(got) == sorted(r.doc_id for r in rows)
    for r in rows:
        assert not secret(got[r.doc_id].text) and got[r.doc_id].n_chars == len(got[r.doc_id].text)
        assert got[r.doc_id].text == r.text or "[secret]" in got[r.doc_id].text or "[example]" in got[r.doc_id].text
    want = Counter({k: n for k, n in mix([(r.doc_id, r.text, r.source) for r in got.values()]).items() if k[4] > 0})
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_on_odd_rows(spark):
    """Nulls anywhere, repeated rows, empty and long texts, extra columns with clashing names; then no rows at all."""
    more = [(i, t, "en", "s", 0, "x", 1) for i, t in ODD] + [(None, None, None, None, None, None, None), (40, "same id", None, "s", 1, "x", 1), (40, "same id, other text", None, "s", 1, "x", 2)]
    docs = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, label string, _id long")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        if name != "mixing":
            assert at.columns == docs.columns and at.count() > 0
        if name == "near_duplicates":
            ids = Counter(r.doc_id for r in at.collect())
            assert ids[40] == 2 and all(n == 1 for d, n in ids.items() if d not in (None, 40))
            assert at.where("doc_id is null").count() == 1  # the other one's text is null like that of document 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("most", [corpus_pipeline.BROADCAST_ROWS, -1])
def test_repeated_and_null_ids(spark, monkeypatch, most):
    """A third of all rows share an id, others have none: copies and leaks go, all other texts stay; by both kinds of join."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", most)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(7, text(k)) for k in range(20)] + [(7, text(3)), (7, text(3)), (8, text(4)), (None, text(5)), (None, text(100)), (None, text(100) + " more"), (None, item), (9, text(101)), (9, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, h int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(got.values()) == 20 + 1 + 1 + 1 and got[(7, text(3))] == 1 and (8, text(4)) not in got
    assert sum(d is None for d, _ in got.elements()) == 1 and (9, item) in got
    clean = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, SF).collect())
    assert clean == Counter(r for r in rows if r[1] != item)
