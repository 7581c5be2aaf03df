"""The corpus pipeline: toxic documents go, one document of each group of near-duplicates stays, documents with benchmark
passages go, secrets are replaced, and what is left is mixed to target weights.

Every stage reads what the one before it wrote. All but the last return the columns of ``documents``; columns beyond those
pass through, whatever their names. A decision names a row by its id and a hash of its text, null ids included, so rows that
share an id but not a text are judged apart. Null and empty texts are like any other; texts are read whole; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontaminate, minhash, mixing, secrets, toxicity
from voxloom.scratch import saved

#: Rows that are named in a broadcast; more are named by a join that shuffles.
BROADCAST_ROWS = 1_000_000


def _named(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` that are (left_semi) or aren't (left_anti) in ``rows`` (_id, _h)."""
    rows = saved(rows.distinct(), "rows")
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    own = F.xxhash64(F.coalesce(F.col("_d.text"), F.lit("")))
    return docs.alias("_d").join(rows.alias("_r"), F.col("_d.doc_id").eqNullSafe(F.col("_r._id")) & (own == F.col("_r._h")), how).select("_d.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go, repeated rows alike. A row without an id is judged by its text too."""
    judged = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), text_hash=True)
    return _named(docs, judged.where("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays, once: of rows that repeat its id and text
    the first in the order of the other columns. Null ids come last; a class without any id keeps one row."""
    found = saved(minhash.near_duplicates(docs, text_hash=True).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "first"), "found")
    kept = _named(docs, found.where("not first").select("_id", "_h"), "left_anti")
    again = found.where("first").groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id", "_h")
    again = saved(again, "again")
    if again.isEmpty():
        return kept
    rest = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    hit = _named(kept, again, "left_semi").select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_h"), rest.alias("_row"))
    first = hit.groupBy("doc_id", "_h").agg(F.min("_row").alias("_row")).select("_row.*")
    return _named(kept, again, "left_anti").unionByName(first)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a passage that is similar to one, go, repeated rows alike."""
    found = decontaminate.text_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _named(docs, found.select(F.col("id").alias("_id"), F.col("h").alias("_h")), "left_anti")


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets make way for a mark; ``n_chars`` follows. A document without secrets stays as it is."""
    return secrets.removed(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, and how many words it takes of each, repeats counted. Repeated rows are taken one after
    the other; a null source is a source; documents without words aren't taken."""
    return mixing.mixed(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("secrets", replace_secrets),
    ("mixing", mix_sources),
]

#: Toxicity and near-duplicates have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
