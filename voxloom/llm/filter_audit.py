"""Filter interactions: what each of five filters removes at each step of each order, without running the 120 orders.

The orders are paths through a lattice: its nodes are the sets of filters that were applied, its 80 edges (set, next
filter). ``failures`` gives a document the set of filters that it fails; documents are summed up by part, set of failures
and labels before anything is shuffled on them, at most 32 sets a part. Each set contributes to the 80 edges, and the edges
are joined to the 600 steps of the orders. DataFrame functions only.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.scratch import saved

WORD_GAPS = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 65, 5
# The symbols of filter D.
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"
#: Labels are broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def failures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and ``_mask``: 1 for A, 2 for B, 4 for C, 8 for D, added up, of the filters that the text fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAPS), "")
    counted = docs.select("*", F.struct(F.size(words).cast("long").alias("words"), F.size(F.array_distinct(words)).cast("long").alias("distinct"), F.char_length(text).cast("long").alias("chars"), F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")).cast("long").alias("rest"), text.rlike(SYMBOLS).alias("symbol")).alias("_n"))
    fails = [F.col("_n.words") < LEAST_WORDS, 100 * F.col("_n.distinct") < LEAST_DISTINCT_PERCENT * F.col("_n.words"), 100 * (F.col("_n.chars") - F.col("_n.rest")) > MOST_CAPITALS_PERCENT * F.col("_n.chars"), F.col("_n.symbol")]
    return counted.withColumn("_mask", sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))).drop("_n")


def patterns(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, good, toxic, n): the documents of each part by the filters they fail and their labels.

    A text that repeats is found by its hash alone. Of each text the rows of the least id don't fail E; those are counted
    per text and taken from the rest, so no row has to meet the others of its text.
    """
    known = saved(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).where("good or toxic"), "known")
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = failures(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))).select("id", "part", "_mask", F.sha2("text", 256).alias("sha"))
    flags = ["part", "mask", "good", "toxic"]
    told = small.join(side, F.col("id") == F.col("_id"), "left").select("id", "sha", "part", F.col("_mask").alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    rows = saved(told.groupBy("id", "sha", *flags).agg(F.count(F.lit(1)).alias("n")), "flags")
    alike = rows.where("id is not null").groupBy("sha", "id").agg(F.collect_list(F.struct(*flags, "n")).alias("own"))
    first = alike.groupBy("sha").agg(F.min(F.struct("id", "own")).alias("least")).select(F.inline("least.own"))
    free = first.unionByName(rows.where("id is null").select(*flags, "n")).groupBy(*flags).agg(F.sum("n").alias("free"))
    every = rows.groupBy(*flags).agg(F.sum("n").alias("all"))
    split = every.join(free, flags, "left").select(*flags, F.coalesce("free", F.lit(0)).alias("free"), (F.col("all") - F.coalesce("free", F.lit(0))).alias("again"))
    by_mask = split.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask").alias("mask"), F.col("free").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("again").alias("n")))))
    return by_mask.where("n > 0").groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n"))


def edges() -> list[tuple[int, int, int, bool, bool, int]]:
    """(mask, set of filters already applied, next filter, whether documents of this mask fail the next filter, whether an
    applied one removed them, number of orders that take this edge): 80 edges for each of 32 masks."""
    k = len(FILTERS)
    lattice = [(done, f, math.factorial(done.bit_count()) * math.factorial(k - 1 - done.bit_count())) for done in range(1 << k) for f in range(k) if not done >> f & 1]
    return [(mask, done, f, bool(mask >> f & 1), bool(mask & done), orders) for mask in range(1 << k) for done, f, orders in lattice]


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, set of filters already applied, next filter) of every step of every order."""
    out = []
    for order in permutations(range(len(FILTERS))):
        done = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[x] for x in order), step, done, f))
            done |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    Null and empty texts have no words, fail A and, if a smaller id has one too, E. A null part is the empty string. A null
    id is neither smaller than another nor has smaller ones, so its row never fails E and causes no failure. Of rows with
    one id and text none fails E by another. Labels that repeat count if one of them is 1. Texts of any length are read
    whole; an empty table gives an empty result; other columns, whatever their names, don't matter.
    """
    spark = docs.sparkSession
    sums = saved(patterns(docs, labels, id_col, text_col, part_col), "patterns")
    lattice = F.broadcast(spark.createDataFrame(edges(), "mask int, done int, next int, fails boolean, gone boolean, orders long"))
    paths = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, done int, next int"))
    total = lambda on, name: F.sum(F.when(on, F.col("n")).otherwise(0)).alias(name)
    removed = ~F.col("gone") & F.col("fails")
    only = F.col("fails") & (F.bit_count("mask") == 1)
    sums_of = [total(~F.col("gone") & ~F.col("fails"), "kept"), total(removed, "removed"), total(F.col("gone") & F.col("fails"), "redundant"), total(only, "unique_fails"), total(removed & F.col("good"), "good_lost"), total(removed & F.col("toxic"), "toxic_lost")]
    at = sums.join(lattice, "mask").groupBy("part", "done", "next").agg(*sums_of, F.max("orders").alias("orders"))
    at = saved(at, "edges")
    share = at.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return at.join(share, ["part", "next"]).join(paths, ["done", "next"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same rows in DuckDB's SQL: every order is run by itself over the sums of documents.
SQL = rf"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT part, x, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < {LEAST_WORDS} AS A, 100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words) AS B,
  100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > {MOST_CAPITALS_PERCENT} * length(x) AS C, regexp_matches(x, '{SYMBOLS}') AS D, doc_id > min(doc_id) OVER (PARTITION BY x) AS E FROM w LEFT JOIN l USING (doc_id)),
s AS (SELECT part, good, toxic, A::INT AS A, B::INT AS B, C::INT AS C, D::INT AS D, E::INT AS E, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
t AS (SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, A + B + C + D + E AS fails,
  CASE filter_order[step] WHEN 'A' THEN A WHEN 'B' THEN B WHEN 'C' THEN C WHEN 'D' THEN D ELSE E END AS hit,
  A * (strpos(filter_order, 'A') < step)::INT + B * (strpos(filter_order, 'B') < step)::INT + C * (strpos(filter_order, 'C') < step)::INT + D * (strpos(filter_order, 'D') < step)::INT + E * (strpos(filter_order, 'E') < step)::INT AS before FROM s, steps),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (before = 0 AND hit = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (before = 0 AND hit = 1), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (before > 0 AND hit = 1), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit = 1 AND fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n * good) FILTER (before = 0 AND hit = 1), 0)::BIGINT AS good_lost, coalesce(sum(n * toxic) FILTER (before = 0 AND hit = 1), 0)::BIGINT AS toxic_lost FROM t GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
