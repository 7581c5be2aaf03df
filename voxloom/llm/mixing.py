"""Mixing sources to target weights. DataFrame functions only.

Every source gets a share of all words by its weight, at most ``MOST`` times its own size; what a source can't take is
shared again by weight. Each document has a random but repeatable key (the MD5 of its id and text, so that
rows without an id, or with the same one, lie apart). Rows that repeat are one row with a count until the end. A source's
rows are cut into
key ranges of about ``RANGE_ROWS`` rows; sums of the ranges give each range's place in its source, and a running sum
inside the range gives each row's. No task sorts more than a few ranges, however large a source is. A source takes its
rows in key order, again from the start if it has to, until its budget is met to the word: the last row is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.scratch import saved

WEIGHTS = (5, 2, 1)
MOST = 3
RANGE_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) per source to (sid, source, size, rows, target): shares by weight with a cap, filled like water.

    Sources go by code point, null last. Sorted by cap over weight, the sources that reach their cap are the first ones:
    each is capped if its cap is at most its share of what the ones before it have left. The rest share by weight. The
    table has a row per source; its windows run over that table alone.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    sized = sources.withColumn("sid", F.row_number().over(by_name))
    sized = sized.withColumn("weight", F.element_at(cycle, F.expr(f"(sid - 1) % {len(weights)} + 1"))).withColumn("cap", F.col("size") * most)
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sized.withColumns({
        "rank": F.row_number().over(filling),
        "left_words": F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    fits = F.col("cap").cast("double") * F.col("left_weight") <= F.col("weight").cast("double") * F.col("left_words")
    free = F.min(F.when(~fits, F.col("rank"))).over(everything)
    level = F.min_by(F.col("left_words") / F.col("left_weight"), F.when(~fits, F.col("rank"))).over(everything)
    target = F.when(F.coalesce(F.col("rank") < free, F.lit(True)), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return ranked.select("sid", "source", F.col("size").alias("source_size"), "rows", target.alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Every row's (id_col, source, size, source_size, target, taken).

    Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own. Rows with equal keys go
    by id, then size; repeated rows stand for themselves. Reruns agree. An empty table gives an empty result.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    hashed = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), hashed).cast("binary"))
    rows = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")).groupBy("id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    goals = saved(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count(F.lit(1)).alias("rows")), weights, most), "targets")
    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = rows.join(goals.select("sid", F.col("source").alias("_source"), "rows"), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("range", F.floor(first * F.ceil(F.col("rows") / RANGE_ROWS) / F.lit(2.0**32))).select("id", "sid", "size", "copies", "key", "range")
    sums = placed.groupBy("sid", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    earlier = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    each = running.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("inside", F.col("inside") + F.col("nth") * F.col("size"))
    joined = each.join(offsets, ["sid", "range"]).join(goals, "sid")
    budget = F.round("target").cast("long")
    take = sum((F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - (F.col("source_size") * e + F.col("offset") + F.col("inside")))) for e in range(most)), F.lit(0).cast("long"))
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", take.alias("taken"))


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
r AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / weight, sid) AS rank,
             (sum(source_size) OVER ())::DOUBLE - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw,
             (sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lg FROM w),
f AS (SELECT *, cap::DOUBLE * lg <= weight::DOUBLE * lw AS fits FROM r),
g AS (SELECT *, min(rank) FILTER (NOT fits) OVER () AS free, arg_min(lw / lg, rank) FILTER (NOT fits) OVER () AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN coalesce(rank < free, true) THEN cap::DOUBLE ELSE weight * level END AS target FROM g),
p AS (SELECT d.*, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (greatest(0, least(size, round(target) - b)) + greatest(0, least(size, round(target) - source_size - b))
        + greatest(0, least(size, round(target) - 2 * source_size - b)))::BIGINT AS taken FROM p
"""
