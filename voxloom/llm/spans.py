"""Where a pattern matches a text, and what texts look like without it: built-in functions only.

A text may have very many matches. Arrays are therefore never built up element by element over their whole length: they
are cut into about sqrt(n) blocks of sqrt(n) elements, so that n matches cost n ** 1.5 short steps at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.scratch import saved

SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
#: Rows that a join takes by a broadcast; more are taken by a join that shuffles.
BROADCAST_ROWS = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(values: Column) -> Column:
    """The elements of an array that isn't empty, in about sqrt(n) arrays."""
    size = F.ceil(F.sqrt(F.size(values))).cast("int")
    last = lambda s: F.floor((F.size(values) - 1) / s).cast("int")
    return let(size, lambda s: F.transform(F.sequence(F.lit(0), last(s)), lambda b: F.slice(values, b * s + 1, s)))


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The running sum (or other combination of numbers from 0 on) of an array of longs; element k counts values 0 to k."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def folded(array: Column, value: Callable[[Column], Column] = lambda x: x) -> Column:
        step = lambda acc, x: let(combine(acc["at"], value(x)), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))
        return F.aggregate(array, start, step)

    def joined(parts: Column) -> Column:
        ahead = F.concat(F.array(F.lit(0).cast("long")), folded(parts, lambda p: p["at"])["out"])
        return let(ahead, lambda a: F.flatten(F.transform(parts, lambda p, k: F.transform(p["out"], lambda y: combine(F.get(a, k), y)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(F.transform(_blocks(v), lambda b: folded(b)), joined)).otherwise(none))


def found(text: Column, pattern: str | Column) -> Column:
    """All leftmost, non-overlapping matches, as strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(text: Column, matches: Column, pattern: str | Column, holds: Callable[[Column], Column] | None = None) -> Column:
    """The spans of those ``matches`` (what ``found`` gave for the same text and pattern) for which ``holds``.

    Splitting at the pattern leaves the pieces between matches; the lengths of pieces and matches in turn add up to each
    match's place. Texts in which no match holds, which is nearly all of them, aren't split.
    """
    pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("piece"), matches.alias("match"))
    lengths = F.flatten(F.transform(pieces, lambda x: F.array(F.length(x["piece"]).cast("long"), F.length(x["match"]).cast("long"))))
    span = lambda at, m, k: F.struct(F.get(at, 2 * k).alias("start"), F.get(at, 2 * k + 1).alias("end"), m.alias("value"))
    spans = let(running(lengths), lambda at: F.transform(matches, lambda m, k: span(at, m, k)))
    some = F.size(matches) > 0 if holds is None else F.exists(matches, holds)
    kept = spans if holds is None else F.filter(spans, lambda s: holds(s["value"]))
    return F.when(some, kept).otherwise(F.array().cast(SPAN))


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``."""
    ordered = F.array_sort(F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"))))
    told = lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("low"), F.array_max(F.transform(b, lambda o: o["end"])).alias("high"), b.alias("spans"))
    meets = lambda s: lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"])
    free = lambda s, bs: ~F.exists(bs, lambda b: (b["low"] < s["end"]) & (b["high"] > s["start"]) & F.exists(b["spans"], meets(s)))
    rest = let(ordered, lambda v: let(F.transform(_blocks(v), told), lambda bs: F.filter(spans, lambda s: free(s, bs))))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), rest).otherwise(spans)


def tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span (start, end, mark) replaced by its mark; of spans that overlap the first one's mark stays."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["mark"].alias("mark"))))
    cut = lambda t, low, high: F.substr(t, (low + 1).cast("int"), (high - low).cast("int"))

    def pieces(block: Column) -> Column:
        """What lies before each span of a block, and its mark; the block's own part of the text is cut out first."""
        begin, end = F.get(block, F.lit(0))["at"], F.element_at(block, F.lit(-1))["start"]
        return let(cut(text, begin, end), lambda t: F.flatten(F.transform(block, lambda s: F.array(cut(t, s["at"] - begin, s["start"] - begin), s["mark"]))))

    def replaced(v: Column) -> Column:
        ends = running(F.transform(v, lambda s: s["end"]), F.greatest)
        at = lambda e, k: F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(0).cast("long"))
        free = lambda e: F.filter(F.transform(v, lambda s, k: F.struct(at(e, k).alias("at"), s["start"].alias("start"), s["mark"].alias("mark"))), lambda s: s["start"] >= s["at"])
        whole = lambda e: F.concat(F.array_join(let(free(e), lambda f: F.flatten(F.transform(_blocks(f), pieces))), ""), F.substr(text, (F.element_at(e, F.lit(-1)) + 1).cast("int")))
        return let(ends, whole)

    return F.when(F.size(spans) > 0, let(ordered, replaced)).otherwise(text)


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_replaced(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, length_col: str | None = None) -> DataFrame:
    """``docs`` with the spans of ``found`` (id_col, h, spans) replaced by their marks.

    Rows are matched by id and by the hash h of their text; all rows and columns stay, and rows without spans are
    untouched. Where a text changes, ``length_col`` (if given) becomes its new length. Spark broadcasts the rows with
    spans only if it finds them small.
    """
    own = "_" * (1 + max(map(len, docs.columns)))  # no column of docs begins like this
    places = saved(found.where(F.size("spans") > 0).select(F.col(id_col).alias(f"{own}id"), F.col("h").alias(f"{own}h"), F.col("spans").alias(f"{own}spans")).dropDuplicates([f"{own}id", f"{own}h"]), "places")
    joined = docs.join(places, F.col(id_col).eqNullSafe(F.col(f"{own}id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(f"{own}h")), "left")
    hit = F.col(f"{own}spans").isNotNull()
    cleaned = joined.withColumn(f"{own}clean", F.when(hit, redacted(F.col(text_col), F.col(f"{own}spans"))).otherwise(F.col(text_col)))
    new = {text_col: F.col(f"{own}clean")}
    if length_col:
        new[length_col] = F.when(hit, F.length(f"{own}clean").cast("long")).otherwise(F.col(length_col))
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def sql_spans(kinds: dict[str, tuple[str, str]], source: str = "d") -> str:
    """DuckDB's SQL for spans: CTE ``spans`` (doc_id, rank, kind, s, e, v) of all matches for which a condition on v holds.

    ``kinds``: kind to (pattern, condition); ``source``: a CTE with doc_id and text.
    """
    each = [
        f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM {source}"
        for rank, (kind, (pattern, _)) in enumerate(kinds.items())
    ]
    holds = " ".join(f"WHEN '{kind}' THEN {condition}" for kind, (_, condition) in kinds.items())
    ends = "coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: len(x))), 0)"
    return f"""matches AS ({" UNION ALL ".join(each)}),
found AS (SELECT doc_id, rank, kind, m[i] AS v, ({ends})::BIGINT AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matches WHERE len(m) > 0)),
spans AS (SELECT doc_id, rank, kind, e - len(v) AS s, e, v FROM found WHERE CASE kind {holds} END)"""
