"""Secrets: patterns, and other credential-like strings judged by who owns them. DataFrame functions only.

Besides the patterns' spans, every long string that mixes letters and digits and has a key's shape is a candidate: it
isn't made of plain words and short numbers (as paths and slugs are), and its characters vary (``LEAST_ENTROPY`` bits
each). The hash of each is counted over the whole corpus by distinct repositories and owners. A string that many owners
hold, or a few owners in many repositories, is a widely copied example. One of a single owner, or of ``LIVE_OWNERS`` owners
or fewer in ``LIVE_REPOSITORIES`` repositories or fewer (a key that was handed on), looks live, and its places become spans
of kind ``live``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.spans import apart, found, placed, small, sql_spans, tagged, with_replaced, written
from voxloom.scratch import saved

# The base patterns.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
OTHER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
# Paths, slugs and names by their shape: every segment is a word, with or without a capital, or a short number.
WORDS = r"^[/_=+-]*+(?:(?:[A-Z]?+[a-z]++|[A-Z]++|[0-9]{1,4}+)(?:[/_=+-]++|$))++$"
KINDS = ("assign", "access", "hex")

LIVE_OWNERS, LIVE_REPOSITORIES = 2, 4
LEAST_ENTROPY = 3.0


def _value(v: Column) -> Column:
    return F.regexp_extract(v, ASSIGN_VALUE, 1)


def _entropy(v: Column) -> Column:
    """Bits a character, by how often the string has each."""
    share = lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / F.length(v)
    return -F.aggregate(F.array_distinct(F.split(v, "")), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def _is_other(v: Column) -> Column:
    return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(WORDS) & (_entropy(v) >= LEAST_ENTROPY)


_RULES = {
    "assign": (ASSIGN, lambda v: F.length(_value(v)) >= 6),
    "access": (ACCESS, lambda v: F.length(v) >= 20),
    "hex": (HEX, None),
    "other": (OTHER, _is_other),
}


def _all_spans(text: Column, docs: DataFrame) -> DataFrame:
    raw = docs.withColumns({f"_{k}": found(text, pattern) for k, (pattern, _) in _RULES.items()})
    return raw.withColumns({k: tagged(placed(text, F.col(f"_{k}"), pattern, holds), k) for k, (pattern, holds) in _RULES.items()})


def owned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """Every row's (id_col, h, spans, n_example, n_live, most_repositories): spans (start, rank, kind, end, live) of the
    patterns and of candidates of kind ``live``, by start and kind, and counts. h hashes the row's text.

    Null text is empty, and empty texts have no spans; texts of any length are searched whole. A null owner or repository
    is one owner or repository. Repeated rows come out alike, and count as one repository and owner. A candidate that
    overlaps a pattern's span is part of it and no span of its own. Empty tables give empty results; other columns,
    whatever their names, don't matter.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), name(owner_col).alias("owner"), F.concat_ws("\1", *[name(c) for c in repository_cols]).alias("repository"))
    spans = _all_spans(F.col("text"), rows).withColumn("base", F.concat(*KINDS))
    secret = lambda s: F.sha2(F.when(s["kind"] == "assign", _value(s["value"])).otherwise(s["value"]), 256)
    hashed = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), secret(s).alias("hash"))
    everything = F.concat("base", apart(F.col("other"), F.col("base")))
    seen = saved(spans.select("id", F.xxhash64("text").alias("h"), "owner", "repository", F.when(F.size("base") + F.size("other") > 0, F.transform(everything, hashed)).alias("found")), "secrets")
    held = seen.select("owner", "repository", F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash")).distinct()
    counts = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    live = (F.col("owners") == 1) | ((F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories))
    owners = small(saved(counts.select("hash", "repositories", live.alias("live")), "owners"))
    places = seen.select("id", "h", F.explode("found").alias("s")).select("id", "h", "s.*").distinct()
    rank = F.element_at(F.create_map(*[x for i, k in enumerate((*KINDS, "other")) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    kind = F.when(F.col("kind") == "other", "live").otherwise(F.col("kind"))
    is_span = (F.col("kind") != "other") | F.col("live")
    judged = places.join(owners, "hash").groupBy("id", "h").agg(
        F.array_sort(F.collect_list(F.when(is_span, F.struct("start", rank.alias("rank"), kind.alias("kind"), "end", "live")))).alias("spans"),
        F.sum(F.when(F.col("live"), 0).otherwise(1)).alias("n_example"), F.sum(F.when(F.col("live"), 1).otherwise(0)).alias("n_live"), F.max("repositories").alias("most_repositories"),
    )
    both = seen.alias("s").join(judged.alias("t"), F.col("s.id").eqNullSafe(F.col("t.id")) & (F.col("s.h") == F.col("t.h")), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,live:boolean>>")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return both.select(F.col("s.id").alias(id_col), "s.h", F.coalesce("t.spans", none).alias("spans"), zero("n_example"), zero("n_live"), zero("most_repositories"))


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, digest and span list of ``owned``'s rows."""
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    base = F.filter("spans", lambda s: s["kind"] != "live")
    return spans.select(id_col, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "n_live", "n_example", "most_repositories")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **columns) -> DataFrame:
    """``docs`` with every secret replaced: ``[secret]``, or ``[example]`` where it is a widely copied example.

    All columns and rows stay; rows without a secret are untouched, null stays null. Where a text changes, ``length_col``
    (if given) becomes its new length.
    """
    marked = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["live"], "[secret]").otherwise("[example]").alias("mark"))
    return with_replaced(docs, owned(docs, id_col, text_col, **columns).select(id_col, "h", F.transform("spans", marked).alias("spans")), id_col, text_col, length_col)


_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" for c in w).replace("[__]", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
_ASSIGNED = rf"""(?:{_KEYWORD})["'']?\x20*[:=]\x20*["'']?"""
_VALUE = f"regexp_replace(v, '^{_ASSIGNED}', '')"
_SEGMENTS = r"regexp_full_match(v, '[/_=+-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})[/_=+-]+)*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})[/_=+-]*')"
_ENTROPY_SQL = "-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (len(v) - len(replace(v, c, ''))) / len(v)::DOUBLE * log2((len(v) - len(replace(v, c, ''))) / len(v)::DOUBLE)))"
_SQL_KINDS = {
    "assign": (rf"{_ASSIGNED}[A-Za-z0-9+/_.=-]+", f"len({_VALUE}) >= 6"),
    "access": ("AKIA[A-Z0-9]+", "len(v) >= 20"),
    "hex": ("[0-9a-f]{24,}", "true"),
    "other": ("[A-Za-z0-9+/_=-]{20,}", f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT {_SEGMENTS} AND {_ENTROPY_SQL} >= {LEAST_ENTROPY}"),
}

#: The digest's rows in DuckDB's SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS owner, coalesce(source, chr(0)) || chr(1) || coalesce(lang, chr(0)) AS repository FROM documents),
{sql_spans(_SQL_KINDS)},
apart AS (SELECT * FROM spans x WHERE kind <> 'other' OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = x.doc_id AND b.kind <> 'other' AND b.s < x.e AND b.e > x.s)),
held AS (SELECT a.*, CASE WHEN kind = 'assign' THEN {_VALUE} ELSE v END AS secret, owner, repository FROM apart a JOIN d USING (doc_id)),
counted AS (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM held GROUP BY secret),
judged AS (SELECT held.*, repositories, owners = 1 OR (owners <= {LIVE_OWNERS} AND repositories <= {LIVE_REPOSITORIES}) AS live FROM held JOIN counted USING (secret)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'other') AS base,
             string_agg(CASE kind WHEN 'other' THEN 'live' ELSE kind END || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'other' OR live) AS spans,
             count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(repositories) AS most_repositories FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example, coalesce(most_repositories, 0)::BIGINT AS most_repositories FROM d LEFT JOIN g USING (doc_id)
"""
