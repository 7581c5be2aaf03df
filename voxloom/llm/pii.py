"""Personal data: patterns, and terms that disclose it by how the corpus uses them. DataFrame functions only.

A term discloses a protected entity (an address, number and so on that a pattern found) if knowing the term tells most
of what there is to know about the entity: pointwise mutual information PMI(t; e) = log2(df(t, e) N / (df(t) df(e))),
against the entity's information content IC(e) = log2(N / df(e)). PMI reaches IC exactly when the term never occurs
without the entity. Terms that stand in ``MIN_SUPPORT`` texts or more together with an entity, with PMI >= ``DISCLOSURE``
* IC, are disclosed: wherever they stand, in any document, they become spans of kind ``term``. All frequencies count every
document, and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.spans import found, is_kind, placed, redacted, small, sql_spans, tagged, with_replaced, written
from voxloom.scratch import saved

# The base patterns. Possessive quantifiers and the look-behinds change no match; they keep a run that
# doesn't match from being tried again from each of its characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}+"
KINDS = ("email", "ip", "card", "phone")

DISCLOSURE = 0.9
MIN_SUPPORT = 2
#: Entities of a text that all its terms meet at once, and entities that a task takes of one text.
DIRECT, PART = 256, 1000


def _is_ip(v: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(v, r"\."), small)


def _is_card(v: Column) -> Column:
    digits = F.reverse(F.regexp_replace(v, "[^0-9]", ""))

    def luhn(at: Column) -> Column:
        d = F.substr(digits, at, F.lit(1)).cast("int")
        return F.when(at % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, at: acc + luhn(at))
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def _is_phone(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)


_RULES = {"email": (EMAIL, None), "ip": (IP, _is_ip), "card": (CARD, _is_card), "phone": (PHONE, _is_phone)}


def base_spans(docs: DataFrame, text_col: str = "text", out: str = "base") -> DataFrame:
    """Adds ``out``: the pattern spans (kind, start, end, value), by kind as in KINDS, then start. Null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.withColumns({f"_{k}": found(text, pattern) for k, (pattern, _) in _RULES.items()})
    spans = F.concat(*[tagged(placed(text, F.col(f"_{k}"), pattern, holds), k) for k, (pattern, holds) in _RULES.items()])
    return raw.withColumn(out, spans).drop(*[f"_{k}" for k in _RULES])


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(found(text, TERM)), F.lower))


def _masked(text: Column, base: Column) -> Column:
    """The text with its pattern spans blanked out; all places stay."""
    return redacted(text, F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.repeat(F.lit(" "), (b["end"] - b["start"]).cast("int")).alias("mark"))))


def _frequency(weight: Column) -> list[Column]:
    """``df``, and sums of hashes of the documents: equal for two values only if the same documents hold them."""
    prints = [F.sum(weight * F.pmod(F.xxhash64(F.lit(k), "h"), F.lit(1 << 29))).alias(f"sum{k}") for k in range(3)]
    return [F.sum(weight).alias("df"), *prints]


def _class(name: str) -> Column:
    return F.xxhash64("df", "sum0", "sum1", "sum2").alias(name)


def _together(near: DataFrame, told: DataFrame, reach: Callable[[Column], Column], share: float) -> DataFrame:
    """(entity_class, term_class, df_entity, df_term, df_both): how many documents hold both, for all pairs that can pass.

    ``near``: h, n, load, term_class, df_term; ``told``: h, load, entity_class, df_entity; ``load``: the entity classes of
    text h; ``share``: the least part of a term's documents that must hold an entity for the term to disclose it.

    Terms meet the entities of a text directly if there are up to ``DIRECT`` of them. Documents of more are put off, the
    heaviest first, up to half of the ``need`` documents that a term must share with an entity: the entity is then in the
    other half, the pair is met there, and counted in the documents put off afterwards. Pairs that can't come to ``need``
    aren't, nor are terms that fewer documents with entities hold. A product is left only for terms most of whose documents
    are heavy; it goes in parts of ``PART`` entities.
    """
    pair = ["entity_class", "term_class", "df_entity", "df_term"]
    parts = F.ceil(F.col("load") / PART).cast("int")

    def met(rows: DataFrame) -> DataFrame:
        a = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("load")
        b = told.select("h", "entity_class", "df_entity", F.pmod(F.xxhash64("entity_class"), parts).cast("int").alias("part"))
        return a.join(b, ["h", "part"]).where(F.col("df_term") <= reach(F.col("df_entity"))).groupBy(*pair).agg(F.sum("n").alias("df_both"))

    if near.where(F.col("load") > DIRECT).isEmpty():
        return met(near)
    near = near.withColumn("level", F.greatest(F.ceil(F.log2(F.col("load") / DIRECT)), F.lit(0)).cast("int"))
    term = Window.partitionBy("term_class")  # a row for each doubling of the load
    levels = near.groupBy("term_class", "df_term", "level").agg(F.sum("n").alias("k")).withColumn("held", F.sum("k").over(term))
    levels = levels.withColumn("need", F.greatest(F.lit(MIN_SUPPORT), F.ceil(F.col("df_term") * (share * (1 - 1e-9))))).where(F.col("held") >= F.col("need"))
    above = F.sum("k").over(term.orderBy(F.desc("level")))
    levels = saved(levels.withColumn("late", (F.col("level") > 0) & (above <= F.floor(F.col("need") / 2))), "levels")
    rows = saved(near.join(levels.select("term_class", "level", "late"), ["term_class", "level"]).drop("level"), "rows")
    first = saved(met(rows.where(~F.col("late"))), "first")
    left = levels.where("late").groupBy("term_class").agg((F.max("need") - F.sum("k")).alias("least"))
    open_pairs = first.join(left, "term_class").where(F.col("df_both") >= F.col("least")).select(*pair)
    later = rows.where("late").select("h", "n", "term_class").join(open_pairs, "term_class").join(told.select("h", "entity_class"), ["h", "entity_class"])
    return first.unionByName(later.groupBy(*pair).agg(F.sum("n").alias("df_both"))).groupBy(*pair).agg(F.sum("df_both").alias("df_both"))


def disclosed(seen: DataFrame, rows: DataFrame, disclosure: float) -> DataFrame:
    """(low): the terms that disclose an entity. ``seen``: h, base, terms, added, hidden; ``rows``: text.

    Entities, and terms, that the same documents hold have the same frequencies and are compared once: what is joined
    within a text are classes, and texts with very many entities meet only what can pass (``_together``). Only entities that
    ``MIN_SUPPORT`` documents hold, and terms that aren't too frequent for any PMI to reach the threshold
    (df(t) <= df(e) ** d * N ** (1 - d) for threshold d), are looked at; this loses none.
    """
    one = F.lit(1).cast("long")
    n_docs = seen.count()
    holders = saved(seen.where(F.size("base") > 0).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"), F.first(F.array_distinct(F.transform("base", lambda b: b["value"]))).alias("entities")), "holders")
    entities = saved(holders.select("h", "n", F.explode("entities").alias("entity")).groupBy("entity").agg(*_frequency(F.col("n"))).where((F.col("df") >= MIN_SUPPORT) & (F.col("df") < n_docs)).select("entity", F.col("df").alias("df_entity"), _class("entity_class")), "entities")
    told = saved(holders.select("h", "n", F.explode("entities").alias("entity")).join(small(entities), "entity").select("h", "n", "entity_class", "df_entity").distinct(), "told")
    most = entities.agg(F.max("df_entity")).first()[0]
    if most is None:
        return rows.sparkSession.createDataFrame([], "low string")
    reach = lambda df: F.pow(df.cast("double"), F.lit(disclosure)) * n_docs ** (1 - disclosure) * (1 + 1e-9)
    counted = rows.select(F.xxhash64("text").alias("h"), F.explode(terms_of(F.col("text"))).alias("low"), one.alias("n"))
    changed = [seen.where(F.size(c) > 0).select("h", F.explode(c).alias("low"), (one * sign).alias("n")) for c, sign in (("added", 1), ("hidden", -1))]
    terms = counted.unionByName(changed[0]).unionByName(changed[1]).groupBy("low").agg(*_frequency(F.col("n")))
    terms = saved(terms.where((F.col("df") >= MIN_SUPPORT) & (F.col("df") <= reach(F.lit(most)))).select("low", F.col("df").alias("df_term"), _class("term_class")), "terms")
    loads = small(saved(told.groupBy("h").agg(F.count(F.lit(1)).alias("load")), "loads"))
    near = saved(holders.join(loads, "h").select("h", "n", "load", F.explode("terms").alias("low")).join(terms, "low").select("h", "n", "load", "term_class", "df_term").distinct(), "near")
    least = entities.agg(F.min("df_entity")).first()[0]
    both = _together(near, told.drop("n").join(loads, "h"), reach, (least / n_docs) ** (1 - disclosure))
    pmi = F.log2(F.col("df_both").cast("double") * n_docs / (F.col("df_term").cast("double") * F.col("df_entity")))
    strong = both.where((F.col("df_both") >= MIN_SUPPORT) & (pmi >= disclosure * F.log2(n_docs / F.col("df_entity"))))
    return terms.join(strong.select("term_class").distinct(), "term_class", "left_semi").select("low")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """Every row's (id_col, h, base, terms): a hash of the text, spans of the patterns, and spans (start, end) of
    disclosing terms.

    Null and empty texts have no spans. Rows with equal id and text are counted each and come out alike; a null id is a
    value like any other. Terms are looked for in what the patterns' spans leave of a text. Very long texts, and texts
    with very many spans, are searched whole. Empty tables give empty results; other columns, whatever their names, don't
    matter. Disclosing terms are marked at all their places in all texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    some = F.size("base") > 0
    based = base_spans(rows).withColumn("left", F.when(some, terms_of(_masked(F.col("text"), F.col("base"))))).withColumn("all", F.when(some, terms_of(F.col("text"))))
    seen = saved(based.select("id", F.xxhash64("text").alias("h"), "base", F.col("left").alias("terms"), F.array_except("left", "all").alias("added"), F.array_except("all", "left").alias("hidden")), "pii")
    told = small(saved(disclosed(seen, rows, disclosure), "disclosed"))

    words = rows.select("id", F.xxhash64("text").alias("h"), F.explode(terms_of(F.col("text"))).alias("low"))
    extra = seen.where(F.size("added") > 0).select("id", "h", F.explode("added").alias("low"))
    hits = saved(words.unionByName(extra).join(told, "low", "left_semi").select("id", "h").distinct(), "hits")
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    texts = base_spans(rows.withColumn("h", F.xxhash64("text")).alias("r").join(small(hits).alias("t"), same("r", "t"), "left_semi"))
    places = texts.withColumn("text", _masked(F.col("text"), F.col("base"))).withColumn("words", found(F.col("text"), TERM))
    places = places.select("id", "h", F.explode(placed(F.col("text"), F.col("words"), TERM)).alias("t")).select("id", "h", "t.start", "t.end", F.lower("t.value").alias("low")).join(told, "low", "left_semi")
    terms = places.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    both = seen.alias("s").join(terms.alias("t"), same("s", "t"), "left")
    return both.select(F.col("s.id").alias(id_col), "s.h", "s.base", F.coalesce("t.terms", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("terms"))


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, digest and span list of ``sanitised``'s rows."""
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base, terms = written(F.col("base")), written(tagged_terms(F.col("terms")))
    return spans.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"))


def tagged_terms(terms: Column) -> Column:
    return F.transform(terms, lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with what the patterns found generalised to its kind (``[email]`` and so on) and disclosing terms to
    ``[term]``; where spans of several kinds overlap, the first one's mark stands for them all.

    All rows and columns stay; texts without personal data are untouched, null stays null.
    """
    marked = lambda s, mark: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark.alias("mark"))
    kinds = F.transform("base", lambda s: marked(s, F.concat(F.lit("["), s["kind"], F.lit("]"))))
    terms = F.transform("terms", lambda s: marked(s, F.lit("[term]")))
    found = sanitised(docs, id_col, text_col, disclosure).select(id_col, "h", F.concat(kinds, terms).alias("spans"))
    return with_replaced(docs, found, id_col, text_col, length_col)


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT ELSE reverse({_DIGITS})[i]::INT * 2 - CASE WHEN reverse({_DIGITS})[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"regexp_full_match(v, '0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}')"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN len({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15"),
}

#: The digest's rows in DuckDB's SQL, pair by pair of entity and term.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{sql_spans(_SQL_KINDS)},
held AS (SELECT doc_id, list({{'s': s, 'e': e}}) AS base FROM spans GROUP BY doc_id),
left_over AS (SELECT d.doc_id, CASE WHEN base IS NULL THEN text ELSE array_to_string(list_transform(string_split(text, ''), lambda c, i: CASE WHEN len(list_filter(base, lambda b: b.s < i AND i <= b.e)) > 0 THEN ' ' ELSE c END), '') END AS text
              FROM d LEFT JOIN held USING (doc_id)),
terms AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '\p{{L}}{{3,}}'))) AS term FROM left_over),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
entity AS (SELECT DISTINCT doc_id, v FROM spans),
df_t AS (SELECT term, count(*) AS c FROM terms GROUP BY term), df_e AS (SELECT v, count(*) AS c FROM entity GROUP BY v HAVING count(*) >= {MIN_SUPPORT}),
pair AS (SELECT term, v, count(*) AS c FROM terms JOIN (SELECT * FROM entity SEMI JOIN df_e USING (v)) USING (doc_id) GROUP BY term, v HAVING count(*) >= {MIN_SUPPORT}),
disclosed AS (SELECT DISTINCT pair.term FROM pair JOIN df_t USING (term) JOIN df_e USING (v), n
              WHERE df_e.c < n AND log2(pair.c * n / (df_t.c::DOUBLE * df_e.c)) >= {DISCLOSURE} * log2(n / df_e.c)),
hit AS (SELECT doc_id, text FROM left_over WHERE doc_id IN (SELECT doc_id FROM terms SEMI JOIN disclosed USING (term))),
w AS (SELECT doc_id, regexp_extract_all(text, '\p{{L}}{{3,}}') AS m, string_split_regex(text, '\p{{L}}{{3,}}') AS p FROM hit),
word AS (SELECT doc_id, m[i] AS v, (coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: len(x))), 0))::BIGINT AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM w)),
told AS (SELECT doc_id, 4 AS rank, 'term' AS kind, e - len(v) AS s, e FROM word WHERE lower(v) IN (SELECT term FROM disclosed)),
every AS (SELECT doc_id, rank, kind, s, e FROM spans UNION ALL SELECT * FROM told),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) FILTER (kind <> 'term') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
