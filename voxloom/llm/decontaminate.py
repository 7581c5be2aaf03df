"""Benchmark passages in documents: SimHash windows, block index, exact check. DataFrame functions only.

Windows are all item-sized runs of words of a text, but for those that can't be similar enough to any item of their
length. With n shingles in an item, a weighted Jaccard similarity of 0.8 takes 0.8 n common shingles or more, as the
union has n at least. A window has no more common shingles with an item than places whose shingle is one of any item of
that length. ``_starts`` therefore keeps every window that has ceil(0.8 n) such places or more; no other can reach 0.8.

Every kept window gets a SimHash of its words, 128 bits. Two fingerprints within ``RADIUS`` bits differ by three bits or
fewer in one of 8 blocks of 16 bits, as 8 x 4 - 1 = 31. Blocks are looked up with up to two bits turned on the item's side
and one on the window's, which finds every such pair; of random pairs about one in twelve meet.

A similar pair may still differ by more bits than that, about one in a thousand of the faintest. Of an item's n shingles a
similar window lacks n - ceil(0.8 n) at most, so it has one of any n - ceil(0.8 n) + 1 of them; ``rare_pairs`` looks up
those that the fewest items have, and what the index has missed is added. All pairs are then checked by the exact weighted
Jaccard similarity of their shingles, so that none of 0.8 or more is lost.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.spans import let, small
from voxloom.scratch import saved

SHINGLE = 5
SIMILARITY = 0.8
HALVES = 2
#: Words that differ between texts of similarity 0.8 turn about 17 of 128 bits at most, with a deviation of 4.
RADIUS = 31
BLOCK_BITS = 16
#: Shingles of the items, and probes of their fingerprints, that are broadcast; more are looked up by a join that shuffles.
BROADCAST_SHINGLES, BROADCAST_PROBES = 500_000, 1_000_000
GAP = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """A hash of each word of a text."""
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), ""), lambda w: F.xxhash64(w))


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """A hash for each run of ``size`` words."""
    one = lambda v, i: F.xxhash64(*[F.get(v, i + k) for k in range(size)])
    rolled = let(words, lambda v: F.when(F.size(v) >= size, F.transform(F.sequence(F.lit(0), F.size(v) - size), lambda i: one(v, i))))
    return F.coalesce(rolled, F.array().cast("array<bigint>"))


def numbered(hashes: Column) -> Column:
    """Distinct hashes: the second, third and so on of equal ones count as others, so that sets stand for multisets."""
    nth = lambda s: F.transform(s, lambda x, k: F.xxhash64(x, k + 1 - F.array_position(s, x)))
    return let(hashes, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.transform(v, lambda x: F.xxhash64(x, F.lit(0).cast("long")))).otherwise(let(F.array_sort(v), nth)))


def simhash(words: Column, most: int) -> Column:
    """Two longs; a bit is set if more than half of the words' hashes have it. A repeated word votes again; among an even
    number of words the one with the least hash does, so that there are no ties, which would favour one value.

    ``most`` is the largest number of words. The votes of 64 bits are counted at once, in binary: long j of the counters
    holds digit j of all 64 counts.
    """
    digits = (most + 1).bit_length()
    zero = F.lit(0).cast("long")

    def counted(votes: Column, half: int) -> Column:
        def add(acc: Column, word: Column) -> Column:
            carry, out = (word if half == 0 else F.xxhash64(word, F.lit(half))), []
            for j in range(digits):
                out.append(acc[f"d{j}"].bitwiseXOR(carry).alias(f"d{j}"))
                carry = acc[f"d{j}"].bitwiseAND(carry)
            return F.struct(*out)

        return F.aggregate(votes, F.struct(*[zero.alias(f"d{j}") for j in range(digits)]), add)

    def majority(c: Column, half_of: Column) -> Column:
        """Where the count reaches half_of + 1, digit by digit from the highest."""
        above, equal = zero, F.lit(-1).cast("long")
        for j in reversed(range(digits)):
            need = -F.shiftright(half_of + 1, j).bitwiseAND(F.lit(1)).cast("long")
            above = above.bitwiseOR(equal.bitwiseAND(c[f"d{j}"]).bitwiseAND(F.bitwise_not(need)))
            equal = equal.bitwiseAND(F.bitwise_not(c[f"d{j}"].bitwiseXOR(need)))
        return above.bitwiseOR(equal)

    half_of = lambda v: F.floor(F.size(v) / 2).cast("int")
    votes = F.when(F.size(words) % 2 == 0, F.concat(words, F.array(F.array_min(words)))).otherwise(words)
    return let(votes, lambda v: F.array(*[let(counted(v, h), lambda c: majority(c, half_of(v))) for h in range(HALVES)]))


def _shifted(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by)


def _probes(fingerprint: Column, turns: list[tuple[int, int]]) -> Column:
    """A number for each block, tier and content: all blocks with each choice of n bits turned, (tier, n) of ``turns``."""
    each = 64 // BLOCK_BITS
    block = lambda i: _shifted(F.get(fingerprint, F.floor(i / each).cast("int")), i % each * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    masks = F.array(*[F.lit(tier << BLOCK_BITS | sum(1 << b for b in some)) for tier, n in turns for some in combinations(range(BLOCK_BITS), n)])
    bases = F.transform(F.sequence(F.lit(0), F.lit(64 * HALVES // BLOCK_BITS - 1)), lambda i: i * F.lit(2 << BLOCK_BITS) + block(i))
    return F.flatten(F.transform(bases, lambda b: F.transform(masks, lambda m: b.bitwiseXOR(m))))


def window_probes(fingerprint: Column) -> Column:
    return _probes(fingerprint, [(0, 0), (1, 1)])


def item_probes(fingerprint: Column) -> Column:
    """Tier 0 meets blocks that differ by up to two bits; tier 1, with a bit turned on the other side, by three."""
    return _probes(fingerprint, [(0, 0), (0, 1), (0, 2), (1, 2)])


#: Blocks times choices of at most two bits, those of two bits twice.
PROBES_AN_ITEM = 64 * HALVES // BLOCK_BITS * (1 + BLOCK_BITS + BLOCK_BITS * (BLOCK_BITS - 1))


def needed(n: Column) -> Column:
    """How many of an item's n shingles a window must have to reach the similarity."""
    return F.ceil(n * SIMILARITY - 1e-9).cast("int")


def _starts(places: Column, length: Column, n_words: Column) -> Column:
    """The starts of all windows with ceil(0.8 n) of ``places`` or more, n = length - 4; a text shorter than that is one.

    For each run of so many places the windows that cover it and don't reach back to the place before are a range.
    """
    n = length - (SHINGLE - 1)
    need = needed(n)

    def window_starts(p: Column) -> Column:
        def covering(i: Column) -> Column:
            low = F.greatest(F.get(p, i + need - 1) - n + 1, F.when(i > 0, F.get(p, i - 1) + 1).otherwise(F.lit(-(1 << 30))), -n)
            return F.when(low <= F.get(p, i), F.sequence(low, F.get(p, i))).otherwise(F.array().cast("array<int>"))

        ranges = F.transform(F.sequence(F.lit(0), F.size(p) - need), covering)
        return F.array_distinct(F.transform(F.flatten(ranges), lambda s: F.greatest(F.least(s, n_words - length), F.lit(0))))

    return let(F.array_sort(places), lambda p: F.when(F.size(p) >= need, window_starts(p)).otherwise(F.array().cast("array<int>")))


def _fingerprinted(df: DataFrame, most: int) -> DataFrame:
    """Replaces ``words`` by their numbered shingles and fingerprint."""
    return df.withColumns({"shingles": numbered(shingles(F.col("words"))), "print": simhash(F.col("words"), most)}).drop("words")


def windows(rows: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(id, h, length, start, shingles, print) of the windows of ``rows`` (id, h, text) that may be similar to an item."""
    known = saved(items.select("length", F.explode(shingles(F.col("words"))).alias("shingle")).distinct().groupBy("shingle").agg(F.collect_set("length").alias("lengths")), "shingles")
    split = rows.select("id", "h", word_hashes(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    rolled = split.select("id", "h", "n_words", F.posexplode(shingles(F.col("words"))).alias("at", "shingle"))  # without the text or its words
    hits = rolled.join(F.broadcast(known) if known.count() <= BROADCAST_SHINGLES else known, "shingle").select("id", "h", "n_words", "at", F.explode("lengths").alias("length"))
    found = hits.groupBy("id", "h", "n_words", "length").agg(F.collect_set("at").alias("places")).select("id", "h", "length", _starts(F.col("places"), F.col("length"), F.col("n_words")).alias("starts"))
    found = small(saved(found.where(F.size("starts") > 0), "starts"))
    same = F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.h") == F.col("f.h"))
    texts = rows.alias("r").join(small(found.select("id", "h").distinct()).alias("f"), same, "left_semi").dropDuplicates(["id", "h"]).select("id", "h", word_hashes(F.col("text")).alias("words"))
    at = texts.alias("r").join(found.alias("f"), same).select("r.id", "r.h", "f.length", "r.words", "f.starts")
    cut = F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, F.col("length")).alias("words")))
    return _fingerprinted(at.select("id", "h", "length", F.explode(cut).alias("w")).select("id", "h", "length", "w.start", "w.words"), most)


def short_matches(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(id, h, item, start, similarity): items of fewer than five words, which are one shingle, wherever they stand."""
    short = saved(items.where(F.size("words") < SHINGLE).select("item", "length", F.xxhash64("length", "words").alias("key")), "short")
    lengths = [r.length for r in short.select("length").distinct().orderBy("length").collect()]  # 1 to 4
    cut = lambda n: lambda i: F.struct(i.alias("start"), F.xxhash64(F.lit(n), F.slice("words", i + 1, n)).alias("key"))
    rows = rows.select("id", "h", word_hashes(F.col("text")).alias("words"))
    runs = [F.transform(F.sequence(F.lit(0), F.size("words") - n), cut(n)) for n in lengths]
    runs = [F.when(F.size("words") >= n, r) for n, r in zip(lengths, runs, strict=True)]
    each = [rows.select("id", "h", F.explode(r).alias("w")).select("id", "h", "w.start", "w.key").join(small(short), "key").select("id", "h", "item", "start", F.lit(1.0).alias("similarity")) for r in runs]
    return reduce(DataFrame.unionByName, each) if each else rows.select("id", "h", F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.lit(0).alias("start"), F.lit(1.0).alias("similarity")).where("false")


def close_pairs(prints: DataFrame, index: DataFrame) -> DataFrame:
    """(id, h, start, length, item) of windows and items whose fingerprints differ by ``RADIUS`` bits or fewer."""
    left = prints.select("id", "h", "start", "length", "print", F.explode(window_probes(F.col("print"))).alias("probe"))
    right = index.select("item", "length", F.col("print").alias("item_print"), F.explode(item_probes(F.col("print"))).alias("probe"))
    right = F.broadcast(right) if index.count() * PROBES_AN_ITEM <= BROADCAST_PROBES else right.hint("merge")
    differ = [F.get("print", F.lit(h)).bitwiseXOR(F.get("item_print", F.lit(h))) for h in range(HALVES)]
    met = left.join(right, ["length", "probe"]).where(sum((F.bit_count(d) for d in differ[1:]), F.bit_count(differ[0])) <= RADIUS)
    number, each = F.shiftright("probe", BLOCK_BITS + 1), 64 // BLOCK_BITS
    in_block = F.bit_count(_shifted(F.when(number < each, differ[0]).otherwise(differ[1]), number % each * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))
    once = met.where((F.getbit("probe", F.lit(BLOCK_BITS)) == 0) | (in_block == 3))  # tier 1 repeats what tier 0 finds
    return once.select("id", "h", "start", "length", "item")


def rare_pairs(prints: DataFrame, index: DataFrame) -> DataFrame:
    """(id, h, start, length, item) of windows that have one of the n - ceil(0.8 n) + 1 rarest of an item's n shingles."""
    each = index.select("item", "length", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    items_with = each.groupBy("length", "shingle").agg(F.count(F.lit(1)).alias("items"))
    ordered = each.join(items_with, ["length", "shingle"]).groupBy("item", "length", "n").agg(F.array_sort(F.collect_list(F.struct("items", "shingle"))).alias("by"))
    rare = saved(ordered.select("item", "length", F.explode(F.slice("by", 1, F.col("n") - needed(F.col("n")) + 1)).alias("s")).select("item", "length", "s.shingle"), "rare")
    own = prints.select("id", "h", "start", "length", F.explode("shingles").alias("shingle"))
    return own.join(F.broadcast(rare) if rare.count() <= BROADCAST_SHINGLES else rare, ["length", "shingle"]).select("id", "h", "start", "length", "item")


def text_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, h, item, start, similarity): the best window of each text (h: its hash) and item."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    split = benchmark.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text_col)).alias("words"))
    items = saved(split.withColumn("length", F.size("words")).where("length > 0"), "items")
    most = items.agg(F.max("length")).first()[0] or 1
    full = items.where(F.col("length") >= SHINGLE)
    index = saved(_fingerprinted(full, most), "index")
    prints = saved(windows(rows, full, most), "windows")
    close = close_pairs(prints, index).unionByName(rare_pairs(prints, index)).distinct()
    same = F.col("c.id").eqNullSafe(F.col("w.id")) & (F.col("c.h") == F.col("w.h")) & (F.col("c.start") == F.col("w.start")) & (F.col("c.length") == F.col("w.length"))
    pairs = close.alias("c").join(prints.alias("w"), same).select("c.id", "c.h", "c.start", "c.item", "w.shingles").join(index.select("item", F.col("shingles").alias("item_shingles")), "item")
    common = F.size(F.array_intersect("shingles", "item_shingles"))
    scored = pairs.select("id", "h", "item", "start", (common / (F.size("shingles") + F.size("item_shingles") - common)).alias("similarity")).where(F.col("similarity") >= SIMILARITY)
    return _best(scored.unionByName(short_matches(rows, items)), ["id", "h", "item"])


def _best(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.max_by("start", F.struct("similarity", -F.col("start"))).alias("start"), F.max("similarity").alias("similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, start, similarity): for each document and item, the best window of similarity 0.8 or more.

    ``start`` counts words; of equally good windows the first counts. An item of one to four words is one shingle and
    matches where its words stand in a row. Null and empty texts and items have no windows, and a text shorter than an
    item is one window as a whole. Rows with a null id are reported under null; repeated rows, and texts that share an id,
    once. Items are expected to have ids of their own. Texts of any length are searched whole. Empty tables give empty
    results; other columns, whatever their names, don't matter.
    """
    found = _best(text_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col), ["id", "item"])
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "similarity")


#: The same rows in DuckDB's SQL: every window with a shingle of an item. Items are taken to have five words or more.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, k - 1 AS p, array_to_string(w[k : k + 4], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM d)),
its AS (SELECT item_id, len(w) AS n, array_to_string(w[k : k + 4], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM i)),
ic AS (SELECT item_id, n, x, count(*) AS c FROM its GROUP BY ALL),
hit AS (SELECT doc_id, ds.n AS words, ic.item_id, ic.n AS size, ic.x, ic.c, ds.p FROM ds JOIN ic USING (x)),
win AS (SELECT *, unnest(range(greatest(0, least(p - size + 5, words - size)), greatest(0, least(p, words - size)) + 1)) AS start FROM hit),
same AS (SELECT doc_id, item_id, words, size, start, x, least(count(*), c) AS c FROM win WHERE p BETWEEN start AND start + size - 5 GROUP BY doc_id, item_id, words, size, start, x, win.c),
sim AS (SELECT doc_id, item_id, start, sum(c)::DOUBLE / ((least(words, size) - 4) + (size - 4) - sum(c)::DOUBLE) AS similarity FROM same GROUP BY doc_id, item_id, words, size, start)
SELECT doc_id, item_id, arg_max(start, (similarity, -start))::INTEGER AS start, max(similarity) AS similarity FROM sim WHERE similarity >= {SIMILARITY} GROUP BY doc_id, item_id
"""
