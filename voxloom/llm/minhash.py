"""Near-duplicates: ProbMinHash signatures, banding, and an exact check of whole families.

1. ``sign`` gives every document a node (a hash of its set of shingles: equal sets are one node, so copies fold together
   before anything is compared) and, from ProbMinHash signatures, one key for each band: one signature with all weights
   1, whose registers agree as often as the verified similarity says, and, where shingles repeat, one weighted by count.
2. The nodes of a bucket (equal band keys) are tied to the bucket's smallest node: n - 1 edges, never all pairs.
   The components of these edges are families; two documents that share any bucket are in one family.
3. Within a family texts are compared exactly, on the shingles of their whole texts, in a task that keeps only the edges
   of a spanning forest. A family of more than ``BLOCK_ROWS`` texts or ``BLOCK_BYTES`` is cut into blocks: first every
   block is compared with the family's head, which is linear and settles a large group of copies of one text. Only the
   texts that aren't similar to the head are then compared with all others, each pair of blocks in a task of its own, so
   that no link is lost and no task's memory depends on the largest family.
4. Classes are the components of the exact edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.text import Texts, counted, filled, mix, slices
from voxloom.operators.components import components
from voxloom.scratch import saved

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 42, 6
BLOCK_ROWS, BLOCK_BYTES = 1000, 8 << 20


def probminhash(docs: np.ndarray, keys: np.ndarray, weights: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Signatures (n_docs, registers) of weighted sets, given as (text, key, weight) by text.

    Each key runs a Poisson process whose rate is its weight: arrivals come after exponential gaps, and every arrival
    picks a register at random. A register keeps the key that arrived first, so the chance that two signatures agree in
    it is the probability Jaccard of the two sets. A key stops as soon as its next arrival is later than what any
    register of its text holds (early termination). All keys of all texts take each step together.
    """
    first = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, np.uint64)
    sizes = np.bincount(docs, minlength=n_docs)
    alone = sizes[docs] == 1
    if alone.any():  # a single key fills every register
        owner.reshape(n_docs, registers)[docs[alone]] = keys[alone, None]
        docs, keys, weights = docs[~alone], keys[~alone], weights[~alone]
    late = np.full(n_docs, np.inf)
    gap, state, time = 1.0 / weights, keys, np.zeros(len(keys))
    while len(docs):
        state = mix(state)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * gap
        on = time < late[docs]
        docs, keys, gap, state, time = docs[on], keys[on], gap[on], state[on], time[on]
        place = docs * registers + (mix(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = time == first[place]
        owner[place[won]] = keys[won]
        touched = np.unique(docs)
        late[touched] = first.reshape(n_docs, registers)[touched].max(axis=1)
    return owner.reshape(n_docs, registers)


def _banded(signature: np.ndarray) -> np.ndarray:
    bands = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        bands = mix(bands ^ signature[:, k * BANDS : (k + 1) * BANDS])
    return mix(bands ^ np.arange(BANDS, dtype=np.uint64))


def _signed(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, bands, number of bands) of each text; bands in one row.

    Where no shingle repeats, the weighted signature is the plain one, so both kinds share their keys.
    """
    words = texts.words()
    docs, keys, counts = counted(*words.shingles(words.hashes(), SHINGLE))
    spread = mix(keys)
    node = np.zeros(texts.n, np.uint64)
    np.add.at(node, docs, spread)
    node = mix(node)
    repeats = np.zeros(texts.n, bool)
    repeats[docs[counts > 1]] = True
    on, place = repeats[docs], np.cumsum(repeats) - 1
    bands = np.zeros((texts.n, 2 * BANDS), np.uint64)
    bands[:, :BANDS] = _banded(probminhash(docs, keys, np.ones(len(keys)), texts.n, BANDS * ROWS))
    bands[repeats, BANDS:] = _banded(probminhash(place[docs[on]], keys[on], 1.0 + np.log(counts[on]), int(repeats.sum()), BANDS * ROWS))
    n_bands = np.where(words.counts > 0, np.where(repeats, 2 * BANDS, BANDS), 0)
    return node, bands[np.arange(2 * BANDS) < n_bands[:, None]], n_bands


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, text) to (id, h, node, bands); a text without words has no bands."""
    for batch in batches:
        column = filled(batch.column(2))
        for low, high in slices(column):
            node, bands, n_bands = _signed(Texts(column.slice(low, high - low)))
            ends = np.concatenate([[0], np.cumsum(n_bands)]).astype(np.int32)
            flat = pa.array(bands.view(np.int64))
            own = [batch.column(k).slice(low, high - low) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(node.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "h", "node", "bands"])


def linked(table: pa.Table) -> pa.Table:
    """The edges (a, b) of a spanning forest over all pairs of a task's texts that are similar enough.

    Columns node, text, side. With sides 0 and 1 in the table, only pairs across the sides count; pairs of one side are
    another task's. A text is compared with all those not reached yet, by counting common shingles in an index; a text
    that is reached need not be reached again, as only the components matter.
    """
    table = table.sort_by("node")
    nodes = table.column("node").to_numpy()
    keep = np.ones(len(nodes), bool)
    keep[1:] = nodes[1:] != nodes[:-1]  # repeated rows
    table, nodes = table.filter(pa.array(keep)), nodes[keep]
    column = filled(table.column("text"))
    side = table.column("side").to_numpy()
    found = []
    for low, high in slices(column):
        words = Texts(column.slice(low, high - low)).words()
        docs, keys, _ = counted(*words.shingles(words.hashes(), SHINGLE))
        found.append((docs + low, keys))
    docs, keys = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    n = len(nodes)
    sizes = np.bincount(docs, minlength=n)
    begin = np.searchsorted(docs, np.arange(n + 1))
    _, ids = np.unique(keys, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    postings, at = docs[order], np.searchsorted(ids[order], np.arange(ids.max(initial=-1) + 2))
    both = bool((side == 1).any())
    a, b = [], []
    waiting = np.ones(n, bool)
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        while queue and waiting.any():
            x = queue.pop()
            mine = ids[begin[x] : begin[x + 1]]
            lists = [postings[at[i] : at[i + 1]] for i in mine]
            common = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)
            near = waiting & (common >= SIMILARITY * (sizes[x] + sizes - common) - 1e-9)
            if both:
                near &= side != side[x]
            hits = np.flatnonzero(near)
            waiting[hits] = False
            a += [nodes[x]] * len(hits)
            b += nodes[hits].tolist()
            queue += hits.tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


TASK = ["kind", "label", "i", "j"]


def _blocks(texts: DataFrame) -> DataFrame:
    """(label, blocks, head) of each family."""
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES), F.lit(1)).cast("int")
    return texts.groupBy("label").agg(size.alias("blocks"), F.min("node").alias("head"))


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node", "label"), F.col(blocks)).cast("int")


def _each(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _task(kind: int, i: Column, j: Column, side: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), F.col("label"), i.alias("i"), j.alias("j"), F.col("node"), F.col("text"), side.alias("side")]


def _linked(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(*TASK).applyInArrow(lambda t: linked(t.select(["node", "text", "side"])), "a long, b long")


def _links(texts: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all similar pairs within a family; texts: label, node, text."""
    zero = F.lit(0)
    placed = texts.join(saved(_blocks(texts), "blocks"), "label").withColumn("block", _block("blocks"))
    found = _linked(placed.where("blocks = 1").select(*_task(0, zero, zero, zero)))
    large = saved(placed.where("blocks > 1"), "large")
    if large.isEmpty():
        return found
    heads = large.where("node = head").dropDuplicates(["node"])
    to_head = large.where("node <> head").select(*_task(1, F.col("block"), zero, zero)).unionByName(heads.withColumn("k", _each("blocks")).select(*_task(1, F.col("k"), zero, F.lit(1))))
    star = saved(_linked(to_head), "star")
    near = star.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("near", F.lit(True))
    told = saved(large.join(near, "node", "left").withColumn("near", F.coalesce("near", F.col("node") == F.col("head"))), "told")
    rest = told.where("not near")
    parts = saved(_blocks(rest).select("label", F.col("blocks").alias("parts")), "parts")
    rest = rest.join(parts, "label").withColumn("part", _block("parts"))
    core = told.where("near").join(parts, "label")
    other = rest.withColumn("k", _each("parts"))
    within = other.select(*_task(2, F.least("part", "k"), F.greatest("part", "k"), F.when(F.col("part") > F.col("k"), 1).otherwise(0)))
    across = rest.withColumn("k", _each("blocks")).select(*_task(3, F.col("part"), F.col("k"), zero)).unionByName(core.withColumn("k", _each("parts")).select(*_task(3, F.col("k"), F.col("block"), F.lit(1))))
    return found.unionByName(star).unionByName(_linked(within.unionByName(across)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """Every row's (id_col, class_id): the smallest id among the texts that a chain of similar texts connects to it; with
    ``text_hash`` also h, the hash of its text, and first, whether (id, h) is the least of its class (null ids last).

    Similar: the Jaccard similarity of the sets of five-word shingles is ``SIMILARITY`` or more; words are runs without
    white space, and a text of one to four words is one shingle. Null and empty texts have no words and form one class
    (they are equal). Rows with a null id compare like others and get their class's smallest id (null if none has one).
    Repeated rows come out as often as they came in; rows that share an id but not a text are judged each by its text.
    Texts of any length are compared whole. Empty tables give empty results; other columns, whatever their names, don't
    matter.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    signed = saved(pairs.mapInArrow(sign, "id long, h long, node long, bands array<long>"), "signed")
    buckets = signed.select("node", F.explode("bands").alias("bucket")).distinct()
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = buckets.join(heads, "bucket").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    # a node's heads are tied to the least of them, so that a large group has one edge a node and not one for each band
    heads_of = ties.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("heads"))
    least_head = F.col("heads")[0]
    families = components(heads_of.select(F.explode(F.transform(F.concat(F.array("a"), F.slice("heads", 2, 2 * BANDS)), lambda x: F.struct(x.alias("a"), least_head.alias("b")))).alias("e")).select("e.*").distinct())
    first = signed.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("r"))
    members = families.join(first, "node").select("node", "label", F.col("r.id").alias("_id"), F.col("r.h").alias("_h"))
    texts = pairs.join(members, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("label", "node", "text")
    classes = components(_links(saved(texts, "families")))
    ids = signed.select("id", "h", "node").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = saved(ids.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("r")), "classes")
    first = F.col("id").eqNullSafe(F.col("r.id")) & (F.col("h") == F.col("r.h"))
    more = [F.col("h"), first.alias("first")] if text_hash else []
    return ids.join(least, "label").select(F.col("id").alias(id_col), F.col("r.id").alias("class_id"), *more)


#: The same rows in DuckDB's SQL: all pairs that share a shingle, and the closure of the similar ones.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN ['none'] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))) END AS sh, len(w) = 0 AS none FROM d),
u AS (SELECT doc_id, none, len(sh) AS n, unnest(sh) AS x FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.none = b.none AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= {SIMILARITY} * (a.n + b.n - count(*)) - 1e-9),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id
"""
