"""Near-duplicates, mixing and benchmark leaks against brute force and SQL."""

import random
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.plain import ODD, WORD, shingles
from voxloom.llm import decontaminate, minhash, mixing
from voxloom.llm.text import Texts, counted

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, label string, id long"


def varied(seed=1):
    """Families of texts that differ by a few words, in chains, and texts of one word to five."""
    rnd, out = random.Random(seed), []
    for f in range(12):
        text = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([8, 30, 60, 200]))]
        for _ in range(rnd.randint(1, 9)):
            if rnd.random() < 0.8:
                text = list(text)
                text[rnd.randrange(len(text))] = f"v{rnd.random()}"
            out.append(" ".join(text))
    out += ["one", "one", "one two", "two one", "one two three four", "one two three four five", "one  two\tthree four five", " "]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(i, t, None, None, 0, "x", 3) for i, t in [*ODD, *((100 + i, t) for i, t in enumerate(varied()))]], FIELDS)
    return spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd, allowMissingColumns=True)


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-12):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, least.get(root(i))) for i, (d, _) in enumerate(rows))


def test_near_duplicates(docs):
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == classes([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Families larger than a block are compared block by block, and no link between blocks is lost."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    rows = list(enumerate(varied(7) + varied(8)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in minhash.near_duplicates(df).collect()) == classes(rows)


def test_rows_that_share_an_id_or_have_none(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "other text of the same id " + "x y z " * 5), (1, text), (None, text + " end"), (None, "alone " * 9), (4, text), (None, text)]
    got = Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == classes(rows)


@pytest.mark.parametrize("changes", [1, 12])
def test_large_family(spark, monkeypatch, changes):
    """Many near copies of one text in several blocks: with few changes the head settles most, with many it settles few."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 20)
    rnd = random.Random(changes)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(rnd.randint(0, changes)):
            text[rnd.randrange(len(text))] = f"v{rnd.randint(0, 30)}"
        rows.append((i, " ".join(text)))
    got = Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == classes(rows)


def test_near_copies_of_texts_with_repeated_lines(spark):
    """One text repeats a quarter of its passages a hundred times, its near copy has them once."""
    rows = []
    for f in range(40):
        line, rest = [f"l{f}x{i}" for i in range(50)], [f"r{f}x{i}" for i in range(150)]
        changed = [f"c{w}" if i in (30, 70, 110) else w for i, w in enumerate(rest)]
        rows += [(2 * f, " ".join(line * 100 + rest)), (2 * f + 1, " ".join(line + changed))]
    want = classes(rows)
    assert all(c == d - d % 2 for d, c in want)
    assert Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    x, y = {}, {}
    for k in range(300):
        if rng.random() < 0.8:
            x[k] = rng.random() + 0.2
        if rng.random() < 0.8:
            y[k] = rng.random() + 0.2
    true = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})
    keys = np.array([*x, *y], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    docs = np.array([0] * len(x) + [1] * len(y))
    sig = minhash.probminhash(docs, keys, np.array([*x.values(), *y.values()]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_empty(spark):
    none = spark.createDataFrame([], FIELDS)
    assert minhash.near_duplicates(none).count() == 0
    assert mixing.mixed(none).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.leaks(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g", None, None, 0, "x", 3)], FIELDS)
    assert decontaminate.leaks(some, items.limit(0)).count() == 0


def mix(rows):
    """The mix as an exact loop: water filling, then rows in key order."""
    import hashlib

    size = lambda t: len(WORD.findall(t or ""))
    by = defaultdict(list)
    for d, t, s in rows:
        key = ("" if d is None else str(d)) + "|" + hashlib.md5((t or "").encode()).hexdigest()
        by[s].append((hashlib.md5(key.encode()).hexdigest(), d is not None, d or 0, size(t)))
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    sizes = {s: sum(r[3] for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, list(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.remove(s)
    out = Counter()
    for s in names:
        left, taken = round(target[s] + 1e-9), [0] * len(by[s])
        order = sorted(range(len(by[s])), key=lambda i: by[s][i])
        for _ in range(3):
            for i in order:
                n = min(by[s][i][3], max(0, left))
                taken[i] += n
                left -= n
        for i, r in enumerate(by[s]):
            out[(r[2] if r[1] else None, r[3], sizes[s], round(target[s], 3), taken[i])] += 1
    return out


def test_mixing(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in mixing.mixed(docs).collect())
    assert got == mix(rows)


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 5000, "c": 10}, {"a": 10, "b": 0, None: 3}, {"only": 7}, {"a": 0}])
def test_mixing_caps(spark, sizes):
    rows = [(i * 10 + k, " ".join(["w"] * (n // 4 if k < 3 else n - 3 * (n // 4))), s) for i, (s, n) in enumerate(sizes.items()) for k in range(4)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in got) == mix(rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5 and all(r.taken <= 3 * r.size for r in mine)


def test_mixing_sql(spark):
    table = f"{SF}/documents.parquet"
    want = duckdb.sql(mixing.SQL.replace("FROM documents", f"FROM '{table}'")).fetchall()
    got = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.mixed(spark.read.parquet(table)).collect()]
    assert sorted(got) == sorted(want)


def leaked(rows, items):
    """Every window of every text against every item."""
    found = set()
    for item, text in items:
        words = WORD.findall(text or "")
        size = min(5, len(words))
        if not size:
            continue
        grams = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        for d, t in rows:
            w = WORD.findall(t or "")
            each = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
            if not {*each} & {*grams}:
                continue
            for at in range(max(1, len(w) - len(words) + 1)):
                mine = Counter(each[at : at + len(words) - size + 1])
                common = sum((mine & grams).values())
                if common >= 0.8 * (sum(mine.values()) + sum(grams.values()) - common):
                    found.add((d, item))
                    break
    return found


@pytest.mark.parametrize("changed", [{}, {"BROADCAST_SHINGLES": 0}, {"BROADCAST_PROBES": 0}, {"RADIUS": -1}], ids=str)
def test_leaks(spark, monkeypatch, changed):
    """Also by the joins that shuffle, and with an index that finds nothing, so that all pairs are such as it misses."""
    for name, value in changed.items():
        monkeypatch.setattr(decontaminate, name, value)
    rnd = random.Random(9)
    items = [(i, " ".join(f"q{rnd.randint(0, 500)}" for _ in range(rnd.choice([5, 12, 40, 60])))) for i in range(30)] + [(90, None), (91, "too few words"), (92, "la " * 20), (93, "Q " * 5)]
    rows = []
    for n in range(300):
        words = [f"d{rnd.randint(0, 500)}" for _ in range(rnd.choice([0, 3, 80, 300]))]
        part = (rnd.choice(items)[1] or "").split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            if part:
                k = rnd.randrange(len(part))
                part[k : k + 1] = rnd.choice([[], ["new"], [part[k], "new"]])
        at = rnd.randint(0, len(words))
        rows.append((n, " ".join(words[:at] + part[rnd.choice([0, 0, 1]) : len(part) - rnd.choice([0, 0, 2])] + words[at:])))
    rows += [(500, None), (501, ""), (502, "la " * 30), (502, "la " * 30), (None, items[3][1]), (503, "so too few words do"), (504, "few too words")]
    long = [(i, t.split()) for i, t in items if t and len(t.split()) >= 40]
    rows += [(600 + i, " ".join(["x"] * 9 + w[len(w) // 2 :] + w[: len(w) // 2] + ["y"] * 9)) for i, w in long]  # halves in the other order
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "doc_id long, text string, length int, shingle long, item long")
    it = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, it).collect()}
    want = leaked(rows, items)
    assert len(want) > 60
    assert got == want, (want - got, got - want)


def test_leaks_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == leaked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_block_index_finds_all_within_radius(spark):
    """Prints of 128 bits that differ in 31 places or fewer meet; of random ones fewer than a tenth do."""
    rnd = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda x: [signed(x & (1 << 64) - 1), signed(x >> 64)]
    rows = []
    for i in range(200):
        a = b = rnd.getrandbits(128)
        for k in rnd.sample(range(128), rnd.choice([0, 3, decontaminate.RADIUS, decontaminate.RADIUS])):
            b ^= 1 << k
        rows.append((i, halves(a), halves(b)))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    left = df.select("i", F.explode(decontaminate.window_probes(F.col("a"))).alias("p"))
    right = df.select(F.col("i").alias("j"), F.explode(decontaminate.item_probes(F.col("b"))).alias("p"))
    met = {tuple(r) for r in left.join(right, "p").select("i", "j").distinct().collect()}
    assert all((i, i) in met for i in range(200))
    assert len(met) < 0.1 * 200 * 200 + 200


def test_candidates_of_items_of_one_length(spark):
    """5,000 items of one length: a window meets few of them."""
    rnd = random.Random(3)
    texts = [(i, " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(30))) for i in range(5000)]
    df = decontaminate._fingerprinted(spark.createDataFrame(texts, "i int, t string").select("i", decontaminate.word_hashes(F.col("t")).alias("words")), 30)
    right = df.select(F.explode(decontaminate.item_probes(F.col("print"))).alias("p"), "i")
    left = df.where("i < 20").select(F.explode(decontaminate.window_probes(F.col("print"))).alias("p"), F.col("i").alias("j"))
    assert left.join(right, "p").select("i", "j").distinct().count() < 0.1 * 20 * 5000


def test_simhash(spark):
    rnd = random.Random(4)
    words = [[rnd.getrandbits(63) - (1 << 62) for _ in range(n)] for n in (1, 2, 3, 30, 59)]
    got = spark.createDataFrame([(w,) for w in words], "words array<long>").select(decontaminate.simhash(F.col("words"), 59)).collect()
    for w, (prints,) in zip(words, got, strict=True):
        w = w if len(w) % 2 else [*w, min(w)]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in w) > len(w))
        assert prints[0] & (1 << 64) - 1 == want


def test_leaks_in_a_text_of_a_million_words(spark):
    item = " ".join(f"q{i}" for i in range(40))
    text = "so it goes on and on with words " * 125_000 + item
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = decontaminate.leaks(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in got] == [(1, 7, 1_000_000, 1.0)]
    assert time.time() - began < 60


def test_words_and_counts():
    texts = Texts(pa.array(["a b  a", "", "ab"]))
    words = texts.words()
    h = words.hashes()
    assert words.counts.tolist() == [3, 0, 1] and h[0] == h[2] and len({*h.tolist()}) == 3
    docs, keys, counts = counted(words.text_of(), h)
    assert docs.tolist() == [0, 0, 2] and sorted(counts.tolist()) == [1, 1, 2] and len(keys) == 3


def test_a_chain_of_revisions(spark):
    """Each text shares enough with the next one only; what links the first and the last is the whole chain."""
    words = [f"w{k}" for k in range(2000 * 40 + 400)]
    order = list(range(2000))
    random.Random(6).shuffle(order)
    rows = [(k, " ".join(words[40 * at : 40 * at + 400])) for k, at in enumerate(order)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(k, 0) for k in range(2000)}
