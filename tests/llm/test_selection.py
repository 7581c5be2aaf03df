"""Resampling, exact duplicates and the filter audit against plain Python, on rows that are hard to get right."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from voxloom.llm import exact_dedup, filter_audit, resampling
from voxloom.llm.text import Texts
from voxloom.operators.ordering import numbered

SCHEMA = "doc_id long, text string, source string, n long, rank string, keep_id int, mask int, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", 1, 2, 3) for i, t, s in rows], SCHEMA)


def rows_of_words(seed: int, n: int) -> list:
    rnd = random.Random(seed)
    rows = [(i, t, rnd.choice(["b", "a", None, ""])) for i, t in plain.ODD]
    for k in range(n):
        words = rnd.choices(["the", "The", "fox", "naïve", "#1", "Ärger", "x" * 150, "I.B.M.", "ünder", "9a"], k=rnd.choice([3, 19, 20, 21, 60, 300]))
        rows.append((100 + k, " ".join(words), rnd.choice("abc")))
    return rows + rows[-5:] + [(900 + k, rows[-1][1], "b") for k in range(40)] + [(None, rows[-1][1], "a"), (None, None, None)]


def drawn(rows, target, longest=1, buckets=10_000):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    def found(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    own, other = (Counter(b for t in texts for b in found(t)) for texts in ([t for _, t, _ in rows], target))
    s_all, t_all = sum(own.values()), sum(other.values())
    gain = lambda b: math.floor(1000 * math.log((other[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets))))
    out = []
    for i, t, _ in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found(t)))
        out.append([i, len(found(t)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t))])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = Counter()
    for k, r in enumerate(able[: 10 * len(able) // 100], 1):
        ranks[tuple(r[:4]) + (k,)] += 1
    rest = Counter(tuple(r[:4]) for r in out) - Counter(k[:4] for k in ranks)
    return ranks + Counter({(*k, None): n for k, n in rest.items()})


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 997), (2, 65_536)])
def test_resampled(spark, longest, buckets):
    rows, target = rows_of_words(3, 120), ["the fox the naïve", None, "", "9A " * 30]
    got = resampling.resampled(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == drawn(rows, target, longest, buckets)


def test_resampled_without_rows(spark):
    rows, none = rows_of_words(5, 30), spark.createDataFrame([], "text string")
    assert Counter(tuple(r) for r in resampling.resampled(table(spark, rows), none).collect()) == drawn(rows, [])
    assert resampling.resampled(table(spark, []), none).count() == 0
    with pytest.raises(ValueError, match="16 bits"):
        resampling.bucketed(table(spark, rows), "doc_id", "text", buckets=1 << 17)


def test_long_words():
    texts = ["a" * 200_000 + " b " + "é" * 33 + " " + "C" * 64 + " " + "d" * 65, "", "zz"]
    owner, crc = resampling.features(Texts(pa.array(texts)).words(resampling._GAPS), 1)
    assert owner.tolist() == [0] * 5 + [2]
    assert crc.tolist() == [zlib.crc32(w.encode()) for t in texts for w in t.lower().split()]


def test_numbered(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, None, rnd.randint(0, 50)]), k) for k in range(500)]
    got = numbered(spark.createDataFrame(rows, "v int, k int").repartition(7), "v", name="at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(1, 501))
    assert [r.v for r in got] == sorted((v for v, _ in rows), key=lambda v: (v is not None, v or 0)) and {(r.v, r.k) for r in got} == set(rows)


def test_fingerprints_compose():
    p, rnd = exact_dedup.PRIME, random.Random(2)
    strings = [b"", b"a", b"\xff" * 5000, bytes(rnd.randrange(256) for _ in range(20_000))]
    raw, offsets = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    for base, found in zip(exact_dedup.BASES, exact_dedup.fingerprints(raw, offsets), strict=True):
        for s, f in zip(strings, found.tolist(), strict=True):
            want = 0
            for b in s:
                want = (want * base + b + 1) % p
            assert f == want
        parts = exact_dedup.fingerprints(raw, np.array([0, 5001, 12_345, len(raw)]), [base], np.array([len(raw) - 5001, len(raw) - 12_345, 0]))[0]
        assert sum(parts.tolist()) % p == exact_dedup.fingerprints(raw, np.array([0, len(raw)]), [base])[0][0]
    a, b = np.array([p - 1, p - 1, 12345, 1 << 60], np.uint64), np.array([p - 1, 2, (1 << 61) - 5, 1 << 60], np.uint64)
    assert exact_dedup.times(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def copies(rows) -> Counter:
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            out[i, best, len(ids), k == 0, plain.sha(t)] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"piece": 100}, {"bases": (1, 1)}, {"bases": (1, 1), "piece": 50}], ids=["whole", "pieces", "collisions", "collisions in pieces"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_exact_duplicates(spark, monkeypatch, options, broadcast):
    if not broadcast:
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "PART_ROWS", 7)
    rows = rows_of_words(8, 40) + [(2000, "ab" * 60, "a"), (2001, "ba" * 60, "a"), (2002, "ab" * 59 + "ba", "a"), (2003, "ab" * 60, "a"), (2003, "ab" * 60, "a"), (2001, "ab" * 60, "a")]
    got = exact_dedup.exact_duplicates(table(spark, rows), **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == copies(rows)


def test_exact_duplicates_without_rows(spark):
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0
    rows = [(None, "x", "a"), (None, "x", "b"), (None, None, None)]
    assert Counter(tuple(r) for r in exact_dedup.exact_duplicates(table(spark, rows)).collect()) == copies(rows)


def audited(rows, labels) -> dict:
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    docs, ids = [], defaultdict(set)
    for i, t, _ in rows:
        ids[t or ""].add(i)
    for i, t, s in rows:
        t = t or ""
        w = plain.WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i for j in ids[t])}
        docs.append((s or "", fails, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                hit = [d for d in left if d[1][f]]
                shapley[f] += len(hit)
                before = order[: step - 1]
                out[part, "".join(order), step] = [len(left) - len(hit), len(hit), sum(d[1][f] and any(d[1][g] for g in before) for d in mine), sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in hit), sum(d[3] for d in hit)]
                left = [d for d in left if not d[1][f]]
        for order, step in [k[1:] for k in out if k[0] == part]:
            out[part, order, step].append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_audit(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", 0)
    rows = rows_of_words(11, 60) + [(3000, "NO " * 55, "z"), (3001, " ".join(f"w{k}" for k in range(60)), "z"), (3002, " ".join(f"w{k}" for k in range(60)), "z"), (3002, " ".join(f"w{k}" for k in range(60)), "z"), (3002, "other", "z")]
    labels = [(i, random.Random(i).choice([0, 1, None]), random.Random(-i).choice([0, 0, 1])) for i, _, _ in rows if i is not None and i % 3] + [(100, 0, 0), (None, 1, 1), (5, 1, 1)]
    got = filter_audit.audit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = got.collect()
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == audited(rows, labels)
    assert len(found) == 600 * len({s or "" for _, _, s in rows}) and len(filter_audit.edges()) == 32 * 80 and len(filter_audit.steps()) == 600
    assert filter_audit.audit(table(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
