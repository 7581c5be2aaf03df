import math
import random

import pytest

from voxloom.operators import components


def union_find(pairs) -> dict:
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def held(spark, pairs, spread=False) -> None:
    """With ``spread`` a task joins 50 edges at a time, so the rounds have to find what goes across."""
    rounds = []
    got = {r.node: r.label for r in components.components(spark.createDataFrame(pairs, "a long, b long"), rounds.append, 50 if spread else components.BLOCK_EDGES).collect()}
    assert got == union_find(pairs)
    assert rounds == sorted(rounds, reverse=True)
    assert len(rounds) <= 2 or spread  # a graph that fits into a block is done at once
    assert len(rounds) <= 2 + math.log(max(2, len(got)), 1.7)


def shuffled_path(n: int, seed: int) -> list:
    nodes = list(range(n))
    random.Random(seed).shuffle(nodes)
    return list(zip(nodes, nodes[1:], strict=False))


def test_components(spark):
    rnd = random.Random(4)
    held(spark, [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)])
    assert components.components(spark.createDataFrame([(1, 1), (2, 2)], "a long, b long")).collect() == []
    assert components.components(spark.createDataFrame([], "a string, b string")).collect() == []


@pytest.mark.parametrize("pairs", [shuffled_path(10_000, 1), [(i, i + 1) for i in range(3000)], [(0, i) for i in range(1, 3000)] + [(i, i) for i in range(5)]], ids=["random path", "sorted path", "star"])
@pytest.mark.parametrize("spread", [False, True])
def test_long_paths(spark, pairs, spread):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50 if spread else 10_000)
    held(spark, pairs, spread)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def voxels_held(spark, voxels, connectivity) -> None:
    near = [d for d in ((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)) if any(d) and (connectivity == 26 or sum(map(abs, d)) == 1)]
    there = set(voxels)
    want = {v: v for v in voxels} | union_find([(v, w) for v in voxels for d in near if (w := tuple(x + y for x, y in zip(v, d, strict=True))) in there])
    df = spark.createDataFrame([("v", *v) for v in voxels], "volume_id string, z int, y int, x int")
    got = components.labelled(df, connectivity).collect()
    assert {(r.z, r.y, r.x): tuple(r.label) for r in got} == want and len(got) == len(voxels)


def test_a_deep_u_and_a_spiral(spark):
    arms = [(z, y, 0) for z in range(500) for y in (0, 4)] + [(499, y, 0) for y in range(1, 4)]
    voxels_held(spark, arms, 26)
    y, x, dy, dx, spiral = 0, 0, 0, 1, []
    for length in (40, 40, 40, 38, 38, 36, 36, 34, 34, 32, 32, 30, 30):
        for _ in range(length):
            spiral.append((0, y, x))
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
    voxels_held(spark, sorted(set(spiral)), 6)
