"""Similar sets and linked groups against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scantable.llm import components, setjoin


def _sets(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = rng.randrange(12)
        r = random.Random(base)
        s = [r.randrange(10**6) for _ in range(r.randrange(5, 60))]
        s = [x for x in s if rng.random() > rng.choice([0.0, 0.05, 0.2])] + [rng.randrange(10**6) for _ in range(rng.randrange(3))]
        out.append((i, rng.choice(["a", "a", "b"]), s + s[:1] + rng.choice([[], [None]])))
    return out + [(900, "a", []), (901, "a", None), (902, None, [1]), (903, "a", [7]), (904, "a", [7, 7]), (905, "b", [7]), (None, "a", [7])]


def _pairs(rows, t=0.8):
    clean = [(i, b, {x for x in s if x is not None}) for i, b, s in rows if s and b and i is not None]
    return {(i, j) for i, b, s in clean for j, c, u in clean if i < j and b == c and s and u and 10 * len(s & u) >= 10 * t * len(s | u)}


def test_all_pairs_found(spark):
    rows = _sets(1)
    df = spark.createDataFrame(rows, "id long, scene string, pts array<long>").withColumn("set_id", F.lit("clash"))
    found = setjoin.similar_sets(df, "id", ["scene"], F.col("pts"))
    got = {(r.id_a, r.id_b) for r in setjoin.similar_pairs(found).collect()}
    assert got == _pairs(rows) and (903, 904) in got
    links = {r.id: (r.n_copies, r.n_links) for r in setjoin.set_links(found).collect()}
    assert links[903] == (2, 0) and links[905] == (1, 0)
    again = setjoin.similar_sets(df.union(df), "id", ["scene"], F.col("pts"))
    assert {(r.id_a, r.id_b) for r in setjoin.similar_pairs(again).collect()} == got


def test_exact_threshold_counts_and_empty(spark):
    df = spark.createDataFrame([(1, "s", [1, 2, 3, 4]), (2, "s", [1, 2, 3, 4, 5]), (3, "s", [1, 2, 3])], "id long, scene string, pts array<long>")
    assert [(r.id_a, r.id_b) for r in setjoin.similar_pairs(setjoin.similar_sets(df, "id", ["scene"], F.col("pts"))).collect()] == [(1, 2)]
    none = setjoin.similar_sets(df.limit(0), "id", ["scene"], F.col("pts"))
    assert setjoin.similar_pairs(none).count() == 0 and setjoin.set_links(none).count() == 0


def test_calibration_holds():
    plan = setjoin.calibrate(0.8, 0.9999)
    assert (plan.bits, plan.segments) == (16, 49)
    assert setjoin.calibrate(0.8, 0.9999, 10**6).bits == 24
    rng = np.random.default_rng(3)
    hit = segs = 0
    for _ in range(60):
        shared, mine, yours = rng.integers(0, 2**40, 80), rng.integers(0, 2**40, 10), rng.integers(0, 2**40, 10)
        a, b = np.concatenate([shared, mine]), np.concatenate([shared, yours])
        c = setjoin.codes(np.concatenate([a, b]), np.array([0, 90, 180]), plan)
        apart = sum(int(x).bit_count() for x in c[0] ^ c[1])
        segs += (c[0] == c[1]).any()
        hit += apart <= plan.radius
        assert 30 < apart < 130
    assert hit == segs == 60


@pytest.mark.parametrize("block", [2, 100, 5000, 1 << 20])
def test_recall_of_pairs_at_the_threshold(block):
    plan = setjoin.calibrate(0.8, 0.9999, block)
    rng = np.random.default_rng(block)
    n, found = 300, 0
    values, offsets = [], [0]
    for _ in range(n):
        shared = rng.integers(0, 2**40, 40)
        for own in (rng.integers(0, 2**40, 5), rng.integers(0, 2**40, 5)):
            values += [shared, own]
            offsets.append(offsets[-1] + 45)
    c = setjoin.codes(np.concatenate(values), np.array(offsets), plan)
    for i in range(n):
        a, b = c[2 * i], c[2 * i + 1]
        found += bool((a == b).any() and sum(int(x).bit_count() for x in a ^ b) <= plan.radius)
    assert found >= n - 1  # 0.9999 of them


def test_blocks_of_different_sizes(spark):
    rng = random.Random(5)
    rows = []
    for scene, n in (("large", 400), ("mid", 40), ("small", 3)):
        for i in range(n):
            base = random.Random(rng.randrange(n)).sample(range(1000), 30)
            rows.append((len(rows), scene, [x for x in base if rng.random() > 0.06]))
    df = spark.createDataFrame(rows, "id long, scene string, pts array<long>")
    assert {(r.id_a, r.id_b) for r in setjoin.similar_pairs(setjoin.similar_sets(df, "id", ["scene"], F.col("pts"))).collect()} == _pairs(rows)


def _loop(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


def test_groups(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += [(1000 + i, 1001 + i) for i in range(150)] + [(2000, 2001 + i) for i in range(150)] + [(None, 3), (5, None), (9, 9), (777, 777)]
    df = spark.createDataFrame(edges + edges[:40], "src long, dst long")
    want = _loop(edges)
    assert {r.vertex: r.group for r in components.connected_groups(df).collect()} == want
    monkeypatch.setattr(components, "BASE_EDGES", 0)  # all levels distributed
    assert {r.vertex: r.group for r in components.connected_groups(df).collect()} == want
    assert components.connected_groups(df.limit(0)).count() == 0


def test_groups_in_memory():
    rng = random.Random(2)
    for n, m in ((10, 8), (300, 280), (500, 900)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges = [(a, b) for a, b in edges if a != b]
        v, r = components._decompose(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
        least = {}
        for x, y in zip(v, r):
            least[y] = min(least.get(y, 10**9), x)
        assert {int(x): int(least[y]) for x, y in zip(v, r)} == _loop(edges)


def test_both_forms_of_the_recursion_give_the_same_clusters(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(500), rng.randrange(500)) for _ in range(420)]
    df = spark.createDataFrame(edges, "src long, dst long")
    a, b = ({r.v: r.root for r in components.component_roots(df, base_edges=n).collect()} for n in (0, 10**6))
    assert a == b
    got = {r.x: r.s for r in spark.range(50).selectExpr("id - 9 AS x").select("x", components._shift(F.col("x"), F.lit(3).cast("long")).alias("s")).collect()}
    assert np.array_equal(components.shifts(np.array(list(got)), 3), np.array(list(got.values())))


def test_large_ids(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(1, -5, [top, top - 1]), (2, -5, [7]), (3, top, [8])], "t long, c long, m array<long>")
    assert {r.observation_id: r.group_id for r in components.observation_groups(df, "m", "c", F.lit(True)).collect()} == {top: 7, top - 1: 7, 7: 7, 8: 8}


def test_observation_groups(spark):
    rows = [(1, 5, "same", [3, 4, None, -1]), (1, 5, "same", [3, 4]), (2, None, "same", [4, 9]), (3, 5, "same", [20]), (4, None, "CONFLICT", [9, 30]), (5, 7, None, [40]), (6, 8, "same", []), (7, 8, "same", None), (8, 9, "conflict", [50])]
    df = spark.createDataFrame(rows, "trace_id long, c long, rel string, m array<long>")
    got = {r.observation_id: r.group_id for r in components.observation_groups(df, "m", "c", F.lower(F.coalesce("rel", F.lit(""))) != "conflict").collect()}
    assert got == {3: 3, 4: 3, 9: 3, 20: 3, 40: 40}
    assert components.observation_groups(df.limit(0), "m", "c", F.lit(True)).count() == 0
