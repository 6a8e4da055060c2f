"""Order-dependent kernels on small cases worked out by hand."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scantable.operators import kernels


def test_absorb(spark, rows):
    df = spark.createDataFrame([("s", 1, 0, "a", [1, 2, 3, 4]), ("s", 2, 1, "a", [1, 2, 3]), ("s", 3, 2, "b", [1, 2, 3]), ("s", 4, 3, "a", [9]), ("s", 5, 4, "a", None)], "k string, id long, t int, c string, v array<long>")
    assert rows(kernels.absorb(df, ["k"], "id", "t", "c", "v", 0.5), "id", "proposal") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


def test_merge_best_pairs_takes_the_best_first(spark, rows):
    df = spark.createDataFrame([("s", 1, [1, 2, 3, 4]), ("s", 2, [3, 4, 5, 6]), ("s", 3, [3, 4, 5, 6, 7]), ("s", 4, [9])], "k string, id long, v array<long>")
    got = [(r.id, r.members, r.n_items) for r in kernels.merge_best_pairs(df, ["k"], "id", "v", 0.3, 2).collect()]
    assert got in ([(1, [1], 4), (2, [2, 3], 5)], [(2, [2, 3], 5), (1, [1], 4)])


@pytest.mark.parametrize(("action", "want"), [("remove_large", (0.9, 6, "removed")), ("downweight", (0.45, 6, "downweighted")), ("carve", (0.9, 4, "carved"))])
def test_containment(spark, action, want):
    df = spark.createDataFrame([("s", 1, 0.9, [1, 2, 3, 4, 5, 6]), ("s", 2, 0.8, [1, 2]), ("s", 3, 0.1, [3, 4])], "k string, id long, sc double, v array<long>")
    got = {r.id: (r.sc, r.n_items, r.outcome) for r in kernels.resolve_containment(df, ["k"], "id", "sc", "v", action, 0.9).collect()}
    assert got[1] == want and got[2] == (0.8, 2, "kept") and got[3][2] == "kept"


def test_accept_frames(spark, rows):
    df = spark.createDataFrame([("s", 0, 1, 5.0), ("s", 1, 1, 5.0), ("s", 1, 2, -1.0), ("s", 2, 3, 2.0), ("s", 2, 2, -1.0)], "k string, f int, g int, v double")
    assert rows(kernels.accept_frames(df, ["k"], "f", "g", "v"), "f", "accepted") == [(0, True), (1, False), (2, True)]


def test_constrained_clusters_defer_and_respect_conflicts(spark, rows):
    nodes = spark.createDataFrame([("s", i, q) for i, q in ((1, 0.9), (2, 0.8), (3, 0.5), (4, 0.4), (5, 0.3))], "k string, id long, q double")
    edges = spark.createDataFrame([("s", 1, 2, True), ("s", 1, 3, False), ("s", 2, 3, False), ("s", 1, 4, False), ("s", 3, 4, False)], "k string, a long, b long, conflict boolean")
    got = dict(rows(kernels.constrained_clusters(nodes, edges, ["k"], "id", "q", 0.4), "id", "cluster"))
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: None}  # 4 joins 1 first, then 3 has more support there


def _clusters(order, edges, share, support):
    """The definition as a plain loop over all clusters."""
    good = {(x, y) for a, b, c in edges if not c for x, y in ((a, b), (b, a))}
    bad = {(x, y) for a, b, c in edges if c for x, y in ((a, b), (b, a))}
    clusters, placed, late = {}, {}, []

    def fits(i):
        return {c: n for c, m in clusters.items() if not any((i, x) in bad for x in m) and (n := sum((i, x) in good for x in m)) >= support}

    for at, i in enumerate(order):
        found = fits(i)
        if len(found) > 1:
            late.append(i)
        elif found or at < max(1, math.ceil(len(order) * share)):
            placed[i] = next(iter(found), i)
            clusters.setdefault(placed[i], set()).add(i)
    for i in late + [i for i in order if i not in placed and i not in late]:
        found = sorted(((n, c) for c, n in fits(i).items()), reverse=True)
        if found and (len(found) == 1 or found[0][0] > found[1][0]):
            placed[i] = found[0][1]
            clusters[placed[i]].add(i)
    return {i: placed.get(i) for i in order}


def test_constrained_clusters_equal_a_plain_loop(spark):
    rng = random.Random(8)
    base = 1 << 60  # ids that no double tells apart
    nodes, edges, want = [], [], {}
    for k, (n, m) in enumerate(((1, 0), (6, 9), (30, 60), (80, 110), (80, 260))):
        quality = {base + i: rng.choice((None, 0.0, 0.2, 0.4, 0.9)) for i in rng.sample(range(4 * n), n)}
        ids = [*quality, base - 1]  # one end that is no node
        links = [(*rng.sample(ids, 2), rng.random() < 0.25) for _ in range(m)]
        links += links[: m // 4]
        order = sorted(quality, key=lambda i: (quality[i] is None, -(quality[i] or 0.0), i))
        nodes += [(k, i, q) for i, q in quality.items()]
        edges += [(k, *e) for e in links] + [(k, None, order[0], False), (k, order[0], None, True)]
        want |= {(k, s): _clusters(order, links, 0.3, s) for s in (0, 1, 2)}
    nodes, edges = spark.createDataFrame(nodes, "k int, id long, q double"), spark.createDataFrame(edges, "k int, a long, b long, conflict boolean")
    for support in (0, 1, 2):
        got = {(r.k, r.id): r.cluster for r in kernels.constrained_clusters(nodes, edges, ["k"], "id", "q", 0.3, support).collect()}
        assert got == {(k, i): c for (k, s), found in want.items() if s == support for i, c in found.items()}


def test_constrained_clusters_many_in_one_key(spark):
    """A node looks at its neighbours' clusters, not at all of the key: a scene of 60,000 nodes took minutes."""
    n = 60_000
    nodes = spark.range(n).select(F.lit("s").alias("k"), "id", (-F.col("id")).cast("double").alias("q"))
    pair = lambda rows, a, b, bad: rows.select(F.lit("s").alias("k"), a.alias("a"), b.alias("b"), F.lit(bad).alias("conflict"))
    i = F.col("id")
    join, torn, hit = spark.range(18_000, 36_000), spark.range(36_000, 53_999), spark.range(54_000, n)
    edges = pair(join, i - 18_000, i, False).union(pair(torn, i - 36_000, i, False)).union(pair(torn, i - 35_999, i, False)).union(pair(hit, i - 54_000, i, False)).union(pair(hit, i - 36_000, i, True))
    began = time.monotonic()
    got = {r.id: r.cluster for r in kernels.constrained_clusters(nodes, edges, ["k"], "id", "q", 0.3).collect()}
    assert time.monotonic() - began < 40
    assert got == {x: x if x < 18_000 else x - 18_000 if x < 36_000 else None for x in range(n)}


def test_expand_boundary(spark, rows):
    df = spark.createDataFrame([("s", 1, 0.9, 5, 0.0, 6.0), ("s", 2, 0.8, 4, 0.0, 6.0), ("s", 3, 0.7, 1, 0.0, 6.0), ("s", 4, 0.6, 1, 0.9, 6.0)], "k string, g long, c double, n int, o double, b double")
    assert rows(kernels.expand_boundary(df, ["k"], "g", "c", "n", "o", "b"), "g", "reason") == [(1, "taken"), (2, "over_budget"), (3, "taken"), (4, "bridge")]


def test_stratified_folds_are_even(spark):
    df = spark.createDataFrame([(f"g{i}", j % 3) for i in range(30) for j in range(10 + i % 5)], "g string, l int")
    got = kernels.stratified_folds(df, "g", "l", 3).collect()
    assert len(got) == 30 and {r.fold for r in got} == {0, 1, 2}
    size = {f: sum(10 + int(r.g[1:]) % 5 for r in got if r.fold == f) for f in range(3)}
    assert max(size.values()) - min(size.values()) <= 14


def test_erode_and_fallback(spark):
    square = [("m", x, y) for x in range(5) for y in range(5)]
    line = [("n", x, 0) for x in range(9)]
    got = kernels.erode(spark.createDataFrame(square + line, "m string, px int, py int"), ["m"], 1).collect()
    assert {(r.px, r.py) for r in got if r.m == "m"} == {(x, y) for x in range(1, 4) for y in range(1, 4)}
    assert sum(r.m == "n" for r in got) == 9


def test_random_crop(spark):
    df = spark.createDataFrame([("s", i, float(i % 10), float(i // 10)) for i in range(100)] + [("t", 1, 0.0, 0.0)], "k string, id long, x double, y double")
    got = kernels.random_crop(df, ["k"], "id", ["x", "y"], 4.0, 9).collect()
    assert got and {r.k for r in got} == {"s"} and len({r.attempt for r in got}) == 1 and len(got) <= 25
    assert sorted(map(tuple, got)) == sorted(map(tuple, kernels.random_crop(df.repartition(3), ["k"], "id", ["x", "y"], 4.0, 9).collect()))


def test_depth_and_intrinsics_and_bits(spark, rows):
    df = spark.createDataFrame([("a", 1.0, 1.03), ("a", 1.0, 1.2), ("a", 1.0, 0.8), ("a", 1.0, 0.0), ("a", None, 1.0)], "k string, e double, m double")
    assert rows(kernels.depth_agreement(df, ["k"], "e", "m"), "n", "agreeing", "in_front", "behind") == [(3, 1, 1, 1)]
    one = spark.range(1).select(*kernels.scaled_intrinsics(*(F.lit(float(v)) for v in (10, 20, 4, 6)), (100, 50), (50, 25))).first()
    assert tuple(one) == (5.0, 10.0, 2.0, 3.0)
    mask = np.zeros((3, 5), dtype=np.uint8)
    mask[1, 2] = mask[2, 4] = 1
    df = spark.createDataFrame([(1, bytearray(np.packbits(mask.ravel()).tobytes()), 3, 5), (2, None, 3, 5)], "id long, b binary, h int, w int")
    assert rows(kernels.unpack_masks(df, "id", "b", "h", "w")) == [(1, 2, 1), (1, 4, 2)]
