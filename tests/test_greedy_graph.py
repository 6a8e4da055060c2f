"""Greedy and graph operators against plain loops."""

import random

from pyspark.sql import functions as F

from scantable.operators import graph, greedy


def _loop(order, conflicts):
    kept = []
    for x in order:
        if not any((k, x) in conflicts or (x, k) in conflicts for k in kept):
            kept.append(x)
    return set(kept)


def test_suppress_equals_scan(spark):
    rng = random.Random(5)
    for n, m in ((12, 14), (40, 120)):
        order = list(range(n))
        conflicts = {tuple(sorted(rng.sample(order, 2))) for _ in range(m)}
        df = spark.createDataFrame([("s", i) for i in order], "k string, worse long")
        pairs = spark.createDataFrame([("s", a, b) for a, b in conflicts], "k string, better long, worse long")
        assert {r.worse for r in greedy.suppress(df, ["k"], pairs, "better", "worse").collect()} == _loop(order, conflicts)


def test_suppress_long_chain_and_no_pairs(spark):
    df = spark.createDataFrame([("s", i) for i in range(9)], "k string, worse long")
    pairs = spark.createDataFrame([("s", i, i + 1) for i in range(8)], "k string, better long, worse long")
    assert sorted(r.worse for r in greedy.suppress(df, ["k"], pairs, "better", "worse").collect()) == [0, 2, 4, 6, 8]
    assert greedy.suppress(df, ["k"], pairs.limit(0), "better", "worse").count() == 9


def test_admission_counts_accepted_only(spark):
    df = spark.createDataFrame([("s", 1, 0.9, "a", 0, False), ("s", 2, 0.8, "a", 0, True), ("s", 3, 0.7, "a", 1, True), ("s", 4, None, "b", 0, None)], "k string, id long, q double, src string, cls int, ok boolean")
    got = {r.id: r.decision for r in greedy.admit(df, ["k"], "id", "q", "src", "cls", "ok", 1, 5).collect()}
    assert got == {1: "rejected", 2: "accepted", 3: "source_limit", 4: "rejected"}


def test_merge_sets_to_fixpoint(spark):
    df = spark.createDataFrame([("s", 1, 0.9, [1, 2, 3]), ("s", 2, 0.8, [2, 3, 4]), ("s", 3, 0.7, [1, 2, 3, 4]), ("s", 4, 0.1, [9])], "k string, id long, sc double, v array<long>")
    got = {r.id: sorted(r.members) for r in greedy.merge_sets(df, ["k"], "id", "sc", "v", 0.5).collect()}
    assert got == {1: [1, 2, 3], 4: [4]}


def test_components_are_a_partition(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(300 + i, 301 + i) for i in range(60)] + [(None, 1), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in root}


def test_segment_graph_merges_small_parts(spark):
    edges = [("s", 0, 1, 0.1), ("s", 1, 2, 0.1), ("s", 2, 3, 9.0), ("s", 3, 4, 0.1)]
    df = spark.createDataFrame(edges, "k string, a long, b long, w double")
    got = {r.node: r.segment for r in greedy.segment_graph(df, ["k"], "a", "b", "w", 1.0, 1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    got = {r.node: r.segment for r in greedy.segment_graph(df, ["k"], "a", "b", "w", 1.0, 3).collect()}
    assert set(got.values()) == {0}


def test_farthest_points(spark):
    df = spark.createDataFrame([("s", i, float(x), 0.0) for i, x in enumerate([0, 1, 10, 5])], "k string, id long, x double, y double")
    assert [(r.id, r.step) for r in greedy.farthest_points(df, ["k"], "id", ["x", "y"], 3).orderBy("step").collect()] == [(0, 0), (2, 1), (3, 2)]


def test_keep_components_falls_back_to_largest(spark, rows):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, component long")
    assert rows(graph.keep_components(found, 5, 2), "node") == [(1,), (2,)]
    assert greedy.running_budget(found.withColumn("c", F.lit(1)), ["component"], [F.col("node")], "c", 1).count() == 2
