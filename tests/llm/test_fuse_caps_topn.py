"""Survivors, caps and top N against plain loops; nulls, ties, repeated rows, empty tables, clashing names."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scantable.llm.caps import Level, beyond_caps, laminar_caps
from scantable.llm.fuse import discover_truth
from scantable.llm.topn import LoserTree, top_n

SOURCES = [("best", 1), ("good", 2), ("also good", 2), ("poor", 3)]


def _records(n, seed):
    rng = random.Random(seed)
    day = dt.datetime(2025, 1, 1)
    for i in range(n):
        src = rng.choice(["best", "Good", "also_good", "poor", "POOR ", None, "--", "new"])
        when = rng.choice([None, *[day + dt.timedelta(days=rng.randrange(4))] * 3])
        yield (i, f"s{rng.randrange(3)}", None if rng.random() < 0.05 else rng.randrange(8), src, when, rng.choice([None, 0.1, 0.2, 0.3]), rng.choice(["a", "b", None]), "x")


RECORD = "id long, scene string, cand long, src string, ts timestamp, score double, label string, n_records string"


def _fuse(spark, df, **how):
    src = spark.createDataFrame(SOURCES, "source_kind string, trust_rank int")
    return discover_truth(df, ["scene", "cand"], "src", src, {"score": F.col("score"), "label": F.col("label")}, "ts", "id", **how)


def test_dominating_prior_is_the_trust_order(spark):
    records = list(_records(400, 3))
    rank = {"best": 1, "good": 2, "alsogood": 2, "poor": 3}
    name = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    groups = defaultdict(list)
    for r in records:
        if r[2] is not None:
            groups[r[1], r[2]].append(r)
    got = {(r.scene, r.cand): (r.n_records, r.score_id, r.label_id, r.score) for r in _fuse(spark, spark.createDataFrame(records, RECORD)).chosen.collect()}
    want = {}
    for key, rows in groups.items():
        if len(rows) > 1:
            order = sorted(rows, key=lambda r: (rank.get(name(r[3]), 9), -(r[4].timestamp() if r[4] else -1e18), -r[0]))
            first = lambda at: next((r for r in order if r[at] is not None), None)  # noqa: E731, B023
            s, c = first(5), first(6)
            want[key] = (len(rows), s and s[0], c and c[0], s and s[5])
    assert got == want


def test_agreeing_sources_outvote_without_discount(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [(i, "s", 1, src, day, v, None, "x") for i, (src, v) in enumerate([("best", 0.1), ("good", 0.2), ("also good", 0.2), ("poor", 0.2)])]
    fused = _fuse(spark, spark.createDataFrame(rows, RECORD), discount=1.0, floor=0.05)
    r = fused.chosen.first()
    assert (r.score, r.score_id, r.label, r.label_id) == (0.2, 2, None, None) and fused.rounds >= 2
    trust = {name: fused.reliability[i] for i, (name, _) in enumerate(fused.sources)}
    assert trust["best"] < trust["good"] == trust["poor"]


def test_fuse_empty_single_and_repeated(spark):
    df = spark.createDataFrame(list(_records(30, 1)), RECORD)
    assert _fuse(spark, df.limit(0)).chosen.count() == 0
    assert _fuse(spark, df.where("id = 0")).chosen.count() == 0
    one = df.where("cand is not null").limit(1)
    assert _fuse(spark, one.union(one)).chosen.first().n_records == 2


def _kept(rows, cap_fine, cap_coarse):
    fine, coarse, kept = defaultdict(int), defaultdict(int), set()
    order = sorted(rows, key=lambda r: (-(r[3] if r[3] is not None else -1), r[0]))
    first = []
    for r in order:
        fine[r[1], r[2]] += 1
        if fine[r[1], r[2]] <= cap_fine:
            first.append(r)
    for r in first:
        coarse[r[1]] += 1
        if coarse[r[1]] <= cap_coarse:
            kept.add(r[0])
    return kept


@pytest.fixture(scope="module")
def capped(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "x", "y", None]), rng.choice([None, 0.5, 0.5, 0.9]), 7) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id long, org string, author string, score double, rank int")


def test_nested_caps(capped):
    rows, df = capped
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    levels = [Level(("org", "author"), cap=9), Level(("org",), cap=20)]
    want = _kept(rows, 9, 20)
    assert {r.id for r in laminar_caps(df, levels, order).collect()} == want
    assert {r.id for r in beyond_caps(df, levels, order, "id").collect()} == {r[0] for r in rows} - want
    assert laminar_caps(df.limit(0), levels, order).count() == 0
    assert laminar_caps(df, levels, order).columns == df.columns
    with pytest.raises(ValueError, match="coarser"):
        laminar_caps(df, levels[::-1], order)


def test_large_caps_and_shares(capped, monkeypatch):
    rows, df = capped
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    monkeypatch.setattr("scantable.llm.caps.GROUP_LIMIT", 1)
    assert {r.id for r in laminar_caps(df, [Level(("org", "author"), cap=9), Level(("org",), cap=20)], order).collect()} == _kept(rows, 9, 20)
    size = defaultdict(int)
    for r in rows:
        size[r[1]] += 1
    got = defaultdict(int)
    for r in laminar_caps(df, [Level(("org",), share=0.3)], order).collect():
        got[r.org] += 1
    assert got == {k: max(1, int(n * 0.3)) for k, n in size.items()}


def test_loser_tree_merges():
    rng = random.Random(4)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        tree, out = LoserTree(runs), []
        while (x := tree.pop()) is not None:
            out.append(x)
        assert out == sorted(x for r in runs for x in r)
    assert LoserTree([]).pop() is None


@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_n(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, "c"]), rng.choice([None, 1.0, 2.0, 2.0]), rng.randrange(4), i, rng.randrange(9)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, s double, c long, id long, `rank` int").repartition(7)
    want = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -1), r[2], r[3])):
        if len(want[r[0]]) < n:
            want[r[0]].append(r[3])
    got = defaultdict(list)
    for r in top_n(df, ["g"], [("s", True), ("c", False), ("id", False)], n).collect():
        got[r.g].append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_top_n_small_batches_strings_and_empty(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(i % 2, f"v{i:02d}", i) for i in range(20)], "g int, s string, id long").repartition(3)
        got = sorted((r.g, r.id) for r in top_n(df, ["g"], [("s", True), ("id", False)], 2).collect())
        assert got == [(0, 16), (0, 18), (1, 17), (1, 19)]
        assert top_n(df.limit(0), ["g"], [("id", False)], 2).count() == 0 and top_n(df, ["g"], [("id", False)], 0).count() == 0
        twice = df.where("id = 4").union(df.where("id = 4"))
        assert top_n(twice, ["g"], [("id", False)], 5).count() == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_top_n_orders_nan_infinity_and_zero_as_spark_does(spark):
    rng = random.Random(12)
    pool = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0, -2.5]
    rows = [(rng.choice(["a", "a", "b"]), rng.choice(pool), rng.choice([None, "x", "yy", "é"]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, s double, t string, id long").repartition(8)
    for down in (True, False):
        order = [F.col("s").desc_nulls_last() if down else F.col("s").asc_nulls_last(), F.col("t").desc_nulls_last(), F.col("id")]
        want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where("n <= 60")
        got = top_n(df, ["g"], [("s", down), ("t", True), ("id", False)], 60)
        assert {r.id for r in got.collect()} == {r.id for r in want.collect()}


def test_top_n_merges_a_large_group_in_parts(spark, monkeypatch):
    monkeypatch.setattr("scantable.llm.topn.HELD", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select((F.col("id") * 37 % 500).alias("id"), (F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") % 11).cast("double").alias("s")).repartition(9)
        want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "id"))).where("n <= 40")
        got = [r.id for r in top_n(df, ["g"], [("s", True), ("id", False)], 40).collect()]
        assert sorted(got) == sorted(r.id for r in want.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fuse_says_whether_it_settled(spark):
    df = spark.createDataFrame(list(_records(300, 5)), RECORD)
    assert _fuse(spark, df, discount=1.0, floor=0.05).converged
    with pytest.warns(UserWarning, match="still moved"):
        assert not _fuse(spark, df, discount=1.0, floor=0.05, max_rounds=1, tolerance=1e-12).converged
