"""Expressions and ranks: nulls, ties, empty inputs."""

import pytest
from pyspark.sql import functions as F

from scantable.common import distributed_rank, same_name
from scantable.functions import exprs as X
from scantable.operators import ranking, votes


def test_names(spark, rows):
    df = spark.createDataFrame([("Mask_Graph\t",), ("-",), (None,), ("mask graph",)], "s string")
    assert rows(df.select(same_name("s"))) == [("maskgraph",), ("maskgraph",), (None,), (None,)]


def test_rules():
    assert X.parse_rules("a=1,b:2,bad,=3,c=x") == {"a": 1.0, "b": 2.0}
    assert X.parse_list(" , ") is None and X.parse_list("a, b") == ["a", "b"]


def test_rule_lookup_order(spark, rows):
    df = spark.createDataFrame([("mask_graph_x",), ("bpr",), (None,)], "s string")
    assert rows(df.select(X.rule_lookup({"graph": 0.3, "mask": 0.9, "bpr": 0.5}, [F.col("s")], 1.0))) == [(0.3,), (0.5,), (1.0,)]


def test_box_iou_floor_and_empty(spark):
    one = spark.range(1)
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = one.select(X.box_iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), X.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("b"), X.box_iou(box(0, 0, 0.1, 0.1), box(0, 0, 0.1, 0.1), 1.0).alias("c")).first()
    assert abs(r.a - 1 / 7) < 1e-12 and r.b is None and abs(r.c - 0.01) < 1e-12


def test_safe_double(spark, rows):
    df = spark.createDataFrame([("1.5",), ("nan",), ("x",), (None,), ("inf",)], "s string")
    assert rows(df.select(X.safe_double("s", 0.0))) == [(0.0,)] * 4 + [(1.5,)]


def test_threshold_or_best(spark, rows):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.1), ("b", 3, 0.2), ("b", 4, 0.2), ("c", 5, None)], "g string, id long, s double")
    assert rows(ranking.threshold_or_best(df, ["g"], "s", 0.5, "id"), "id") == [(1,), (3,), (5,)]
    assert ranking.threshold_or_best(df.limit(0), ["g"], "s", 0.5, "id").count() == 0


def test_review_list_joins_reasons(spark, rows):
    df = spark.createDataFrame([("scene_a", 0.1, 2), ("scene_b", 0.4, 9), ("scene_c", 0.2, 3)], "s string, cov double, n int")
    got = ranking.review_list(df, "s", [("low_coverage", F.col("cov").asc(), 1), ("high_instance_count", F.col("n").desc(), 1)])
    assert rows(got) == [("scene_a", "low_coverage"), ("scene_b", "high_instance_count")]
    assert rows(ranking.review_list(df, "s", [("low", F.col("cov").asc(), 1), ("few", F.col("n").asc(), 1)])) == [("scene_a", "few;low")]


def test_seeded_splits(spark):
    ids = spark.createDataFrame([(f"scene{i:04d}_00",) for i in range(240)], "s string")
    a, b = (sorted(tuple(r) for r in ranking.seeded_splits(ids, "s", 17).collect()) for _ in range(2))
    assert a == b
    small, large, odd = ({r[0] for r in a if r[i]} for i in (1, 2, 3))
    assert (len(small), len(large), len(odd)) == (48, 96, 96) and small < large and not large & odd
    with pytest.raises(ValueError, match="Need at least"):
        ranking.seeded_splits(ids.limit(100), "s", 17)


def test_distributed_rank_equals_window(spark):
    data = [("hot" if i % 3 else f"g{i % 7}", i % 11, i) for i in range(500)] + [(None, 1, 1000), (None, None, 1001)]
    df = spark.createDataFrame(data, "g string, s int, id long")
    order = [F.col("s").desc_nulls_last(), F.col("id")]
    from pyspark.sql import Window

    want = {(r.id, r.n) for r in df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(*order)).alias("n")).collect()}
    assert {(r.id, r["rank"]) for r in distributed_rank(df, ["g"], order).collect()} == want
    assert distributed_rank(df.limit(0), ["g"], order).count() == 0


def test_votes(spark, rows):
    df = spark.createDataFrame([(1, 4), (1, 3), (1, -1), (2, -1)], "k long, l int")
    assert rows(votes.class_vote(df, ["k"], "l", 9)) == [(1, 3, 1 / 3), (2, 9, 0.0)]
    assert rows(votes.label_distribution(df, ["k"], "l")) == [(1, 3, 1.0), (1, 4, 1.0)]
    ev = spark.createDataFrame([(1, 5, 5, 0.6), (1, 5, 6, 0.2), (1, 5, 7, 0.2), (2, 1, 1, 0.0)], "k long, t int, l int, e double")
    r = votes.label_consensus(ev, ["k"], "l", "e", "t").collect()
    assert len(r) == 1 and abs(r[0].label_margin - 0.4) < 1e-9 and r[0].top_conflict == 6
    assert abs(votes.noisy_or(spark.createDataFrame([(1, 0.5), (1, 0.5), (1, None)], "k long, c double"), ["k"], "c").first().evidence - 0.75) < 1e-12


def test_rule_effect(spark):
    df = spark.createDataFrame([(True, 1, 2, 2), (True, 2, 1, 2), (True, 1, 3, 2), (False, 1, 2, 2)], "f boolean, b int, a int, t int")
    assert tuple(votes.rule_effect(df, "f", "b", "a", "t").first()) == (3, 1, 1, 1, 0)


def test_observation_scores(spark):
    # a candidate's score is the mean of detector times mask score over its observations
    df = spark.createDataFrame([(4, 0.8, 0.5), (4, 0.6, 1.0)], "id long, score double, sam double")
    assert df.groupBy("id").agg(F.avg(F.col("score") * F.col("sam")).alias("s")).first().s == 0.5
