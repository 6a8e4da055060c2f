"""Overlap, partitions and purity on small hand-made sets."""

from pyspark.sql import functions as F

from scantable.operators import sets


def test_partition_split_without_merge(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 2), (1, 2)], "ref int, cmp int")
    r = sets.partition_overlap(df, [], "ref", "cmp").first()
    assert (r.reference_segments, r.compared_segments, r.split_reference_segments, r.split_reference_points, r.merged_compared_segments) == (2, 3, 1, 3, 0)


def test_partition_split_and_merge(spark):
    df = spark.createDataFrame([("s", 0, 0), ("s", 0, 1), ("s", 1, 1), ("s", 1, 2), ("s", 2, 2), ("s", None, 2)], "b string, ref int, cmp int")
    r = sets.partition_overlap(df, ["b"], "ref", "cmp").first()
    assert (r.split_reference_segments, r.merged_compared_segments, r.point_count) == (2, 2, 5)


def test_purity(spark):
    df = spark.createDataFrame([("s", 0, 3), ("s", 0, 3), ("s", 0, 4), ("s", 1, 7), ("s", 1, 7)], "b string, seg int, t int")
    pure = sets.purity(df, ["b"], "seg", "t")
    r = sets.purity_summary(pure, ["b"]).first()
    assert (r.mixed_segments, r.mixed_points, round(r.weighted_purity, 9)) == (1, 3, 0.8)
    assert pure.where("seg = 0").first().majority_label == 3


def test_purity_ties_and_negative_labels(spark, rows):
    df = spark.createDataFrame([("s", 0, 5), ("s", 0, 4), ("s", 1, -1), ("s", 1, None)], "b string, seg int, t int")
    assert rows(sets.purity(df, ["b"], "seg", "t"), "seg", "n", "majority_label", "majority_share") == [(0, 2, 4, 0.5), (1, 2, -1, 0.0)]


def test_overlap_pairs(spark, rows):
    a = spark.createDataFrame([("s", 1, i) for i in range(4)] + [("s", 2, i) for i in range(2, 5)] + [("t", 3, 0)], "b string, a long, item long")
    got = rows(sets.overlap_pairs(a, a.withColumnRenamed("a", "c"), ["b"], "a", "c", extra=F.col("a") < F.col("c")), "a", "c", "inter", "iou", "containment")
    assert got == [(1, 2, 2, 2 / 5, 2 / 3)]
    empty = a.limit(0)
    assert sets.overlap_pairs(empty, empty.withColumnRenamed("a", "c"), ["b"], "a", "c").count() == 0


def test_shared_cells_removed_from_all(spark, rows):
    first = [(0, 1, 0, x) for x in range(3)] + [(1, 1, 1, 1)]
    second = [(0, 2, 0, x) for x in range(1, 4)] + [(1, 2, 1, 1)]
    df = spark.createDataFrame(first + second, "frame int, track int, px int, py int")
    got = rows(sets.shared_cells(df, ["frame"], ["px", "py"], "track", 2), "frame", "track", "px", "py")
    assert got == [(0, 1, 0, 0), (0, 2, 0, 3), (1, 1, 1, 1), (1, 2, 1, 1)]


def test_smallest_owner(spark):
    masks = [(x, y, 9, 2) for x in range(3) for y in range(3)] + [(x, y, 4, 1) for x in (1, 2) for y in (1, 2)]
    df = spark.createDataFrame(masks, "px int, py int, area int, label int")
    own = {(r.px, r.py): r.label for r in sets.smallest_owner(df, ["px", "py"], "area", "label").collect()}
    assert own[1, 1] == 1 and own[0, 0] == 2 and (3, 3) not in own


def test_ambiguous_owner_is_nobody(spark, rows):
    df = spark.createDataFrame([("s", 0, 1, 3.0), ("s", 0, 2, 3.0), ("s", 1, 1, 3.0), ("s", 1, 2, 1.0), ("s", 2, 5, 0.1)], "b string, cell int, owner long, w double")
    assert rows(sets.own_segments(df, ["b", "cell"], "owner", "w"), "cell", "owner") == [(1, 1), (2, 5)]


def test_explode_sets_cleans(spark, rows):
    df = spark.createDataFrame([(1, [3, 3, None, -2, 5]), (2, None), (3, [])], "id long, v array<long>")
    assert rows(sets.explode_sets(df, "v", "id")) == [(1, 3), (1, 5)]


def test_similar_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = {(rng.choice("ab"), i, x) for i in range(60) for x in [1, 2] + random.Random(i // 5).sample(range(40), 12) if rng.random() > 0.12}
    df = spark.createDataFrame(sorted(rows), "k string, id long, item long")
    held = {}
    for k, i, x in rows:
        held.setdefault((k, i), set()).add(x)
    for t in (0.5, 0.8):
        want = {(k, i, j) for k, i in held for m, j in held if k == m and i < j and len(held[k, i] & held[k, j]) > t * len(held[k, i] | held[k, j])}
        assert {(r.k, r.a, r.b) for r in sets.similar_pairs(df, ["k"], "id", t).collect()} == want
    assert sets.similar_pairs(df.limit(0), ["k"], "id", 0.5).count() == 0
