"""Geometry and average precision against brute force."""

import math
import random

import numpy as np

from scantable.operators import evaluate, geometry


def test_near_pairs_and_nearest_are_exact(spark):
    rng = random.Random(1)
    pts = [("s", i, rng.random(), rng.random(), rng.random()) for i in range(60)]
    df = spark.createDataFrame(pts, "k string, a long, x double, y double, z double")
    other = df.withColumnRenamed("a", "b")
    d2 = lambda p, q: sum((u - v) ** 2 for u, v in zip(p[2:], q[2:]))
    want = {(p[1], q[1]) for p in pts for q in pts if d2(p, q) <= 0.04}
    assert {(r.a, r.b) for r in geometry.near_pairs(df, other, ["k"], ["x", "y", "z"], 0.2).collect()} == want
    got = {}
    for r in geometry.nearest(df, other, ["k"], ["x", "y", "z"], 3, 0.05).collect():
        got.setdefault(r.a, {})[r.place] = r.b
    for p in pts:
        best = sorted((d2(p, q), q[1]) for q in pts if q[1] != p[1])[:3]
        assert [got[p[1]][i] for i in (1, 2, 3)] == [b for _, b in best]


def test_nearest_of_too_few(spark):
    df = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 1.0, 0.0), ("t", 3, 0.0, 0.0)], "k string, a long, x double, y double")
    got = geometry.nearest(df, df.withColumnRenamed("a", "b"), ["k"], ["x", "y"], 2, 0.3).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 2), (2, 1)]


def test_mesh_edges_and_normals(spark, rows):
    faces = spark.createDataFrame([("s", 0, 1, 2)], "scene string, v0 long, v1 long, v2 long")
    assert rows(geometry.mesh_edges(faces, ["scene"]), "left", "right") == [(0, 1), (0, 2), (2, 1)]
    points = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0), ("s", 1, 1.0, 0.0, 0.0), ("s", 2, 0.0, 1.0, 0.0)], "scene string, point_id long, x double, y double, z double")
    assert rows(geometry.vertex_normals(points, faces, ["scene"]), "point_id", "nz") == [(0, 1.0), (1, 1.0), (2, 1.0)]


def test_boundary_cut(spark, rows):
    edges = spark.createDataFrame([("s", 0, 1), ("s", 1, 2), ("s", 2, 9)], "scene string, left long, right long")
    labels = spark.createDataFrame([("s", 0, i, v) for i, v in enumerate((1, 2, 2))], "scene string, frame_id int, point_id long, label int")
    assert rows(geometry.boundary_cuts(edges, labels, ["scene"], 1, 1.0), "left", "keep") == [(0, False), (1, True), (2, True)]


def test_projection_truncates_and_borders(spark, rows):
    points = spark.createDataFrame([("s", 0, -0.5, 0.0, 1.0), ("s", 1, 1.9, 1.0, 1.0), ("s", 2, 0.0, 0.0, 0.0)], "scene string, point_id long, x double, y double, z double")
    eye = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    frames = spark.createDataFrame([("s", 0, [float(v) for v in eye], 1.0, 1.0, 0.0, 0.0)], "scene string, frame_id int, pose array<double>, fx double, fy double, cx double, cy double")
    proj = geometry.project(points, frames)
    assert rows(proj, "point_id", "px", "py") == [(0, 0, 0), (1, 1, 1)]
    depth = spark.createDataFrame([("s", 0, 0, 0, 1.0), ("s", 0, 1, 1, 1.04)], "scene string, frame_id int, px int, py int, depth double")
    assert rows(geometry.visible(proj, depth, 4, 4), "point_id") == [(1,)]


def _loop_ap(scores, positive, missed):
    y = sorted(zip(scores, positive))
    s, t = np.array([a for a, _ in y]), np.cumsum([b for _, b in y])
    _, first = np.unique(s, return_index=True)
    total = t[-1]
    p, r = [], []
    for i in first:
        below = t[i - 1] if i else 0
        tp = total - below
        p.append(tp / (len(s) - i))
        r.append(tp / (tp + below + missed))
    p.append(1.0)
    r.append(0.0)
    steps = np.convolve([r[0], *r, 0.0], [-0.5, 0, 0.5], "valid")
    return float(np.dot(p, steps))


def test_closed_form_ap_equals_convolution(spark):
    rng = random.Random(9)
    data, want = [], {}
    for k in range(25):
        n, missed = rng.randrange(1, 14), rng.randrange(0, 4)
        scores = [round(rng.random(), 1) for _ in range(n)]
        pos = [rng.randrange(2) for _ in range(n)]
        if sum(pos) + missed == 0:
            pos[0] = 1
        data += [(k, s, p) for s, p in zip(scores, pos)] + [(k, None, 1)] * missed
        want[k] = _loop_ap(scores, pos, missed)
    got = {r.k: r.ap for r in evaluate.average_precision(spark.createDataFrame(data, "k int, score double, positive int"), ["k"]).collect()}
    assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_ap_without_predictions_or_instances(spark, rows):
    df = spark.createDataFrame([(1, None, 1), (2, 0.5, 0)], "k int, score double, positive int")
    assert rows(evaluate.average_precision(df, ["k"])) == [(1, 0.0), (2, None)]


def test_matching_rules(spark):
    # instance 7 is taken by prediction 1; 2 overlaps it too: the lower score is a false positive; 3 hits nothing; 4 is mostly void
    pts = [("s", 1, i) for i in range(10)] + [("s", 2, i) for i in range(9)] + [("s", 3, i) for i in range(20, 26)] + [("s", 4, i) for i in range(50, 60)]
    preds = [("s", 1, 0, 0.6), ("s", 2, 0, 0.9), ("s", 3, 0, 0.4), ("s", 4, 0, 0.8)]
    gt = [("s", i, 7) for i in range(10)] + [("s", i, 8) for i in range(20, 40)] + [("s", 99, 9)]
    good, inst, pairs = evaluate.assign(
        spark.createDataFrame(pts, "scene string, pred_id long, point long"), spark.createDataFrame(preds, "scene string, pred_id long, class_id int, score double"),
        spark.createDataFrame(gt, "scene string, point long, gt_id long"), spark.createDataFrame([("s", 7, 0), ("s", 8, 0), ("s", 9, 0)], "scene string, gt_id long, class_id int"), spark.createDataFrame([(0,)], "class_id int"), 5,
    )
    out = sorted(((r.score, r.positive) for r in evaluate.match(good, inst, pairs, 5, (0.5,)).collect()), key=repr)
    assert out == sorted([(0.9, 1), (0.6, 0), (None, 1), (0.4, 0)], key=repr)


def test_matching_with_conflicts_equals_the_loop(spark):
    rng = random.Random(3)
    pts, preds, gt, gts = [], [], [], []
    for scene in range(6):
        for i in range(60):
            gt.append((f"s{scene}", i, i // 6))
        gts += [(f"s{scene}", g, 0) for g in range(10)]
        for p in range(14):
            a = rng.randrange(50)
            pts += [(f"s{scene}", p, x) for x in range(a, a + rng.randrange(4, 13))]
            preds.append((f"s{scene}", p, 0, round(rng.random(), 1)))
    good, inst, pairs = evaluate.assign(
        spark.createDataFrame(pts, "scene string, pred_id long, point long"), spark.createDataFrame(preds, "scene string, pred_id long, class_id int, score double"),
        spark.createDataFrame(gt, "scene string, point long, gt_id long"), spark.createDataFrame(gts, "scene string, gt_id long, class_id int"), spark.createDataFrame([(0,)], "class_id int"), 3,
    )
    got = sorted(((r.overlap, r.score, r.positive) for r in evaluate.match(good, inst, pairs, 3, (0.25, 0.5)).collect()), key=repr)
    size, own = {}, {}
    for s, p, x in pts:
        size[s, p] = size.get((s, p), 0) + 1
        if x < 60:
            own[s, p, x // 6] = own.get((s, p, x // 6), 0) + 1
    iou = lambda s, p, g: own.get((s, p, g), 0) / (6 + size[s, p] - own.get((s, p, g), 0))
    want = []
    for th in (0.25, 0.5):
        for scene in range(6):
            s, taken = f"s{scene}", set()
            score = {p: v for q, p, _, v in preds if q == s}
            for g in range(10):
                held = None
                for p in range(14):
                    if p in taken or not iou(s, p, g) > th:
                        continue
                    if held is None:
                        held = score[p]
                        taken.add(p)
                    else:
                        want.append((th, min(held, score[p]), 0))
                        held = max(held, score[p])
                want.append((th, held, 1))
            for p in range(14):
                void = size[s, p] - sum(own.get((s, p, g), 0) for g in range(10))
                if all(iou(s, p, g) <= th for g in range(10)) and void / size[s, p] <= th:
                    want.append((th, score[p], 0))
    assert got == sorted(want, key=repr)
