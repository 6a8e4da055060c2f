"""Pairs of views, shapes, meshes, buckets and box matching on small cases; empty tables and nulls."""

import math

import numpy as np
from pyspark.sql import functions as F

from scantable.operators import evaluate, geometry, pairs
from scantable.sources import readers


def _views(spark):
    members = spark.createDataFrame([("s", 1, p) for p in range(6)] + [("s", 2, p) for p in range(3, 9)], "scene string, obs long, point_id long")
    seen = spark.createDataFrame([("s", 10, p, 1.0, 1.01 if p < 5 else 2.0) for p in range(9)] + [("s", 20, p, 1.0, 0.0 if p == 4 else 1.0) for p in range(4, 9)], "scene string, frame_id int, point_id long, expected double, measured double")
    masks = spark.createDataFrame([("s", 1, p) for p in range(6)] + [("s", 2, p) for p in range(4, 9)], "scene string, obs long, point_id long")
    return members, seen, masks


def test_directed_depth(spark):
    members, seen, masks = _views(spark)
    ways = spark.createDataFrame([("s", 1, 2, 20), ("s", 2, 1, 10), ("s", 1, 9, 99)], "scene string, src long, dst long, frame_id int")
    got = {(r.src, r.dst): r for r in pairs.directed_depth(ways, members, seen, masks).collect()}
    a, b, c = got[1, 2], got[2, 1], got[1, 9]
    assert (a.input, a.valid, a.consistent, a.inside, a.inside_consistent) == (6, 1, 1, 1, 1)  # point 4 isn't measured, 0 to 3 aren't seen
    assert (b.input, b.valid, b.consistent, b.inside, b.inside_consistent) == (6, 6, 2, 3, 2) and math.isclose(b.conflict_ratio, 4 / 6) and b.median_error == 1.0
    assert (c.valid, c.consistent_ratio, c.median_error) == (0, 0.0, 0.0)
    assert pairs.directed_depth(ways.limit(0), members, seen, masks).count() == 0


def test_mutual_visibility_and_relation(spark):
    members, seen, masks = _views(spark)
    prs = spark.createDataFrame([("s", 1, 2, 10, 20)], "scene string, a long, b long, frame_a int, frame_b int")
    v = pairs.mutual_visible(prs, members, seen.select("scene", "frame_id", "point_id"), masks)
    r = v.first()
    # 1 sees of 2 (frame 10): points 3 to 8, of its mask 3 to 5; 2 sees of 1 (frame 20): 4 and 5, both in its mask
    assert (r.visible_ab, r.inside_ab, r.visible_ba, r.inside_ba, r.shared) == (2 / 6, 1.0, 1.0, 0.5, 2)
    assert math.isclose(r.visible_iou, 2 / 3) and r.visible_containment == 1.0
    ways = spark.createDataFrame([("s", 1, 2, 20), ("s", 2, 1, 10)], "scene string, src long, dst long, frame_id int")
    got = pairs.pair_relation(pairs.directed_depth(ways, members, seen, masks), v, least_valid=1).first()
    assert got.relation == "containment" and not got.hard_conflict and got.judgeable


def test_bucket_pairs_both_forms(spark):
    rows = [(7, 1, 0, 0.1), (7, 2, 1, 0.9), (7, 3, 2, 0.8), (7, 4, 3, 0.2), (7, 5, 3, None), (None, 6, 1, 0.5), (8, 9, None, 0.5), (8, 10, None, 0.4)]
    df = spark.createDataFrame(rows, "seg int, id long, frame int, conf double")
    exact = {tuple(r) for r in pairs.bucket_pairs(df, "seg", "id", "frame", "conf", 2).collect()}
    assert exact == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (2, 5), (3, 5), (9, 10)}  # 1 met 2 and 3 before it had to leave
    assert {tuple(r) for r in pairs.bucket_pairs(df, "seg", "id", "frame", "conf", 2, exact=False).collect()} == {(2, 3), (9, 10)}
    assert pairs.bucket_pairs(df.limit(0), "seg", "id", "frame", "conf", 2).count() == 0


def test_eigenvalues_and_shapes(spark):
    rng = np.random.default_rng(2)
    sets = [(k, *map(float, p)) for k, scale in enumerate([(1, 1, 1), (5, 1, 0.1), (3, 0, 0), (0, 0, 0)]) for p in rng.normal(size=(40, 3)) * scale]
    df = spark.createDataFrame(sets, "k int, x double, y double, z double")
    for r in geometry.shape_features(df, ["k"]).collect():
        pts = np.array([s[1:] for s in sets if s[0] == r.k])
        e = np.clip(np.linalg.eigvalsh(np.cov(pts.T, bias=True))[::-1], 0, None)
        want = (0, 0, 0) if e[0] <= 1e-12 else ((e[0] - e[1]) / e[0], (e[1] - e[2]) / e[0], e[2] / e[0])
        assert np.allclose((r.linearity, r.planarity, r.scattering), want, atol=1e-6) and abs(r.extent_x - np.ptp(pts[:, 0])) < 1e-12
    assert geometry.shape_features(df.limit(0), ["k"]).count() == 0


def test_mesh_weights_square_convex_edges(spark):
    xyz = np.array([[0.1, 0, 0.6], [1, 1.1, 0], [-1.2, 0.9, 0.1], [-1, -0.7, 0.02], [1.1, -0.8, 0.05]])
    tri = [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 1)]
    normals = np.zeros((5, 3))
    for t in tri:
        n = np.cross(xyz[t[1]] - xyz[t[0]], xyz[t[2]] - xyz[t[0]])
        for v in t:
            normals[v] += n / np.linalg.norm(n)
    normals /= np.array([sum(v in t for t in tri) for v in range(5)])[:, None]
    want, convex = {}, 0
    for a, b, c in tri:
        for x, y in ((a, b), (a, c), (c, b)):
            bend = 1 - normals[x] @ normals[y]
            out = normals[y] @ (xyz[y] - xyz[x]) > 0
            want[x, y] = bend**2 if out else bend
            convex += out
    points = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(xyz)], "scene string, point_id long, x double, y double, z double")
    faces = spark.createDataFrame([("s", *t) for t in tri], "scene string, v0 long, v1 long, v2 long")
    got = {(r.left, r.right): r.weight for r in geometry.mesh_weights(points, faces, ["scene"]).collect()}
    assert convex and set(got) == set(want) and {k: (got[k], want[k]) for k in want if not math.isclose(got[k], want[k], abs_tol=1e-9)} == {}


def test_oriented_boxes(spark):
    turn = math.pi / 4
    rows = [
        ((0, 0, 0, 2, 2, 2, 0), (0, 0, 0, 2, 2, 2, 0), 1.0), ((0, 0, 0, 2, 2, 2, 0), (1, 0, 0, 2, 2, 2, 0), 1 / 3), ((0, 0, 0, 2, 2, 2, 0), (5, 0, 0, 2, 2, 2, turn), 0.0), ((0, 0, 0, 2, 2, 2, 0), (0, 0, 3, 2, 2, 2, 0), 0.0),
        ((0, 0, 0, 4, 2, 1, 0), (0, 0, 0, 4, 2, 1, 2 * turn), 4 / 12), ((0, 0, 0, 2, 2, 2, 0), (0, 0, 0, 2, 2, 2, turn), 8 * (math.sqrt(2) - 1) / (8 - 8 * (math.sqrt(2) - 1))), ((0, 0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0), 0.0),
    ]
    df = spark.createDataFrame([(*map(float, a), *map(float, b), w) for a, b, w in rows], ", ".join(f"a{i} double" for i in range(7)) + ", " + ", ".join(f"b{i} double" for i in range(7)) + ", w double")
    got = df.select("w", geometry.oriented_iou([F.col(f"a{i}") for i in range(7)], [F.col(f"b{i}") for i in range(7)]).alias("iou")).collect()
    assert all(abs(r.iou - r.w) < 1e-9 for r in got)


def test_box_outcomes_and_eleven_points(spark):
    p = spark.createDataFrame([("s", 1, 10, 0.6), ("s", 2, 10, 0.7), ("s", 3, 10, 0.3)], "k string, pred_id long, gt_id long, iou double")
    preds = spark.createDataFrame([("s", 1, 0.9), ("s", 2, 0.8), ("s", 3, 0.7), ("s", 4, 0.95)], "k string, pred_id long, score double")
    out = evaluate.box_outcomes(p, preds, ["k"], (0.5,))
    assert {(r.pred_id, r.positive) for r in out.collect()} == {(1, 1), (2, 0), (3, 0), (4, 0)}
    area = evaluate.voc_ap(out, ["k"], "score", "positive", "pred_id").first().ap
    eleven = evaluate.voc_ap(out, ["k"], "score", "positive", "pred_id", eleven=True).first().ap
    assert area == 0.5 and math.isclose(eleven, 0.5)
    assert evaluate.voc_ap(out.limit(0), ["k"], "score", "positive", "pred_id").count() == 0


def test_nulls_share_a_cap(spark, rows):
    from scantable.operators.greedy import admit

    df = spark.createDataFrame([("s", i, 1.0 - i / 10, None, None, True) for i in range(4)] + [("s", 9, 0.1, "a", 1, True)], "k string, id long, q double, src string, c int, ok boolean")
    assert rows(admit(df, ["k"], "id", "q", "src", "c", "ok", 9, 2), "id", "decision") == [(0, "accepted"), (1, "accepted"), (2, "class_limit"), (3, "class_limit"), (9, "accepted")]


def test_a_long_chain_of_conflicts(spark):
    from scantable.operators import greedy

    n = 3000
    rows = spark.range(n).selectExpr("'s' AS k", "id AS worse")
    chain = spark.range(n - 1).selectExpr("'s' AS k", "id AS better", "id + 1 AS worse")
    assert sorted(r.worse for r in greedy.suppress(rows, ["k"], chain, "better", "worse").collect()) == list(range(0, n, 2))


def test_neighbours_far_beyond_the_radius(spark):
    df = spark.createDataFrame([("s", i, float(10**i), 0.0) for i in range(7)], "k string, a long, x double, y double")
    got = {(r.a, r.b) for r in geometry.nearest(df, df.withColumnRenamed("a", "b"), ["k"], ["x", "y"], 1, 0.001).collect()}
    assert got == {(0, 1), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)}


def test_scan_files(spark, tmp_path, rows):
    (tmp_path / "scene7").mkdir()
    np.save(tmp_path / "scene7" / "points.npy", np.arange(6.0).reshape(3, 2))
    assert rows(readers.read_arrays(spark, str(tmp_path / "scene7" / "points.npy"), ["x", "y"])) == [("points", 0, 0.0, 1.0), ("points", 1, 2.0, 3.0), ("points", 2, 4.0, 5.0)]
    (tmp_path / "scene7" / "pose.txt").write_text("1 0 0\n0 1.5 0\n\n")
    m = readers.read_matrices(spark, str(tmp_path / "scene7" / "pose.txt")).first()
    assert (m.scene, m["name"], m.rows, m["columns"], m["values"]) == ("scene7", "pose", 2, 3, [1.0, 0.0, 0.0, 0.0, 1.5, 0.0])
    (tmp_path / "scene7" / "12.pgm").write_bytes(b"P5\n# depth\n2 2\n65535\n" + np.array([0, 1000, 500, 0], dtype=">u2").tobytes())
    assert rows(readers.read_depth(spark, str(tmp_path / "scene7" / "12.pgm"), 1000.0)) == [("scene7", 12, 0, 1, 0.5), ("scene7", 12, 1, 0, 1.0)]
    assert rows(readers.audit_files(spark, str(tmp_path / "scene7" / "pose.txt")), "length")[0][0] == 15
    (tmp_path / "t.csv").write_text("a,b\n1,x\nz,y\n")
    assert rows(readers.read_table(spark, str(tmp_path / "t.csv"), "a int, b string")) == [(1, "x"), (None, "y")]
    spark.range(2).write.parquet(str(tmp_path / "train"))
    spark.range(1).selectExpr("id", "'v' AS extra").write.parquet(str(tmp_path / "validation"))
    assert rows(readers.read_modes(spark, str(tmp_path), ["train", "validation"]), "id", "mode", "extra") == [(0, "train", None), (0, "validation", "v"), (1, "train", None)]


def test_colourised_export(spark, tmp_path, rows):
    points = spark.createDataFrame([(s, i, float(i), 0.0, 1.0) for s in ("s", "t") for i in range(4)], "scene string, point_id long, x double, y double, z double")
    masks = spark.createDataFrame([("s", 1, 5, 0.9, [0, 1]), ("s", 2, 5, 0.95, [1, 2]), ("s", 3, 6, 0.05, [3])], "scene string, mask_id long, class_id int, score double, point_ids array<long>")
    readers.write_colourised(points, masks, str(tmp_path / "out"))
    got = rows(readers.read_points(spark, str(tmp_path / "out" / "s.ply")), "point_id", "x", "r")
    grey = 128 / 255
    assert [abs(r[2] - grey) < 1e-6 for r in got] == [True, False, False, True] and [r[1] for r in got] == [0.0, 1.0, 2.0, 3.0]
    assert rows(readers.read_points(spark, str(tmp_path / "out" / "t.ply")), "x") == [(0.0,), (1.0,), (2.0,), (3.0,)]
