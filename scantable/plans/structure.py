"""Queries over suppression, graphs, geometry, point grids, average precision, and composites of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scantable.common import cut, table
from scantable.operators import evaluate, geometry, graph, greedy, ranking, sets
from scantable.plans.evidence import IOU, PAIRS, box_pairs, seed_pairs
from scantable.plans.registry import query, recursive, suppression
from scantable.plans.views import cand, links, obs, pts, vec, with_views


def _seed_scores(spark: SparkSession, d: str, points: DataFrame | None = None) -> DataFrame:
    """Seeds with the class, score and size: those of the candidate's last record. points: pts() if it is there already."""
    last = cand(spark, d).groupBy("scene_name", "candidate_id").agg(F.max_by(F.struct("class_id", "score"), "record_id").alias("l"))
    size = (pts(spark, d) if points is None else points).groupBy("scene_name", "candidate_id").agg(F.count(F.lit(1)).alias("n"))
    return size.join(last, ["scene_name", "candidate_id"], "left").select("scene_name", "candidate_id", "n", F.col("l.class_id").alias("class_id"), F.coalesce("l.score", F.lit(0.0)).alias("score"))


RANKED = """, l AS (SELECT scene_name, candidate_id, arg_max(score, record_id) AS score, max_by(struct_pack(c := class_id), record_id).c AS class_id FROM cand GROUP BY 1, 2),
    s AS (SELECT z.scene_name, z.candidate_id, z.n, l.class_id, coalesce(l.score, 0) AS score FROM z LEFT JOIN l ON l.scene_name = z.scene_name AND l.candidate_id = z.candidate_id)"""


# ---- suppression


@query()
def n1_mask_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Seeds left by greedy suppression at IoU over 0.5, best score first."""
    s = cut(_seed_scores(spark, d))
    rank = lambda c: s.select("scene_name", F.col("candidate_id").alias(c), F.struct(-F.col("score"), F.col("candidate_id")).alias(f"r{c}"))
    pairs = sets.similar_pairs(pts(spark, d), ["scene_name"], "candidate_id", 0.5).select("scene_name", "a", "b").join(rank("a"), ["scene_name", "a"]).join(rank("b"), ["scene_name", "b"])
    conflicts = greedy.directed(pairs, ["scene_name"], "a", "b", F.col("ra"), F.col("rb"))
    return greedy.suppress(s.withColumnRenamed("candidate_id", "worse"), ["scene_name"], conflicts, "better", "worse").select("scene_name", F.col("worse").alias("candidate_id"), "score")


@query()
def n4_duplicate_removal(spark: SparkSession, d: str) -> DataFrame:
    """Seeds left when IoU or containment make a later one a duplicate, by score, size, id."""
    s = cut(_seed_scores(spark, d))
    rank = lambda c: s.select("scene_name", F.col("candidate_id").alias(c), F.struct(-F.col("score"), -F.col("n"), F.col("candidate_id")).alias(f"r{c}"))
    pairs = seed_pairs(spark, d).where("iou >= 0.6 or containment >= 0.8").select("scene_name", "a", "b").join(rank("a"), ["scene_name", "a"]).join(rank("b"), ["scene_name", "b"])
    conflicts = greedy.directed(pairs, ["scene_name"], "a", "b", F.col("ra"), F.col("rb"))
    return greedy.suppress(s.withColumnRenamed("candidate_id", "worse"), ["scene_name"], conflicts, "better", "worse").select("scene_name", F.col("worse").alias("candidate_id"))


@query()
def n3_box_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a frame left by suppression of the same class at IoU of 0.3 or more."""
    o = obs(spark, d).where("class_id is not null and score is not null and frame_index is not null")
    pairs = box_pairs(spark, d, overlapping=True).where("a_class_id = b_class_id and iou >= 0.3 and a_score is not null and b_score is not null")
    rank = lambda s: F.struct(-F.col(f"{s}_score"), F.col(f"{s}_observation_id"))
    conflicts = greedy.directed(pairs, ["scene_name", "frame_index"], "a_observation_id", "b_observation_id", rank("a"), rank("b"))
    rows = o.select("scene_name", "frame_index", F.col("observation_id").alias("worse"))
    return greedy.suppress(rows, ["scene_name", "frame_index"], conflicts, "better", "worse").select(F.col("worse").alias("observation_id"))


@query(with_views("cand pts", PAIRS + RANKED + " SELECT scene_name, candidate_id FROM z WHERE (scene_name, candidate_id) NOT IN (SELECT (scene_name, b) FROM pairs WHERE inter / size_a::DOUBLE > 0.7)"))
def n2_overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    """Seeds that don't overlap an earlier one by over 0.7 of that one's size; a dropped one still blocks."""
    rows = pts(spark, d).select("scene_name", "candidate_id").distinct()
    return greedy.overlap_filter(seed_pairs(spark, d), rows, ["scene_name"], "candidate_id", 0.7)


@query(with_views("pts", PAIRS + " SELECT scene_name, candidate_id FROM z WHERE (scene_name, candidate_id) NOT IN (SELECT (scene_name, CASE WHEN size_a < size_b THEN a ELSE b END) FROM pairs WHERE inter >= least(size_a, size_b) * 0.9)"))
def n9_inclusion_removal(spark: SparkSession, d: str) -> DataFrame:
    """Seeds that don't lie in another one by 0.9 of their points."""
    rows = pts(spark, d).select("scene_name", "candidate_id").distinct()
    return greedy.drop_included(seed_pairs(spark, d), rows, ["scene_name"], "candidate_id", "n", 0.9)


@query(with_views("cand pts", PAIRS + RANKED + """, o AS (SELECT p.scene_name, p.item, p.candidate_id, s.score, row_number() OVER (PARTITION BY p.scene_name, p.item ORDER BY s.score DESC, p.candidate_id) AS r FROM pts p JOIN s USING (scene_name, candidate_id))
    SELECT scene_name, item, max(candidate_id) FILTER (WHERE r = 1) AS candidate_id FROM o WHERE r <= 2 GROUP BY 1, 2 HAVING max(score) FILTER (WHERE r = 2) IS NULL OR max(score) FILTER (WHERE r = 2) < max(score) FILTER (WHERE r = 1) * 0.9"""))
def n12_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Owner of every point by score; nobody where the second comes near."""
    claims = pts(spark, d).join(_seed_scores(spark, d).select("scene_name", "candidate_id", "score"), ["scene_name", "candidate_id"])
    return sets.own_segments(claims, ["scene_name", "item"], "candidate_id", "score", 0.9)


@query()
def n7_merge_sets(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of a scene and class merged to a fixpoint at IoU 0.5."""
    p = cut(pts(spark, d))
    rows = _seed_scores(spark, d, p).where("class_id is not null")
    labelled = p.join(rows.select("scene_name", "candidate_id", "class_id"), ["scene_name", "candidate_id"])
    parts = greedy.linked_sets(labelled, ["scene_name", "class_id"], "candidate_id")
    arrays = p.groupBy("scene_name", "candidate_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sets_ = rows.join(arrays, ["scene_name", "candidate_id"]).join(parts, ["scene_name", "class_id", "candidate_id"])
    out = greedy.merge_sets(sets_, ["scene_name", "class_id", "part"], "candidate_id", "score", "items", 0.5)
    return out.drop("part").withColumn("members", F.concat_ws(",", F.col("members").cast("array<string>")))


@query(with_views("pts", """, z AS (SELECT scene_name, candidate_id, count(*) AS n FROM pts GROUP BY 1, 2) SELECT p.scene_name, item, arg_min(candidate_id, (n, candidate_id)) AS candidate_id FROM pts p JOIN z USING (scene_name, candidate_id) GROUP BY 1, 2"""))
def geo_smallest_owner(spark: SparkSession, d: str) -> DataFrame:
    """Every point belongs to the smallest seed over it."""
    p = pts(spark, d)
    size = p.groupBy("scene_name", "candidate_id").agg(F.count(F.lit(1)).alias("n"))
    return sets.smallest_owner(p.join(size, ["scene_name", "candidate_id"]), ["scene_name", "item"], "n", "candidate_id")


@query(recursive("pts", PAIRS + ", rows AS (SELECT scene_name, candidate_id AS id, n FROM z), pair AS (SELECT scene_name, a, b FROM pairs WHERE iou > 0.8)" + suppression("scene_name", "n, id") + " SELECT p.scene_name, p.item, arg_min(k.id, (r.n, k.id)) AS candidate_id FROM kept k JOIN rows r USING (scene_name, id) JOIN pts p ON p.scene_name = k.scene_name AND p.candidate_id = k.id GROUP BY 1, 2"))
def geo_distinct_owner(spark: SparkSession, d: str) -> DataFrame:
    """Every point belongs to the smallest seed over it, after seeds that nearly equal a smaller one have gone."""
    p = cut(pts(spark, d))
    size = cut(p.groupBy("scene_name", "candidate_id").agg(F.count(F.lit(1)).alias("n")))
    rank = lambda c: F.struct(f"size_{c}", c)
    conflicts = greedy.directed(sets.similar_pairs(p, ["scene_name"], "candidate_id", 0.8), ["scene_name"], "a", "b", rank("a"), rank("b"))
    kept = greedy.suppress(size.withColumnRenamed("candidate_id", "worse"), ["scene_name"], conflicts, "better", "worse").withColumnRenamed("worse", "candidate_id")
    return sets.smallest_owner(p.join(kept, ["scene_name", "candidate_id"]), ["scene_name", "item"], "n", "candidate_id")


# ---- graphs


COMPONENTS = """, e AS (SELECT a.trace_id, min(observation_id) AS m FROM links a GROUP BY 1), f AS (SELECT DISTINCT m AS a, observation_id AS b FROM links JOIN e USING (trace_id)), g AS (SELECT a, b FROM f UNION SELECT b, a FROM f),
    w(v, c) AS (SELECT a, a FROM g UNION SELECT g.b, w.c FROM w JOIN g ON g.a = w.v WHERE w.c < g.b), k AS (SELECT v AS node, min(c) AS component FROM w GROUP BY 1)"""


def _components(spark: SparkSession, d: str) -> DataFrame:
    seen = links(spark, d).select("trace_id", "observation_id")
    centre = seen.groupBy("trace_id").agg(F.min("observation_id").alias("a"))
    return graph.components(seen.join(centre, "trace_id").select("a", F.col("observation_id").alias("b")), "a", "b")


@query("WITH RECURSIVE" + with_views("links", COMPONENTS + " SELECT * FROM k")[4:])
def g2_components(spark: SparkSession, d: str) -> DataFrame:
    """Observations linked over traces."""
    return _components(spark, d)


@query("WITH RECURSIVE" + with_views("links", COMPONENTS + ", z AS (SELECT component, count(*) AS size FROM k GROUP BY 1), b AS (SELECT * FROM z WHERE size >= 4 ORDER BY size DESC, component LIMIT 20) SELECT node, component, size FROM k JOIN b USING (component)")[4:])
def g3_large_components(spark: SparkSession, d: str) -> DataFrame:
    """The twenty largest groups of four or more."""
    return graph.keep_components(cut(_components(spark, d)), 4, 20).select("node", "component", "size")


@query("WITH RECURSIVE" + with_views("links", COMPONENTS + """, p AS (SELECT DISTINCT x.observation_id AS a, y.observation_id AS b FROM links x JOIN links y ON x.trace_id = y.trace_id AND x.observation_id < y.observation_id), n AS (SELECT component, count(*) AS n_nodes FROM k GROUP BY 1),
    s AS (SELECT component, count(*) AS n_edges, avg(b - a) AS mean_weight, min(b - a) AS min_weight FROM p JOIN k ON k.node = p.a GROUP BY 1) SELECT component, n_nodes, coalesce(n_edges, 0) AS n_edges, mean_weight, min_weight FROM n LEFT JOIN s USING (component)""")[4:])
def g9_cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    """Edges inside every group."""
    seen = links(spark, d).select("trace_id", "observation_id").distinct()
    edges = seen.toDF("t", "a").join(seen.toDF("t", "b"), "t").where("a < b").select("a", "b").distinct().withColumn("w", F.col("b") - F.col("a"))
    return graph.cluster_stats(edges, "a", "b", "w", cut(_components(spark, d)))


@query()
def g4_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """Segmentation of the neighbour graph of each label."""
    v = vec(spark, d)
    near = geometry.near_pairs(v.withColumnRenamed("vec_id", "a"), v.withColumnRenamed("vec_id", "b"), ["label"], ["x", "y", "z"], 0.08).where("a < b")
    return greedy.segment_graph(near.withColumn("w", F.sqrt("d2")), ["label"], "a", "b", "w", 0.1, 3)


@query()
def g11_density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters: points with four neighbours in the radius are linked, border points join the least of them, others are noise (-1)."""
    v = vec(spark, d)
    near = cut(geometry.near_pairs(v.withColumnRenamed("vec_id", "a"), v.withColumnRenamed("vec_id", "b"), ["label"], ["x", "y", "z"], 0.06).where("a <> b").select("a", "b"))
    core = cut(near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select(F.col("a").alias("core")))
    inner = near.join(core, near.a == core.core, "left_semi").join(core.withColumnRenamed("core", "c2"), F.col("b") == F.col("c2"), "left_semi")
    groups = cut(graph.components(inner, "a", "b", core))
    border = near.join(groups.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("c"))
    out = v.select("vec_id").join(groups.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left").join(border.withColumnRenamed("a", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("component", "c", F.lit(-1)).alias("cluster"))


# ---- geometry


FRAMES = [(0, 0.0, 0.0, 2.0), (1, 0.1, -0.05, 2.5), (2, -0.2, 0.1, 3.0)]


def _frames(spark: SparkSession, labels: DataFrame) -> DataFrame:
    pose = lambda x, y, z: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, y, 0.0, 0.0, 1.0, z, 0.0, 0.0, 0.0, 1.0]
    rows = spark.createDataFrame([(i, pose(x, y, z), 500.0, 500.0, 320.0, 240.0) for i, x, y, z in FRAMES], "frame_id int, pose array<double>, fx double, fy double, cx double, cy double")
    return labels.crossJoin(F.broadcast(rows))


def _proj(spark: SparkSession, d: str) -> DataFrame:
    v = vec(spark, d).withColumnsRenamed({"vec_id": "point_id", "label": "scene"})
    return geometry.project(v, _frames(spark, v.select("scene").distinct()))


PROJ = """, f(frame_id, tx, ty, tz) AS (VALUES """ + ", ".join(f"({i}, {x}, {y}, {z})" for i, x, y, z in FRAMES) + """), proj AS (SELECT label AS scene, frame_id, vec_id AS point_id, CAST(trunc(CAST(500 AS DOUBLE) * (x + tx) / (z + tz) + 320) AS INT) AS px, CAST(trunc(CAST(500 AS DOUBLE) * (y + ty) / (z + tz) + 240) AS INT) AS py, z + tz AS depth FROM vec, f WHERE z + tz <> 0)"""


@query(with_views("vec", PROJ + " SELECT * FROM proj"))
def geo_projection(spark: SparkSession, d: str) -> DataFrame:
    """Points projected into three frames."""
    return _proj(spark, d)


@query(with_views("vec", PROJ + ", n AS (SELECT *, min(depth) OVER (PARTITION BY scene, frame_id, px // 8, py // 8) AS near FROM proj WHERE px >= 0 AND px < 640 AND py >= 0 AND py < 480 AND depth > 0) SELECT scene, frame_id, point_id, px // 8 AS px, py // 8 AS py, depth FROM n WHERE depth <= near + 0.05"))
def geo_front_points(spark: SparkSession, d: str) -> DataFrame:
    """Points in front at their pixel, over pixels of eight."""
    coarse = _proj(spark, d).where("px >= 0 and px < 640 and py >= 0 and py < 480").withColumn("px", F.floor(F.col("px") / 8).cast("int")).withColumn("py", F.floor(F.col("py") / 8).cast("int"))
    return geometry.front_points(coarse, 80, 60, 0.05)


@query(with_views("vec", PROJ + ", m AS (SELECT scene, frame_id, px, py, min(depth) AS measured FROM proj GROUP BY 1, 2, 3, 4) SELECT scene, frame_id, point_id, px, py, depth FROM proj JOIN m USING (scene, frame_id, px, py) WHERE px > 0 AND px < 640 AND py > 0 AND py < 480 AND abs(measured - depth) <= 0.05"))
def geo_visibility(spark: SparkSession, d: str) -> DataFrame:
    """Points that agree with the depth measured at their pixel."""
    p = _proj(spark, d)
    depth = p.groupBy("scene", "frame_id", "px", "py").agg(F.min("depth").alias("depth"))
    return geometry.visible(p, depth, 640, 480)


@query(with_views("vec", PROJ + " SELECT scene, frame_id, min(px) / 2.0 AS x1, min(py) / 2.0 AS y1, (max(px) + 1) / 2.0 AS x2, (max(py) + 1) / 2.0 AS y2, count(*) AS n FROM proj GROUP BY 1, 2"))
def geo_seen_box(spark: SparkSession, d: str) -> DataFrame:
    """Box of the points of each label in each frame."""
    return geometry.seen_box(_proj(spark, d), ["scene", "frame_id"], 2.0, 2.0)


@query(with_views("obs", f"SELECT a.observation_id AS a, b.observation_id AS b, {IOU} AS iou FROM obs a JOIN obs b ON a.scene_name = b.scene_name AND a.frame_index = b.frame_index AND a.class_id = b.class_id AND a.observation_id < b.observation_id"))
def geo_class_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Box IoU of all pairs of a frame and class."""
    return box_pairs(spark, d).where("a_class_id = b_class_id").select(F.col("a_observation_id").alias("a"), F.col("b_observation_id").alias("b"), "iou")


@query()
def geo_shape_features(spark: SparkSession, d: str) -> DataFrame:
    """Linearity, planarity and scattering of each label's points."""
    return geometry.shape_features(vec(spark, d), ["label"])


@query(with_views("vec", "SELECT label, CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(floor(z / 0.1) AS BIGINT) AS vz, min(vec_id) AS first_id, count(*) AS n FROM vec GROUP BY 1, 2, 3, 4"))
def v1_voxels(spark: SparkSession, d: str) -> DataFrame:
    """Voxels with their first point."""
    return geometry.voxels(vec(spark, d), ["label"], ["x", "y", "z"], 0.1, "vec_id")


@query(with_views("vec", ", m AS (SELECT label, avg(x) AS mx, avg(y) AS my FROM vec GROUP BY 1) SELECT label, CAST(x >= mx AS INT) * 2 + CAST(y >= my AS INT) AS quadrant, count(*) AS n FROM vec JOIN m USING (label) GROUP BY 1, 2"))
def v4_quadrants(spark: SparkSession, d: str) -> DataFrame:
    """Points by quadrant around the mean."""
    v = vec(spark, d)
    m = v.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return v.join(m, "label").groupBy("label", ((F.col("x") >= F.col("mx")).cast("int") * 2 + (F.col("y") >= F.col("my")).cast("int")).alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))


@query()
def v10_scene_splits(spark: SparkSession, d: str) -> DataFrame:
    """Nested and disjoint random subsets of the scenes."""
    return ranking.seeded_splits(table(spark, d, "observations"), "scene_name", 17, 8, 16)


@query()
def o13_farthest_points(spark: SparkSession, d: str) -> DataFrame:
    """Eight farthest points of each label."""
    return greedy.farthest_points(vec(spark, d), ["label"], "vec_id", ["x", "y", "z"], 8)


@query()
def o12_diverse_views(spark: SparkSession, d: str) -> DataFrame:
    """Five diverse traces of each scene by their observations."""
    rows = links(spark, d).groupBy("scene_name", "trace_id").agg(F.array_sort(F.collect_set("observation_id")).alias("items"))
    score = table(spark, d, "mask_graph_trace").groupBy("trace_id").agg(F.max(F.coalesce(F.when(~F.isnan("edge_score"), F.col("edge_score")), F.lit(0.0))).alias("q"))
    return greedy.diverse_views(rows.join(score, "trace_id"), ["scene_name"], "trace_id", "q", "items", 5)


# ---- evaluation


def _instances(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(points, seeds, points of instances, instances): each point with the smallest seed of a base class over it."""
    classes = table(spark, d, "classes")
    p = cut(pts(spark, d))
    s = cut(_seed_scores(spark, d, p).where("class_id is not null"))
    base = s.join(F.broadcast(classes.where("is_base").select("class_id")), "class_id", "left_semi")
    owned = sets.smallest_owner(p.join(base.select("scene_name", "candidate_id", "n"), ["scene_name", "candidate_id"]), ["scene_name", "item"], "n", "candidate_id")
    gt_points = cut(owned.select(F.col("scene_name").alias("scene"), F.col("item").alias("point"), F.col("candidate_id").alias("gt_id")))
    gts = base.select(F.col("scene_name").alias("scene"), F.col("candidate_id").alias("gt_id"), "class_id")
    return p.toDF("scene", "pred_id", "point"), s, gt_points, gts


def _outcomes(spark: SparkSession, d: str, valid: DataFrame | None = None) -> DataFrame:
    """Seeds as predictions, held against instances."""
    points, s, gt_points, gts = _instances(spark, d)
    preds = s.select(F.col("scene_name").alias("scene"), F.col("candidate_id").alias("pred_id"), "class_id", "score")
    valid = table(spark, d, "classes").select("class_id") if valid is None else valid
    good, instances, pairs = evaluate.assign(points, preds, gt_points, gts, valid, 20)
    return evaluate.match(good, instances, cut(pairs), 20)


GRID = ", ".join(f"(CAST({o} AS DOUBLE))" for o in evaluate.OVERLAPS)


def outcomes_sql(valid: str = "SELECT class_id FROM classes") -> str:
    """SQL of _outcomes as o(class_id, overlap, score, positive): the ordered matching as a recursion over each key's hits."""
    body = f"""{PAIRS}{RANKED}, valid AS ({valid}), base AS (SELECT s.* FROM s WHERE class_id IN (SELECT class_id FROM classes WHERE is_base)),
    gt AS (SELECT p.scene_name AS scene, p.item, arg_min(b.candidate_id, (b.n, b.candidate_id)) AS gt_id FROM pts p JOIN base b USING (scene_name, candidate_id) GROUP BY 1, 2),
    inst AS (SELECT g.scene, g.gt_id, b.class_id, count(*) AS gt_n FROM gt g JOIN base b ON b.scene_name = g.scene AND b.candidate_id = g.gt_id WHERE b.class_id IN (SELECT class_id FROM valid) GROUP BY 1, 2, 3),
    cell AS (SELECT p.scene_name AS scene, p.candidate_id AS pred_id, i.gt_id, count(*) AS inter FROM pts p LEFT JOIN gt g ON g.scene = p.scene_name AND g.item = p.item LEFT JOIN inst i ON i.scene = g.scene AND i.gt_id = g.gt_id GROUP BY 1, 2, 3),
    good AS (SELECT s.scene_name AS scene, s.candidate_id AS pred_id, s.class_id, s.score, s.n, coalesce((SELECT sum(inter) FROM cell c WHERE c.scene = s.scene_name AND c.pred_id = s.candidate_id AND c.gt_id IS NULL), 0) AS void FROM s WHERE s.n >= 20 AND s.class_id IN (SELECT class_id FROM valid)),
    pair AS (SELECT c.scene, c.gt_id, g.class_id, c.pred_id, c.inter, c.inter / (g.n + i.gt_n - c.inter)::DOUBLE AS iou, g.score, g.n, g.void, i.gt_n FROM cell c JOIN good g USING (scene, pred_id) JOIN inst i ON i.scene = c.scene AND i.gt_id = c.gt_id AND i.class_id = g.class_id),
    grid(overlap) AS (VALUES {GRID}),
    hit AS (SELECT scene, class_id, overlap, gt_id, pred_id, score, row_number() OVER (PARTITION BY scene, class_id, overlap ORDER BY gt_id, pred_id) AS i FROM pair, grid WHERE gt_n >= 20 AND iou > overlap),
    walk(scene, class_id, overlap, i, gt_id, held, taken, lost_gt, lost) AS (SELECT scene, class_id, overlap, i, gt_id, score, [pred_id], CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM hit WHERE i = 1 UNION ALL
        SELECT h.scene, h.class_id, h.overlap, h.i, CASE WHEN list_contains(w.taken, h.pred_id) THEN w.gt_id ELSE h.gt_id END,
            CASE WHEN list_contains(w.taken, h.pred_id) THEN w.held WHEN h.gt_id <> w.gt_id THEN h.score ELSE greatest(w.held, h.score) END,
            CASE WHEN list_contains(w.taken, h.pred_id) OR h.gt_id = w.gt_id THEN w.taken ELSE list_append(w.taken, h.pred_id) END,
            CASE WHEN NOT list_contains(w.taken, h.pred_id) AND h.gt_id = w.gt_id THEN h.gt_id END, CASE WHEN NOT list_contains(w.taken, h.pred_id) AND h.gt_id = w.gt_id THEN least(w.held, h.score) END
        FROM walk w JOIN hit h ON h.scene = w.scene AND h.class_id = w.class_id AND h.overlap = w.overlap AND h.i = w.i + 1),
    won AS (SELECT scene, class_id, overlap, gt_id, arg_max(held, i) AS score FROM walk GROUP BY 1, 2, 3, 4),
    enough AS (SELECT scene, pred_id, max(iou) AS best, sum(CASE WHEN gt_n < 20 THEN inter ELSE 0 END) AS small FROM pair GROUP BY 1, 2),
    o AS (SELECT class_id, overlap, score, 1 AS positive FROM won UNION ALL SELECT class_id, overlap, lost, 0 FROM walk WHERE lost IS NOT NULL
        UNION ALL SELECT i.class_id, overlap, NULL, 1 FROM inst i, grid WHERE gt_n >= 20 AND (i.scene, i.gt_id, overlap) NOT IN (SELECT (scene, gt_id, overlap) FROM won)
        UNION ALL SELECT g.class_id, overlap, g.score, 0 FROM good g LEFT JOIN enough e USING (scene, pred_id), grid WHERE coalesce(best, 0) <= overlap AND (void + coalesce(small, 0)) / n::DOUBLE <= overlap)"""
    return "WITH RECURSIVE" + with_views("cand pts", body)[4:]


AP = """, c AS (SELECT class_id, overlap, score, sum(positive) AS t, count(*) AS k FROM o WHERE score IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, sum(t) OVER w AS tp, sum(k) OVER w AS n FROM c WINDOW w AS (PARTITION BY class_id, overlap ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT *, tp / n::DOUBLE AS p, lag(tp / n::DOUBLE, 1, 1) OVER (PARTITION BY class_id, overlap ORDER BY score DESC) AS before FROM r), ar AS (SELECT class_id, overlap, sum(t * (p + before) / 2) AS area FROM q GROUP BY 1, 2), tt AS (SELECT class_id, overlap, sum(positive) AS total FROM o GROUP BY 1, 2),
    ap AS (SELECT class_id, overlap, CASE WHEN total > 0 THEN coalesce(area, 0) / total END AS ap FROM tt LEFT JOIN ar USING (class_id, overlap)),
    pc AS (SELECT k.class_id, k.name AS class_name, k.split, k.is_base, a.ap, a.ap50, a.ap25 FROM classes k LEFT JOIN (SELECT class_id, avg(ap) FILTER (WHERE overlap > 0.25) AS ap, max(ap) FILTER (WHERE overlap = 0.5) AS ap50, max(ap) FILTER (WHERE overlap = 0.25) AS ap25 FROM ap GROUP BY 1) a USING (class_id))"""


@query(outcomes_sql() + " SELECT class_id, overlap, sum(positive) AS instances, count(*) FILTER (WHERE positive = 1 AND score IS NOT NULL) AS matched, count(*) FILTER (WHERE positive = 0) AS false_positives FROM o GROUP BY 1, 2")
def e4_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Matched and unmatched predictions and instances per class and threshold, counted."""
    o = _outcomes(spark, d)
    return o.groupBy("class_id", "overlap").agg(F.sum("positive").alias("instances"), F.count_if((F.col("positive") == 1) & F.col("score").isNotNull()).alias("matched"), F.count_if(F.col("positive") == 0).alias("false_positives"))


def _per_class(spark: SparkSession, d: str, valid: DataFrame | None = None) -> DataFrame:
    return evaluate.summary(evaluate.average_precision(_outcomes(spark, d, valid), ["class_id", "overlap"]), table(spark, d, "classes"))


@query(outcomes_sql() + AP + " SELECT * FROM pc")
def e9_average_precision(spark: SparkSession, d: str) -> DataFrame:
    """AP, AP50 and AP25 per class."""
    return _per_class(spark, d)


@query(outcomes_sql() + AP + """, sc AS (SELECT unnest(['all', 'split ' || split, CASE WHEN is_base THEN 'base' ELSE 'novel' END]) AS scope, ap, ap50, ap25 FROM pc)
    SELECT scope, count(ap50) AS classes, avg(ap) AS ap, avg(ap50) AS ap50, avg(ap25) AS ap25 FROM sc WHERE scope IS NOT NULL GROUP BY 1""")
def e9_averages(spark: SparkSession, d: str) -> DataFrame:
    """Mean AP over all classes, by split, and of base and novel ones."""
    return evaluate.averages(_per_class(spark, d))


@query(outcomes_sql("SELECT class_id FROM classes WHERE split = (SELECT min(split) FROM classes)") + AP + " SELECT * FROM pc WHERE class_id IN (SELECT class_id FROM valid)")
def e13_second_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same evaluation over another set of classes, the first split: all other points are void, other predictions are left out."""
    k = table(spark, d, "classes")
    valid = k.join(F.broadcast(k.agg(F.min("split").alias("split"))), "split", "left_semi").select("class_id")
    return _per_class(spark, d, valid).join(F.broadcast(valid), "class_id", "left_semi")


@query(with_views("cand pts", PAIRS + RANKED + """, b AS (SELECT s.* FROM s WHERE class_id IN (SELECT class_id FROM classes WHERE is_base)), g AS (SELECT p.scene_name AS scene, p.item, arg_min(b.candidate_id, (b.n, b.candidate_id)) AS gt FROM pts p JOIN b USING (scene_name, candidate_id) GROUP BY 1, 2),
    r AS (SELECT scene_name, candidate_id, class_id, row_number() OVER (PARTITION BY scene_name, class_id ORDER BY candidate_id) % 1000 AS num FROM b), lab AS (SELECT g.scene, r.class_id * 1000 + r.num AS gt_id FROM g JOIN r ON r.scene_name = g.scene AND r.candidate_id = g.gt WHERE r.class_id * 1000 + r.num > 0)
    SELECT scene, gt_id, CAST(gt_id // 1000 AS INT) AS class_id, count(*) AS gt_n FROM lab WHERE gt_id // 1000 IN (SELECT class_id FROM classes) GROUP BY 1, 2, 3"""))
def e1_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instances from point labels class * 1000 + number."""
    _, s, gt_points, gts = _instances(spark, d)
    number = F.row_number().over(Window.partitionBy("scene", "class_id").orderBy("gt_id")) % 1000
    labels = gts.select("scene", "gt_id", (F.col("class_id").cast("long") * 1000 + number).alias("label"))
    return evaluate.labelled_instances(gt_points.join(labels, ["scene", "gt_id"]).select("scene", "label"), table(spark, d, "classes").select("class_id"))


BOX = f""", g AS (SELECT * FROM obs WHERE sam_score >= 0.5 AND class_id IS NOT NULL AND frame_index IS NOT NULL), b AS (SELECT * FROM obs WHERE score IS NOT NULL AND class_id IS NOT NULL AND frame_index IS NOT NULL),
    m AS (SELECT a.scene_name, a.frame_index, a.class_id, a.observation_id AS pred_id, b.observation_id AS gt_id, {IOU} AS iou FROM b a JOIN g b ON a.scene_name = b.scene_name AND a.frame_index = b.frame_index AND a.class_id = b.class_id AND a.observation_id <> b.observation_id),
    x AS (SELECT scene_name, frame_index, class_id, pred_id, arg_max(gt_id, (iou, -gt_id)) AS gt_id, max(iou) AS iou FROM m WHERE iou > 0 GROUP BY 1, 2, 3, 4), t(overlap) AS (VALUES (0.25::DOUBLE), (0.5::DOUBLE)),
    h AS (SELECT b.class_id, overlap, b.observation_id AS pred_id, b.score, coalesce(x.iou, 0) > overlap AS hit, row_number() OVER (PARTITION BY b.scene_name, b.frame_index, b.class_id, overlap, x.gt_id, coalesce(x.iou, 0) > overlap ORDER BY b.score DESC, b.observation_id) AS i FROM b LEFT JOIN x ON x.pred_id = b.observation_id, t),
    y AS (SELECT class_id, overlap, pred_id, score, CASE WHEN hit AND i = 1 THEN 1 ELSE 0 END AS positive FROM h), z AS (SELECT class_id, count(*) AS total FROM g GROUP BY 1),
    c AS (SELECT class_id, overlap, positive, row_number() OVER w AS n, sum(positive) OVER (PARTITION BY class_id, overlap ORDER BY score DESC, pred_id ROWS UNBOUNDED PRECEDING) AS tp FROM y WINDOW w AS (PARTITION BY class_id, overlap ORDER BY score DESC, pred_id)),
    e AS (SELECT class_id, overlap, positive, max(tp / n::DOUBLE) OVER (PARTITION BY class_id, overlap ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM c)"""


@query(with_views("obs", BOX + " SELECT class_id, overlap, coalesce(sum(best) FILTER (WHERE positive = 1) / max(total), 0) AS ap FROM e LEFT JOIN z USING (class_id) GROUP BY 1, 2"))
def e15_box_ap(spark: SparkSession, d: str) -> DataFrame:
    """Box AP per class at overlaps of 0.25 and 0.5: boxes in order of score against the mask-scored boxes of their frame and class."""
    o = obs(spark, d).where("class_id is not null and frame_index is not null")
    key = ["scene_name", "frame_index", "class_id"]
    truth = o.where("sam_score >= 0.5")
    preds = o.where("score is not null").select(*key, F.col("observation_id").alias("pred_id"), "score")
    p = box_pairs(spark, d, overlapping=True).where("a_class_id = b_class_id").select("scene_name", "frame_index", F.col("a_class_id").alias("class_id"), F.col("a_observation_id").alias("a"), F.col("b_observation_id").alias("b"), "iou")
    both = p.toDF(*key, "pred_id", "gt_id", "iou").union(p.select(*key, "b", "a", "iou"))
    pairs = both.join(truth.select(F.col("observation_id").alias("gt_id")), "gt_id", "left_semi")
    out = cut(evaluate.box_outcomes(pairs, preds, key, (0.25, 0.5)))
    total = truth.groupBy("class_id").agg(F.count(F.lit(1)).alias("total"))
    grid = out.select("class_id", "overlap").distinct().join(total, "class_id")
    return evaluate.voc_ap(out, ["class_id", "overlap"], "score", "positive", "pred_id", total=grid)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Observations as scored outcomes: positive if the class is a base class."""
    return obs(spark, d).where("score is not null").join(F.broadcast(table(spark, d, "classes").select("class_id", "split", "is_base")), "class_id").select("split", "observation_id", "score", F.col("is_base").cast("int").alias("positive"))


JUDGED = ", j AS (SELECT split, observation_id, score, CAST(is_base AS INT) AS positive FROM obs JOIN classes USING (class_id) WHERE score IS NOT NULL)"


@query(with_views("obs", JUDGED + """, t AS (SELECT split, sum(positive) AS total FROM j GROUP BY 1), c AS (SELECT split, score, sum(sum(positive)) OVER w AS tp, sum(count(*)) OVER w AS n FROM j GROUP BY 1, 2 WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT split, score, tp / n::DOUBLE AS p, tp / total::DOUBLE AS r FROM c JOIN t USING (split)), s AS (SELECT split, score, r, p * (coalesce(lead(r) OVER w, r) - coalesce(lag(r) OVER w, 0)) / 2 AS part FROM r WINDOW w AS (PARTITION BY split ORDER BY score DESC))
    SELECT split, sum(part) + arg_max(r, score) / 2 AS ap FROM s GROUP BY 1"""))
def e7_closed_form_ap(spark: SparkSession, d: str) -> DataFrame:
    """AP of scored outcomes per split, in closed form."""
    return evaluate.average_precision(_judged(spark, d), ["split"])


@query(with_views("obs", JUDGED + ", c AS (SELECT split, positive, sum(positive) OVER w / count(*) OVER w::DOUBLE AS p FROM j WINDOW w AS (PARTITION BY split ORDER BY score DESC, observation_id ROWS UNBOUNDED PRECEDING)) SELECT split, coalesce(avg(p) FILTER (WHERE positive = 1), 0) AS ap FROM c GROUP BY 1"))
def a31_ranking_ap(spark: SparkSession, d: str) -> DataFrame:
    """Mean precision at the positives per split."""
    return evaluate.ranking_ap(_judged(spark, d), ["split"], "score", "positive", "observation_id")


@query(with_views("obs", JUDGED + """, c AS (SELECT split, positive, row_number() OVER w AS n, sum(positive) OVER (PARTITION BY split ORDER BY score DESC, observation_id ROWS UNBOUNDED PRECEDING) AS tp, sum(positive) OVER (PARTITION BY split) AS total FROM j WINDOW w AS (PARTITION BY split ORDER BY score DESC, observation_id)),
    b AS (SELECT split, positive, total, max(tp / n::DOUBLE) OVER (PARTITION BY split ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM c) SELECT split, coalesce(sum(best) FILTER (WHERE positive = 1) / nullif(max(total), 0), 0) AS ap FROM b GROUP BY 1"""))
def a32_voc_ap(spark: SparkSession, d: str) -> DataFrame:
    """Area under the envelope of precision per split."""
    return evaluate.voc_ap(_judged(spark, d), ["split"], "score", "positive", "observation_id")


@query(with_views("obs", JUDGED + ", c AS (SELECT count(*) AS n, count(*) FILTER (WHERE score >= 0.5 AND positive = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND positive = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND positive = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND positive = 0) AS tn FROM j), m AS (SELECT n, (tp + tn) / greatest(n, 1)::DOUBLE AS accuracy, tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(tp + fn, 1)::DOUBLE AS recall FROM c) SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM m"))
def a30_binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, precision, recall and F1 at 0.5."""
    return evaluate.binary_metrics(_judged(spark, d), "score", "positive")


@query(with_views("obs", JUDGED + ", c AS (SELECT score AS threshold, sum(sum(positive)) OVER w AS tp, sum(count(*)) OVER w AS n FROM j GROUP BY 1 WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT threshold, tp / n::DOUBLE AS precision, tp / (SELECT sum(positive) FROM j)::DOUBLE AS recall FROM c WHERE tp / (SELECT sum(positive) FROM j)::DOUBLE >= 0.5 ORDER BY 2 DESC, 3 DESC, 1 DESC LIMIT 1"))
def a34_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Threshold of best precision with half the recall."""
    return evaluate.threshold_table(_judged(spark, d), "score", "positive", 0.5)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    seeds = cut(cand(spark, d).where("class_id is not null").groupBy("scene_name", "candidate_id").agg(F.min_by("class_id", "record_id").alias("target"), F.max_by("class_id", "record_id").alias("pred")))
    return evaluate.confusion(seeds, "target", "pred", table(spark, d, "classes"))


MATRIX = ", q AS (SELECT scene_name, candidate_id, arg_min(class_id, record_id) AS target, arg_max(class_id, record_id) AS pred FROM cand WHERE class_id IS NOT NULL GROUP BY 1, 2), m AS (SELECT a.class_id AS target, b.class_id AS pred, (SELECT count(*) FROM q WHERE q.target = a.class_id AND q.pred = b.class_id) AS n FROM classes a, classes b)"


@query(with_views("cand", MATRIX + " SELECT * FROM m"))
def a28_confusion(spark: SparkSession, d: str) -> DataFrame:
    """First against last class of every candidate, on the whole class grid."""
    return _matrix(spark, d)


@query(with_views("cand", MATRIX + ", r AS (SELECT target AS class_id, sum(n) AS r, sum(n) FILTER (WHERE target = pred) AS d FROM m GROUP BY 1), c AS (SELECT pred AS class_id, sum(n) AS c FROM m GROUP BY 1) SELECT class_id, d / nullif(r + c - d, 0)::DOUBLE AS iou FROM r JOIN c USING (class_id)"))
def a29_class_iou(spark: SparkSession, d: str) -> DataFrame:
    """IoU per class from the confusion matrix."""
    return evaluate.class_iou(_matrix(spark, d), "target", "pred")


# ---- composites


@query(with_views("cand pts", PAIRS + RANKED + """, u AS (SELECT scene_name, a AS id, b AS other, iou FROM pairs UNION ALL SELECT scene_name, b, a, iou FROM pairs), m AS (SELECT u.scene_name, id, max(iou) FILTER (WHERE k.is_base) AS base_iou, max(iou) FILTER (WHERE NOT k.is_base) AS novel_iou FROM u JOIN s ON s.scene_name = u.scene_name AND s.candidate_id = u.other JOIN classes k USING (class_id) GROUP BY 1, 2)
    SELECT CASE WHEN coalesce(base_iou, 0) >= 0.5 AND coalesce(novel_iou, 0) >= 0.5 THEN 'both' WHEN coalesce(base_iou, 0) >= 0.5 THEN 'base_only' WHEN coalesce(novel_iou, 0) >= 0.5 THEN 'novel_only' ELSE 'missed' END AS coverage, count(*) AS n FROM z LEFT JOIN m ON m.scene_name = z.scene_name AND m.id = z.candidate_id GROUP BY 1"""))
def q1_complementarity(spark: SparkSession, d: str) -> DataFrame:
    """Seeds covered by others of base classes, of novel ones, by both or neither."""
    s = _seed_scores(spark, d).join(F.broadcast(table(spark, d, "classes").select("class_id", "is_base")), "class_id").select("scene_name", F.col("candidate_id").alias("other"), "is_base")
    p = seed_pairs(spark, d).select("scene_name", "a", "b", "iou")
    both = p.toDF("scene_name", "id", "other", "iou").union(p.select("scene_name", "b", "a", "iou")).join(s, ["scene_name", "other"])
    m = both.groupBy("scene_name", "id").agg(F.max(F.when(F.col("is_base"), F.col("iou"))).alias("base"), F.max(F.when(~F.col("is_base"), F.col("iou"))).alias("novel"))
    rows = pts(spark, d).select("scene_name", F.col("candidate_id").alias("id")).distinct().join(m, ["scene_name", "id"], "left")
    base, novel = F.coalesce("base", F.lit(0.0)) >= 0.5, F.coalesce("novel", F.lit(0.0)) >= 0.5
    return rows.groupBy(F.when(base & novel, "both").when(base, "base_only").when(novel, "novel_only").otherwise("missed").alias("coverage")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("cand", """, r AS (SELECT scene_name, candidate_id, record_id, class_name, row_number() OVER (PARTITION BY scene_name, candidate_id ORDER BY record_id) AS p, count(*) OVER (PARTITION BY scene_name, candidate_id) AS n FROM cand)
    SELECT a.class_name AS before, b.class_name AS after, count(*) AS n FROM r a JOIN r b ON a.scene_name = b.scene_name AND a.candidate_id = b.candidate_id AND a.p = 1 AND b.p = b.n AND b.n > 1 WHERE a.class_name IS DISTINCT FROM b.class_name GROUP BY 1, 2"""))
def q14_action_summary(spark: SparkSession, d: str) -> DataFrame:
    """Class changes between a candidate's first and last record."""
    two = cand(spark, d).groupBy("scene_name", "candidate_id").agg(F.min_by(F.struct("class_name"), "record_id").alias("a"), F.max_by(F.struct("class_name"), "record_id").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1")
    changed = two.select(F.col("a.class_name").alias("before"), F.col("b.class_name").alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    return changed.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("links obs", """, p AS (SELECT t.relation_type AS r, x.class_id AS cx, y.class_id AS cy FROM (SELECT DISTINCT trace_id, regexp_replace(lower(relation_type), '[^\\p{L}\\p{N}]', '', 'g') AS relation_type FROM mask_graph_trace) t JOIN links a USING (trace_id) JOIN links b ON b.trace_id = a.trace_id AND a.observation_id < b.observation_id
    JOIN obs x ON x.observation_id = a.observation_id JOIN obs y ON y.observation_id = b.observation_id) SELECT r AS relation, CASE WHEN cx IS NULL OR cy IS NULL THEN 'unknown' WHEN cx = cy THEN 'same_class' ELSE 'different_class' END AS truth, count(*) AS n FROM p WHERE r <> '' GROUP BY 1, 2"""))
def q16_relation_truth(spark: SparkSession, d: str) -> DataFrame:
    """Relations of traces against the classes of their ends."""
    from scantable.common import same_name

    rel = table(spark, d, "mask_graph_trace").select("trace_id", same_name("relation_type").alias("relation")).where("relation is not null").distinct()
    seen = links(spark, d).select("trace_id", "observation_id").join(obs(spark, d).select("observation_id", "class_id"), "observation_id")
    # pairs are counted, not formed: n (n - 1) / 2 of n observations, by class and altogether
    per_class = seen.groupBy("trace_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    two = lambda n: n * (n - 1) / 2
    known = F.coalesce(F.sum(F.when(F.col("class_id").isNotNull(), F.col("n"))), F.lit(0))
    t = per_class.groupBy("trace_id").agg(two(F.sum("n")).alias("all"), two(known).alias("known"), F.coalesce(F.sum(F.when(F.col("class_id").isNotNull(), two(F.col("n")))), F.lit(0.0)).alias("same"))
    each = F.array(*[F.struct(F.lit(k).alias("truth"), v.cast("long").alias("n")) for k, v in (("unknown", F.col("all") - F.col("known")), ("same_class", F.col("same")), ("different_class", F.col("known") - F.col("same")))])
    counts = t.join(rel, "trace_id").select("relation", F.explode(each).alias("c")).groupBy("relation", F.col("c.truth").alias("truth")).agg(F.sum("c.n").alias("n"))
    return counts.where("n > 0")


@query(with_views("cand", """, g AS (SELECT s / 10.0 AS min_score, i / 10.0 AS min_iou FROM range(2, 9) a(s), range(1, 7) b(i)) SELECT min_score, min_iou, count(*) FILTER (WHERE is_base) AS helpful, count(*) FILTER (WHERE NOT is_base) AS harmful, count(*) AS fired
    FROM g JOIN cand ON score >= min_score AND mean_iou >= min_iou JOIN classes USING (class_id) GROUP BY 1, 2"""))
def q19_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    """Effect of 42 pairs of thresholds in one pass: rows are counted per cell, then cells are summed up."""
    rows = cand(spark, d).join(F.broadcast(table(spark, d, "classes").select("class_id", "is_base")), "class_id")
    step = lambda c, low, high: sum((F.when(F.col(c) >= F.lit(i) / 10.0, 1).otherwise(0) for i in range(low, high)), F.lit(0))
    cells = rows.groupBy(step("score", 2, 9).alias("s"), step("mean_iou", 1, 7).alias("i")).agg(F.count_if("is_base").alias("h"), F.count(F.lit(1)).alias("n"))
    up = cells.select(F.explode(F.sequence(F.lit(1), F.greatest("s", F.lit(1)))).alias("a"), "s", "i", "h", "n").where("a <= s").select("a", F.explode(F.sequence(F.lit(1), F.greatest("i", F.lit(1)))).alias("b"), "i", "h", "n").where("b <= i")
    return up.groupBy(((F.col("a") + 1) / 10.0).alias("min_score"), (F.col("b") / 10.0).alias("min_iou")).agg(F.sum("h").alias("helpful"), F.sum(F.col("n") - F.col("h")).alias("harmful"), F.sum("n").alias("fired"))
