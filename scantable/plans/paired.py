"""Queries on pairs of views, shapes and meshes, sampling, and labels of diagnostics.

The test tables hold no scans: points are the first three numbers of an embedding, as in geo_...; normals and colours are the
next six. A view is a slab of x seen through one of three frames; its mask are the slab's points in front at their pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantable.common import cut, table
from scantable.functions import exprs as X
from scantable.operators import geometry, graph, pairs
from scantable.plans.evidence import IOU, box_pairs
from scantable.plans.registry import query
from scantable.plans.structure import PROJ, _proj
from scantable.plans.tracks import KNN, MEMBERS, _knn
from scantable.plans.views import cand, links, obs, pts, with_views

VIEWS = PROJ + """, s AS (SELECT p.scene, p.frame_id, p.point_id, p.px // 8 AS cx, p.py // 8 AS cy, p.depth, CAST(floor(v.x / 0.1) AS BIGINT) AS slab FROM proj p JOIN vec v ON v.vec_id = p.point_id AND v.label = p.scene WHERE px >= 0 AND px < 640 AND py >= 0 AND py < 480 AND depth > 0),
    seen AS (SELECT *, min(depth) OVER (PARTITION BY scene, frame_id, cx, cy) AS measured FROM s), mem AS (SELECT scene, frame_id * 100000 + slab AS obs, frame_id, slab, point_id FROM s), mask AS (SELECT scene, frame_id * 100000 + slab AS obs, point_id FROM seen WHERE depth <= measured + 0.02),
    o AS (SELECT DISTINCT scene, obs, frame_id, slab FROM mem), prs AS (SELECT a.scene, a.obs AS a, b.obs AS b, a.frame_id AS frame_a, b.frame_id AS frame_b FROM o a JOIN o b ON a.scene = b.scene AND a.slab = b.slab AND a.frame_id < b.frame_id)"""

DEPTH = VIEWS + """, way AS (SELECT scene, a AS src, b AS dst, frame_b AS frame_id FROM prs UNION ALL SELECT scene, b, a, frame_a FROM prs),
    q AS (SELECT w.scene, w.src, w.dst, coalesce(e.measured > 0 AND e.depth > 0, false) AS valid, abs(e.depth - e.measured) AS err, abs(e.depth - e.measured) <= least(0.10, greatest(0.04, 0.03 * e.measured)) AS good, k.obs IS NOT NULL AS inside
        FROM way w JOIN mem m ON m.scene = w.scene AND m.obs = w.src LEFT JOIN seen e ON e.scene = w.scene AND e.frame_id = w.frame_id AND e.point_id = m.point_id LEFT JOIN mask k ON k.scene = w.scene AND k.obs = w.dst AND k.point_id = m.point_id),
    c AS (SELECT scene, src, dst, count(*) AS input, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE valid AND good) AS consistent, count(*) FILTER (WHERE valid AND inside) AS inside, count(*) FILTER (WHERE valid AND inside AND good) AS inside_consistent,
        coalesce(median(err) FILTER (WHERE valid), 0) AS median_error, coalesce(quantile_cont(err, 0.9) FILTER (WHERE valid), 0) AS p90_error FROM q GROUP BY 1, 2, 3),
    d AS (SELECT *, consistent / greatest(1, valid)::DOUBLE AS consistent_ratio, inside_consistent / greatest(1, inside)::DOUBLE AS inside_consistent_ratio, (valid - consistent) / greatest(1, valid)::DOUBLE AS conflict_ratio, (inside - inside_consistent) / greatest(1, inside)::DOUBLE AS inside_conflict_ratio FROM c)"""

MUTUAL = """, dir AS (SELECT scene, a, b, a AS obs, b AS other, frame_b AS frame_id, 1 AS ab FROM prs UNION ALL SELECT scene, a, b, b, a, frame_a, 0 FROM prs), vis AS (SELECT scene, frame_id, point_id FROM seen WHERE depth <= measured + 0.05),
    l AS (SELECT r.scene, r.a, r.b, m.point_id, ab, v.point_id IS NOT NULL AS v, v.point_id IS NOT NULL AND k.obs IS NOT NULL AS h FROM dir r JOIN mem m ON m.scene = r.scene AND m.obs = r.obs LEFT JOIN vis v ON v.scene = r.scene AND v.frame_id = r.frame_id AND v.point_id = m.point_id LEFT JOIN mask k ON k.scene = r.scene AND k.obs = r.other AND k.point_id = m.point_id),
    e AS (SELECT scene, a, b, point_id, sum(ab) AS iab, sum(1 - ab) AS iba, count(*) FILTER (WHERE v AND ab = 1) AS vab, count(*) FILTER (WHERE v AND ab = 0) AS vba, count(*) FILTER (WHERE h AND ab = 1) AS hab, count(*) FILTER (WHERE h AND ab = 0) AS hba FROM l GROUP BY 1, 2, 3, 4),
    g AS (SELECT scene, a, b, sum(iab) AS iab, sum(iba) AS iba, sum(vab) AS vab, sum(vba) AS vba, sum(hab) AS hab, sum(hba) AS hba, count(*) FILTER (WHERE hab > 0 AND hba > 0) AS shared FROM e GROUP BY 1, 2, 3),
    mu AS (SELECT scene, a, b, vab / greatest(1, iab)::DOUBLE AS visible_ab, vba / greatest(1, iba)::DOUBLE AS visible_ba, hab / greatest(1, vab)::DOUBLE AS inside_ab, hba / greatest(1, vba)::DOUBLE AS inside_ba, shared, shared / greatest(1, hab + hba - shared)::DOUBLE AS visible_iou, shared / greatest(1, least(hab, hba))::DOUBLE AS visible_containment FROM g),
    mv AS (SELECT *, least(visible_ab, visible_ba) AS depth_consistency, least(inside_ab, inside_ba) AS mask_consistency FROM mu)"""


def _views(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, seen, masks, pairs of views of the same slab in different frames)."""
    x = table(spark, d, "embeddings").select(F.col("label").alias("scene"), F.col("vec_id").alias("point_id"), F.floor(F.get("embedding", F.lit(0)).cast("double") / 0.1).alias("slab"))
    s = _proj(spark, d).where("px >= 0 and px < 640 and py >= 0 and py < 480 and depth > 0").join(x, ["scene", "point_id"])
    s = cut(s.select("scene", "frame_id", "point_id", F.floor(F.col("px") / 8).alias("cx"), F.floor(F.col("py") / 8).alias("cy"), "depth", "slab", (F.col("frame_id").cast("long") * 100000 + F.col("slab")).alias("obs")))
    near = s.groupBy("scene", "frame_id", "cx", "cy").agg(F.min("depth").alias("measured"))
    seen = cut(s.join(near, ["scene", "frame_id", "cx", "cy"]).select("scene", "frame_id", "obs", "point_id", F.col("depth").alias("expected"), "measured"))
    o = s.select("scene", "obs", "frame_id", "slab").distinct()
    side = lambda m: o.select("scene", "slab", F.col("obs").alias(m), F.col("frame_id").alias(f"frame_{m}"))
    prs = side("a").join(side("b"), ["scene", "slab"]).where("frame_a < frame_b").drop("slab")
    return s.select("scene", "obs", "point_id"), seen.drop("obs"), seen.where("expected <= measured + 0.02").select("scene", "obs", "point_id"), cut(prs)


def _depths(spark: SparkSession, d: str, views: tuple | None = None) -> DataFrame:
    members, seen, masks, prs = views or _views(spark, d)
    ways = prs.select("scene", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("frame_b").alias("frame_id")).union(prs.select("scene", "b", "a", "frame_a"))
    return pairs.directed_depth(ways, members, seen, masks)


def _mutual(spark: SparkSession, d: str, views: tuple | None = None) -> DataFrame:
    members, seen, masks, prs = views or _views(spark, d)
    return pairs.mutual_visible(prs, members, seen.where("expected <= measured + 0.05").select("scene", "frame_id", "point_id"), masks)


@query(with_views("vec", DEPTH + " SELECT scene, src, dst, input, valid, consistent, inside, inside_consistent, median_error, p90_error, consistent_ratio, inside_consistent_ratio, conflict_ratio, inside_conflict_ratio FROM d"))
def geo_depth_relation(spark: SparkSession, d: str) -> DataFrame:
    """What the points of each view meet in the frame of the other one, both ways."""
    return _depths(spark, d)


@query(with_views("vec", VIEWS + MUTUAL + " SELECT * FROM mv"))
def geo_mutual_visible(spark: SparkSession, d: str) -> DataFrame:
    """What two views see of one another."""
    return _mutual(spark, d)


@query(with_views("vec", DEPTH + MUTUAL + """, r AS (SELECT v.scene, v.a, v.b, visible_iou, visible_containment, x.valid >= 5 AND x.valid >= x.input * 0.15 AND y.valid >= 5 AND y.valid >= y.input * 0.15 AS judgeable,
        (x.inside >= 3 AND x.inside_conflict_ratio >= 0.6) OR (y.inside >= 3 AND y.inside_conflict_ratio >= 0.6) OR (x.inside >= 3 AND x.inside_conflict_ratio >= 0.4 AND y.inside >= 3 AND y.inside_conflict_ratio >= 0.4) AS hard_conflict, least(x.consistent_ratio, y.consistent_ratio) AS cr, least(x.inside_consistent_ratio, y.inside_consistent_ratio) AS ir,
        CAST(0.35 AS DOUBLE) * least(1.0, visible_iou / CAST(0.2 AS DOUBLE)) + CAST(0.25 AS DOUBLE) * least(1.0, visible_containment / CAST(0.5 AS DOUBLE)) + CAST(0.25 AS DOUBLE) * least(x.consistent_ratio, y.consistent_ratio) + CAST(0.15 AS DOUBLE) * least(x.inside_consistent_ratio, y.inside_consistent_ratio) AS support_score
        FROM mv v JOIN d x ON x.scene = v.scene AND x.src = v.a AND x.dst = v.b JOIN d y ON y.scene = v.scene AND y.src = v.b AND y.dst = v.a)
    SELECT scene, a, b, judgeable, hard_conflict, support_score, CASE WHEN hard_conflict THEN 'conflict' WHEN judgeable AND cr >= 0.75 AND ir >= 0.60 AND (visible_iou >= 0.08 OR visible_containment >= 0.45) AND support_score >= 0.65 THEN 'same_object' WHEN visible_containment >= 0.5 THEN 'containment' WHEN visible_iou > 0 THEN 'weak_support' ELSE 'uncertain' END AS relation FROM r"""))
def g7_view_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relation of two views from depths and mutual visibility."""
    views = _views(spark, d)
    return pairs.pair_relation(_depths(spark, d, views), _mutual(spark, d, views))


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).select("observation_id", "frame_index", "score")
    return links(spark, d).select("trace_id", "observation_id").distinct().join(o, "observation_id")


CAPPED = ", m AS (SELECT DISTINCT l.trace_id, l.observation_id AS id, o.frame_index AS f, o.score AS s FROM links l JOIN obs o USING (observation_id))"


@query("WITH RECURSIVE" + with_views("links obs", CAPPED + """, q AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY id) AS i, coalesce(s, -1e300) AS c FROM m),
    w(trace_id, i, ids) AS (SELECT DISTINCT trace_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM q UNION ALL SELECT w.trace_id, q.i, CASE WHEN len(w.ids) < 3 THEN list_append(w.ids, q.id) ELSE
        (SELECT list(x.id ORDER BY x.c DESC, list_position(list_append(w.ids, q.id), x.id)) FROM (SELECT z.id, z.c FROM q z WHERE z.trace_id = w.trace_id AND list_contains(list_append(w.ids, q.id), z.id)) x)[1:3] END FROM w JOIN q ON q.trace_id = w.trace_id AND q.i = w.i + 1)
    SELECT DISTINCT least(q.id, p.id) AS a, greatest(q.id, p.id) AS b FROM w JOIN q ON q.trace_id = w.trace_id AND q.i = w.i + 1 JOIN m p ON p.trace_id = w.trace_id AND list_contains(w.ids, p.id) WHERE p.f IS DISTINCT FROM q.f OR p.f IS NULL""")[4:])
def j9_capped_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of observations of different frames by traces whose bucket holds three, as they arrive."""
    return pairs.bucket_pairs(_bucketed(spark, d), "trace_id", "observation_id", "frame_index", "score", 3)


@query(with_views("links obs", CAPPED + """, t AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY s DESC NULLS LAST, id) AS r FROM m) SELECT DISTINCT x.id AS a, y.id AS b FROM t x JOIN t y ON x.trace_id = y.trace_id AND x.r <= 3 AND y.r <= 3 AND x.id < y.id WHERE x.f IS DISTINCT FROM y.f OR x.f IS NULL"""))
def j9_capped_best(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs among the three most confident observations of each trace."""
    return pairs.bucket_pairs(_bucketed(spark, d), "trace_id", "observation_id", "frame_index", "score", 3, exact=False)


# ---- points with normals and colours


POINTS = ", pt AS (SELECT label, vec_id AS point_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(("x", "y", "z", "nx", "ny", "nz", "r", "g", "b_"))) + " FROM embeddings)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    names = ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b_")
    return table(spark, d, "embeddings").select("label", F.col("vec_id").alias("point_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])


@query(with_views("vec", POINTS + KNN + """, w AS (SELECT k.label, k.a, k.b, sqrt(k.d2) AS dist, 1 - least(1.0, abs(p.nx * q.nx + p.ny * q.ny + p.nz * q.nz)) AS n, sqrt((p.r - q.r)**2 + (p.g - q.g)**2 + (p.b_ - q.b_)**2) AS c FROM k JOIN pt p ON p.point_id = k.a JOIN pt q ON q.point_id = k.b WHERE k.a < k.b)
    SELECT label, a, b, dist / (SELECT greatest(quantile_cont(dist, 0.5), 1e-12) FROM w) + n + c AS weight FROM w"""))
def g5_combined_weights(spark: SparkSession, d: str) -> DataFrame:
    """Edges to later neighbours by distance, normals and colours."""
    edges = cut(_knn(spark, d).where("a < b").select("label", "a", "b"))
    return geometry.edge_weights(edges, _points(spark, d), ["label"])


FACES = """, face AS (SELECT label, a AS v0, max(b) FILTER (WHERE place = 1) AS v1, max(b) FILTER (WHERE place = 2) AS v2 FROM k GROUP BY 1, 2), f AS (SELECT f.label, v0, v1, v2, (q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y) AS a, (q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z) AS b, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS c
        FROM face f JOIN vec p ON p.vec_id = v0 JOIN vec q ON q.vec_id = v1 JOIN vec r ON r.vec_id = v2), u AS (SELECT label, unnest([v0, v1, v2]) AS v, a / greatest(sqrt(a * a + b * b + c * c), 1e-6) AS a, b / greatest(sqrt(a * a + b * b + c * c), 1e-6) AS b, c / greatest(sqrt(a * a + b * b + c * c), 1e-6) AS c FROM f),
    m AS (SELECT label, v, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM u GROUP BY 1, 2), n AS (SELECT * FROM m),
    e AS (SELECT label, v0 AS l, v1 AS r FROM face UNION SELECT label, v0, v2 FROM face UNION SELECT label, v2, v1 FROM face)"""


@query(with_views("vec", KNN + FACES + """, w AS (SELECT e.label, l, r, 1 - (x.a * y.a + x.b * y.b + x.c * y.c) AS bend, y.a * (q.x - p.x) + y.b * (q.y - p.y) + y.c * (q.z - p.z) AS away FROM e JOIN n x ON x.label = e.label AND x.v = l JOIN n y ON y.label = e.label AND y.v = r JOIN vec p ON p.vec_id = l JOIN vec q ON q.vec_id = r)
    SELECT label, l AS "left", r AS "right", CASE WHEN away > 1e-12 THEN bend * bend ELSE bend END AS weight FROM w"""))
def g6_mesh_weights(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the triangles of each point and its two nearest neighbours, by normals; convex ones squared."""
    k = cut(_knn(spark, d))
    faces = k.groupBy("label", F.col("a").alias("v0")).agg(F.max(F.when(F.col("place") == 1, F.col("b"))).alias("v1"), F.max(F.when(F.col("place") == 2, F.col("b"))).alias("v2"))
    return geometry.mesh_weights(_points(spark, d).select("label", "point_id", "x", "y", "z"), cut(faces), ["label"])


@query(with_views("vec", POINTS + """, m AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(r) AS r, avg(g) AS g, avg(b_) AS b_, avg(nx) AS a, avg(ny) AS b, avg(nz) AS c FROM pt GROUP BY 1) SELECT label, n, cx, cy, cz, r, g, b_, a / greatest(sqrt(a * a + b * b + c * c), 1e-6) AS nx, b / greatest(sqrt(a * a + b * b + c * c), 1e-6) AS ny, c / greatest(sqrt(a * a + b * b + c * c), 1e-6) AS nz FROM m"""))
def geo_segment_profile(spark: SparkSession, d: str) -> DataFrame:
    """Centre, colour and normal of each label's points."""
    return geometry.segment_profile(_points(spark, d), ["label"]).drop("planarity")


@query(with_views("vec", ", p AS (SELECT label, CAST(floor(x / 0.1) AS BIGINT) AS cx, CAST(floor(y / 0.1) AS BIGINT) AS cy, count(*) AS n, max(z) AS top FROM vec GROUP BY 1, 2, 3) SELECT * FROM p"))
def v12_image_grid(spark: SparkSession, d: str) -> DataFrame:
    """Points and highest z per cell of a grid over x and y."""
    return _points(spark, d).groupBy("label", F.floor(F.col("x") / 0.1).alias("cx"), F.floor(F.col("y") / 0.1).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("top"))


@query("SELECT label, vec_id, place FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('7/' || vec_id), vec_id) AS place FROM embeddings) WHERE place <= 20")
def v12_point_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty points of each label by the order of hashes: a sampling operator."""
    from scantable.operators.ranking import top_k

    order = [F.md5(F.concat(F.lit("7/"), F.col("vec_id").cast("string"))), F.col("vec_id")]
    return top_k(table(spark, d, "embeddings").select("label", "vec_id"), ["label"], order, 20)


# ---- diagnostics


@query(with_views("links obs", MEMBERS + f""", b AS (SELECT a.observation_id, {IOU} AS iou FROM obs a JOIN obs b ON a.scene_name = b.scene_name AND a.frame_index = b.frame_index AND a.observation_id <> b.observation_id), t AS (SELECT observation_id, max(iou) AS iou FROM b GROUP BY 1), v AS (SELECT m.trace_id, m.frame_index, max(t.iou) AS iou FROM m JOIN t USING (observation_id) WHERE m.frame_index IS NOT NULL AND t.iou > 0 GROUP BY 1, 2)
    SELECT trace_id, count(*) AS views, avg(iou) AS mean_iou, min(iou) AS min_iou, max(iou) AS max_iou FROM v GROUP BY 1"""))
def a27_projection_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Best box of each view of a trace, then mean, least and best over the views."""
    p = box_pairs(spark, d, overlapping=True)
    best = p.select(F.col("a_observation_id").alias("observation_id"), "iou").union(p.select("b_observation_id", "iou")).groupBy("observation_id").agg(F.max("iou").alias("iou"))
    m = links(spark, d).join(obs(spark, d).where("frame_index is not null").select("observation_id", "frame_index"), "observation_id").join(best, "observation_id")
    views = m.groupBy("trace_id", "frame_index").agg(F.max("iou").alias("iou"))
    return views.groupBy("trace_id").agg(F.count(F.lit(1)).alias("views"), F.avg("iou").alias("mean_iou"), F.min("iou").alias("min_iou"), F.max("iou").alias("max_iou"))


@query(with_views("pts", """, k AS (SELECT scene_name, item, count(*) AS k, min(candidate_id) AS candidate_id FROM pts GROUP BY 1, 2), u AS (SELECT scene_name, candidate_id, item, item - row_number() OVER (PARTITION BY scene_name, candidate_id ORDER BY item) AS island FROM k WHERE k = 1),
    r AS (SELECT scene_name, candidate_id, island, count(*) AS n FROM u GROUP BY 1, 2, 3) SELECT scene_name, candidate_id, sum(n) AS uncovered, max(n) AS largest, CASE WHEN max(n) >= 3 THEN 'new_candidate' ELSE 'existing_support' END AS action FROM r GROUP BY 1, 2"""))
def a41_largest_gap(spark: SparkSession, d: str) -> DataFrame:
    """Points of a seed that no other one has: how many, the largest connected part of them (points of consecutive ids are neighbours), and what they make of it."""
    alone = pts(spark, d).groupBy("scene_name", "item").agg(F.count(F.lit(1)).alias("k"), F.min("candidate_id").alias("candidate_id")).where("k = 1").select("scene_name", "candidate_id", "item")
    alone = cut(alone.withColumn("node", F.struct("scene_name", "candidate_id", "item")))
    follows = alone.select("scene_name", "candidate_id", (F.col("item") + 1).alias("item"), F.col("node").alias("before")).join(alone, ["scene_name", "candidate_id", "item"]).select("before", "node")
    parts = graph.components(follows, "before", "node", alone.select("node"))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select("component.scene_name", "component.candidate_id", "n")
    out = sizes.groupBy("scene_name", "candidate_id").agg(F.sum("n").alias("uncovered"), F.max("n").alias("largest"))
    return out.withColumn("action", F.when(F.col("largest") >= 3, "new_candidate").otherwise("existing_support"))


@query(with_views("cand", """SELECT record_id, CASE WHEN best_iou >= 0.5 AND NOT coalesce(fusion >= 0.5, false) THEN 'true_completion_50' WHEN best_iou >= 0.5 THEN 'covered_50' WHEN best_iou >= 0.25 AND NOT coalesce(fusion >= 0.5, false) THEN 'partial_completion_25' WHEN best_iou >= 0.25 THEN 'partial_duplicate_25'
    WHEN mean_iou >= 0.25 THEN 'class_error' WHEN existing_iou >= 0.3 THEN 'existing_overlap' ELSE 'background' END AS label FROM cand"""))
def f17_candidate_label(spark: SparkSession, d: str) -> DataFrame:
    """What a candidate is, in eight ordered steps; a missing baseline counts as missed."""
    c = F.col
    missed = ~F.coalesce(c("fusion") >= 0.5, F.lit(False))
    rules = [
        ("true_completion_50", (c("best_iou") >= 0.5) & missed), ("covered_50", c("best_iou") >= 0.5), ("partial_completion_25", (c("best_iou") >= 0.25) & missed), ("partial_duplicate_25", c("best_iou") >= 0.25),
        ("class_error", c("mean_iou") >= 0.25), ("existing_overlap", c("existing_iou") >= 0.3),
    ]
    return cand(spark, d).select("record_id", X.first_reason(rules, "background").alias("label"))


@query(with_views("cand", """SELECT record_id, CASE WHEN mean_iou < 0.1 AND views >= 2 THEN 'conflict_risk' WHEN existing_iou < 0.15 AND covered < 0.5 THEN 'new' WHEN existing_iou < 0.35 AND covered >= 0.7 THEN 'more_complete' WHEN area_ratio >= 0.5 AND existing_iou < 0.35 THEN 'plane_risk' WHEN existing_iou >= 0.5 OR covered >= 0.9 THEN 'duplicate' ELSE 'ambiguous' END AS relation FROM cand"""))
def f36_existing_relation(spark: SparkSession, d: str) -> DataFrame:
    """Relation of a candidate to what is there already, by an ordered cascade."""
    c = F.col
    rules = [
        ("conflict_risk", (c("mean_iou") < 0.1) & (c("views") >= 2)), ("new", (c("existing_iou") < 0.15) & (c("covered") < 0.5)), ("more_complete", (c("existing_iou") < 0.35) & (c("covered") >= 0.7)),
        ("plane_risk", (c("area_ratio") >= 0.5) & (c("existing_iou") < 0.35)), ("duplicate", (c("existing_iou") >= 0.5) | (c("covered") >= 0.9)),
    ]
    return cand(spark, d).select("record_id", X.first_reason(rules, "ambiguous").alias("relation"))


@query("SELECT d.scene_name FROM (SELECT DISTINCT scene_name FROM documents WHERE scene_name IS NOT NULL) d ANTI JOIN (SELECT DISTINCT scene_name FROM seed_points) s USING (scene_name)")
def i15_scenes_without_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Scenes that documents speak of and no seed was delivered for."""
    said = table(spark, d, "documents").where("scene_name is not null").select("scene_name").distinct()
    return said.join(table(spark, d, "seed_points").select("scene_name").distinct(), "scene_name", "left_anti")
