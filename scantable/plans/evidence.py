"""Queries over joins, set overlap, aggregates, votes, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scantable.common import cut, running_totals, same_name, table
from scantable.functions import exprs as X
from scantable.operators import ranking, sets, votes
from scantable.plans.registry import query
from scantable.plans.views import cand, links, obs, pts, vec, with_views

PAIRS = """, z AS (SELECT scene_name, candidate_id, count(*) AS n FROM pts GROUP BY 1, 2),
    j AS (SELECT a.scene_name, a.candidate_id AS a, b.candidate_id AS b, count(*) AS inter FROM pts a JOIN pts b ON a.scene_name = b.scene_name AND a.item = b.item AND a.candidate_id < b.candidate_id GROUP BY 1, 2, 3),
    pairs AS (SELECT j.scene_name, a, b, inter, x.n AS size_a, y.n AS size_b, inter / (x.n + y.n - inter)::DOUBLE AS iou, inter / least(x.n, y.n)::DOUBLE AS containment FROM j
        JOIN z x ON x.scene_name = j.scene_name AND x.candidate_id = a JOIN z y ON y.scene_name = j.scene_name AND y.candidate_id = b)"""


def seed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of all pairs of seeds that share a point, a < b."""
    p = pts(spark, d)
    return sets.overlap_pairs(p.withColumnRenamed("candidate_id", "a"), p.withColumnRenamed("candidate_id", "b"), ["scene_name"], "a", "b", extra=F.col("a") < F.col("b"))


# ---- joins


@query("""SELECT s.candidate_id, s.scene_name, c.record_id IS NOT NULL AS found, coalesce(c.record_id, -1) AS record_id FROM (SELECT DISTINCT candidate_id, scene_name FROM seed_points) s
    LEFT JOIN (SELECT scene_name, candidate_id, max(record_id) AS record_id FROM backprojection_candidates GROUP BY 1, 2) c USING (scene_name, candidate_id)""")
def j1_join_with_missing(spark: SparkSession, d: str) -> DataFrame:
    """Seeds with their candidate's last record, and those without one."""
    last = table(spark, d, "backprojection_candidates").groupBy("scene_name", "candidate_id").agg(F.max("record_id").alias("record_id"))
    seeds = table(spark, d, "seed_points").select("candidate_id", "scene_name").distinct()
    return seeds.join(last, ["scene_name", "candidate_id"], "left").select("candidate_id", "scene_name", F.col("record_id").isNotNull().alias("found"), F.coalesce("record_id", F.lit(-1)).alias("record_id"))


@query(with_views("cand obs", """SELECT k.class_id, k.name, coalesce(a.n, 0) AS n_candidates, coalesce(b.n, 0) AS n_observations FROM classes k LEFT JOIN (SELECT class_id, count(*) AS n FROM cand GROUP BY 1) a USING (class_id)
    LEFT JOIN (SELECT class_id, count(*) AS n FROM obs GROUP BY 1) b USING (class_id)"""))
def j2_three_way_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of two tables per class, 0 where there are none."""
    a = cand(spark, d).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    b = obs(spark, d).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_observations"))
    return table(spark, d, "classes").select("class_id", "name").join(a, "class_id", "left").join(b, "class_id", "left").fillna(0, ["n_candidates", "n_observations"])


@query("""WITH r AS (SELECT candidate_id, scene_name, nullif(regexp_replace(lower(source_kind), '[^\\p{L}\\p{N}]', '', 'g'), '') AS kind, max(record_id) AS id FROM backprojection_candidates GROUP BY 1, 2, 3),
    s AS (SELECT candidate_id, scene_name, max(id) AS id FROM r GROUP BY 1, 2)
    SELECT q.candidate_id, q.scene_name, coalesce(r.id, s.id, -1) AS record_id, CASE WHEN r.id IS NOT NULL THEN 'exact' WHEN s.id IS NOT NULL THEN 'fallback' ELSE 'none' END AS how
    FROM (SELECT DISTINCT candidate_id, scene_name FROM seed_points) q LEFT JOIN r ON r.candidate_id = q.candidate_id AND r.scene_name = q.scene_name AND r.kind = 'maskgraph' LEFT JOIN s ON s.candidate_id = q.candidate_id AND s.scene_name = q.scene_name""")
def j3_fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lookup by a precise key, then by a coarser one."""
    rows = table(spark, d, "backprojection_candidates").select("candidate_id", "scene_name", same_name("source_kind").alias("kind"), "record_id")
    fine = rows.where("kind = 'maskgraph'").groupBy("candidate_id", "scene_name").agg(F.max("record_id").alias("fine"))
    coarse = rows.groupBy("candidate_id", "scene_name").agg(F.max("record_id").alias("coarse"))
    asked = table(spark, d, "seed_points").select("candidate_id", "scene_name").distinct()
    out = asked.join(fine, ["candidate_id", "scene_name"], "left").join(coarse, ["candidate_id", "scene_name"], "left")
    how = F.when(F.col("fine").isNotNull(), "exact").when(F.col("coarse").isNotNull(), "fallback").otherwise("none")
    return out.select("candidate_id", "scene_name", F.coalesce("fine", "coarse", F.lit(-1)).alias("record_id"), how.alias("how"))


@query(with_views("pts", PAIRS + " SELECT scene_name, a, b, inter, size_a, size_b, iou, containment, inter / size_a::DOUBLE AS cover_a, inter / size_b::DOUBLE AS cover_b FROM pairs"))
def j5_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """IoU, containment and coverage of all pairs of seeds that share a point."""
    return seed_pairs(spark, d)


@query(with_views("pts", PAIRS + """, u AS (SELECT scene_name, a AS id, b AS other, iou FROM pairs UNION ALL SELECT scene_name, b, a, iou FROM pairs), m AS (SELECT scene_name, id, arg_max(other, (iou, -other)) AS other, max(iou) AS iou FROM u GROUP BY 1, 2)
    SELECT z.scene_name, z.candidate_id AS id, coalesce(other, -1) AS other, coalesce(iou, 0) AS iou FROM z LEFT JOIN m ON m.scene_name = z.scene_name AND m.id = z.candidate_id"""))
def j6_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Best partner of every seed."""
    p = seed_pairs(spark, d).select("scene_name", "a", "b", "iou")
    both = p.toDF("scene_name", "id", "other", "iou").union(p.select("scene_name", F.col("b"), F.col("a"), "iou"))
    return sets.best_match(both, pts(spark, d).select("scene_name", F.col("candidate_id").alias("id")).distinct(), ["scene_name", "id"], "other")


@query(with_views("obs", """SELECT o.observation_id AS point_id, b.observation_id AS box_id FROM obs o JOIN obs b ON o.scene_name = b.scene_name AND o.frame_index = b.frame_index AND o.observation_id <> b.observation_id
    AND (o.x1 + o.x2) / 2 BETWEEN b.x1 - 4 AND b.x2 + 4 AND (o.y1 + o.y2) / 2 BETWEEN b.y1 - 4 AND b.y2 + 4"""))
def j7_point_in_box(spark: SparkSession, d: str) -> DataFrame:
    """Centres of boxes inside other padded boxes of the same frame: an equi-join on frame and cell, then ranges."""
    o = obs(spark, d)
    p = o.select("scene_name", "frame_index", F.col("observation_id").alias("point_id"), ((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py"))
    p = p.withColumns({"cx": F.floor(F.col("px") / CELL), "cy": F.floor(F.col("py") / CELL)})
    b = o.select("scene_name", "frame_index", F.col("observation_id").alias("box_id"), "x1", "y1", "x2", "y2", _cells("x1", "x2", "cx", 4.0)).select("*", _cells("y1", "y2", "cy", 4.0))
    inside = F.col("px").between(F.col("x1") - 4, F.col("x2") + 4) & F.col("py").between(F.col("y1") - 4, F.col("y2") + 4)
    return p.join(b, ["scene_name", "frame_index", "cx", "cy"]).where(inside & (F.col("point_id") != F.col("box_id"))).select("point_id", "box_id")


IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / nullif((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
    - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)), 0)"""


#: Pixels of a cell's side in joins of boxes.
CELL = 64.0


def _cells(low: str, high: str, name: str, pad: float = 0.0) -> Column:
    """The cells an interval lies in, one row each."""
    return F.explode(F.sequence(F.floor((F.col(low) - pad) / CELL), F.floor((F.col(high) + pad) / CELL))).alias(name)


def box_pairs(spark: SparkSession, d: str, overlapping: bool = False) -> DataFrame:
    """Pairs of observations of a frame with their box IoU, a < b; all of them, or those that overlap.

    Overlapping boxes meet in the cell of the corner where their overlap begins, so each pair once; a crowded frame isn't squared.
    """
    o = obs(spark, d)
    names = ("observation_id", "class_id", "score", "x1", "y1", "x2", "y2")
    if overlapping:
        o = o.select("scene_name", "frame_index", *names, _cells("x1", "x2", "cx")).select("*", _cells("y1", "y2", "cy"))
    key = ["scene_name", "frame_index", *(["cx", "cy"] if overlapping else [])]
    side = lambda s: o.select(*key, *[F.col(c).alias(f"{s}_{c}") for c in names])
    met = side("a").join(side("b"), key).where("a_observation_id < b_observation_id")
    if overlapping:
        begins = lambda axis: F.floor(F.greatest(f"a_{axis}1", f"b_{axis}1") / CELL)
        met = met.where((begins("x") == F.col("cx")) & (begins("y") == F.col("cy"))).drop("cx", "cy")
    box = lambda s: tuple(F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2"))
    out = met.withColumn("iou", X.box_iou(box("a"), box("b")))
    return out.where("iou > 0") if overlapping else out


@query(with_views("obs", f"SELECT * FROM (SELECT a.observation_id AS a, b.observation_id AS b, {IOU} AS iou FROM obs a JOIN obs b ON a.scene_name = b.scene_name AND a.frame_index = b.frame_index AND a.observation_id < b.observation_id) WHERE iou >= 0.05"))
def j8_box_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping boxes of a frame."""
    return box_pairs(spark, d, overlapping=True).where("iou >= 0.05").select(F.col("a_observation_id").alias("a"), F.col("b_observation_id").alias("b"), "iou")


@query(with_views("links obs", """SELECT a.observation_id AS a, b.observation_id AS b, count(*) AS shared FROM links a JOIN links b ON a.trace_id = b.trace_id AND a.observation_id < b.observation_id
    JOIN obs x ON x.observation_id = a.observation_id JOIN obs y ON y.observation_id = b.observation_id AND x.frame_index <> y.frame_index GROUP BY 1, 2"""))
def j9_cross_view_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of observations of different frames that share a trace, by the inverted index."""
    at = obs(spark, d).select("observation_id", "frame_index")
    seen = links(spark, d).select("trace_id", "observation_id").distinct().join(at, "observation_id").select("trace_id", "observation_id", "frame_index")
    met = seen.toDF("trace_id", "a", "fa").join(seen.toDF("trace_id", "b", "fb"), "trace_id").where("a < b and fa <> fb")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query(with_views("pts", """, c AS (SELECT scene_name, item, count(DISTINCT candidate_id) AS k FROM pts GROUP BY 1, 2 HAVING k >= 2), t AS (SELECT scene_name FROM c GROUP BY 1 HAVING count(*) >= 5)
    SELECT scene_name, candidate_id, item FROM pts WHERE (scene_name, item) NOT IN (SELECT (scene_name, item) FROM c WHERE scene_name IN (SELECT scene_name FROM t))"""))
def j10_shared_removed(spark: SparkSession, d: str) -> DataFrame:
    """Points without those that several seeds of a scene share, where these are many."""
    return sets.shared_cells(pts(spark, d), ["scene_name"], ["item"], "candidate_id", 5)


@query(with_views("cand", "SELECT split, is_base, count(*) AS n, avg(score) AS mean_score FROM cand JOIN classes USING (class_id) GROUP BY 1, 2"))
def j11_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by split, over a fixed dimension."""
    return cand(spark, d).join(F.broadcast(table(spark, d, "classes")), "class_id").groupBy("split", "is_base").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query(with_views("links obs", "SELECT scene_name, observation_id FROM obs WHERE score >= 0.5 AND observation_id NOT IN (SELECT observation_id FROM links)"))
def j12_unclaimed(spark: SparkSession, d: str) -> DataFrame:
    """Reliable observations that no trace claims."""
    return obs(spark, d).where("score >= 0.5").join(links(spark, d), "observation_id", "left_anti").select("scene_name", "observation_id")


@query(with_views("vec", """SELECT label, a, b, d2, place FROM (SELECT p.label, p.vec_id AS a, q.vec_id AS b, (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 AS d2, row_number() OVER (PARTITION BY p.vec_id ORDER BY (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2, q.vec_id) AS place
    FROM vec p JOIN vec q ON p.label = q.label AND p.vec_id <> q.vec_id) WHERE place <= 3"""))
def j13_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Three nearest points of the same label, by growing grid cells."""
    from scantable.operators.geometry import nearest

    v = vec(spark, d)
    return nearest(v.withColumnRenamed("vec_id", "a"), v.withColumnRenamed("vec_id", "b"), ["label"], ["x", "y", "z"], 3, 0.05)


@query(with_views("vec", "SELECT p.label, p.vec_id AS a, q.vec_id AS b, (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 AS d2 FROM vec p JOIN vec q ON p.label = q.label AND p.vec_id < q.vec_id WHERE (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 <= 0.0064"))
def j14_radius(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within a radius."""
    from scantable.operators.geometry import near_pairs

    v = vec(spark, d)
    return near_pairs(v.withColumnRenamed("vec_id", "a"), v.withColumnRenamed("vec_id", "b"), ["label"], ["x", "y", "z"], 0.08).where("a < b")


# ---- aggregates and votes


@query(with_views("links obs", """, v AS (SELECT trace_id, coalesce(class_id, -1) AS l, count(*) AS c FROM links JOIN obs USING (observation_id) GROUP BY 1, 2)
    SELECT trace_id, coalesce(arg_max(l, (c, -l)) FILTER (WHERE l >= 0), 47) AS class_id, coalesce(max(c) FILTER (WHERE l >= 0), 0) / sum(c)::DOUBLE AS share FROM v GROUP BY 1"""))
def a1_class_vote(spark: SparkSession, d: str) -> DataFrame:
    """Class of every trace by vote of its observations."""
    rows = links(spark, d).select("trace_id", "observation_id").join(obs(spark, d).select("observation_id", F.coalesce("class_id", F.lit(-1)).alias("class_id")), "observation_id")
    return votes.class_vote(rows, ["trace_id"], "class_id", 47)


@query(with_views("links obs", ", v AS (SELECT trace_id, class_id, count(*) AS c FROM links JOIN obs USING (observation_id) WHERE class_id >= 0 GROUP BY 1, 2) SELECT trace_id, class_id, c / max(c) OVER (PARTITION BY trace_id)::DOUBLE AS weight FROM v"))
def a2_label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every trace over its most frequent one."""
    rows = links(spark, d).select("trace_id", "observation_id").join(obs(spark, d).select("observation_id", "class_id"), "observation_id")
    return votes.label_distribution(rows, ["trace_id"], "class_id")


CONSENSUS = """, e AS (SELECT scene_name, candidate_id, t.class_id AS target, o.class_id AS l, sum(coalesce(o.score, 0) * coalesce(o.sam_score, 0)) AS e FROM (SELECT DISTINCT candidate_id, m AS observation_id FROM (SELECT candidate_id, unnest(member_observation_ids) AS m FROM mask_graph_trace
    WHERE candidate_id IS NOT NULL) WHERE m >= 0) k JOIN obs o USING (observation_id) JOIN (SELECT candidate_id, arg_max(class_id, record_id) FILTER (WHERE class_id IS NOT NULL) AS class_id FROM backprojection_candidates GROUP BY 1) t USING (candidate_id)
    WHERE o.class_id IS NOT NULL AND t.class_id IS NOT NULL GROUP BY 1, 2, 3, 4), f AS (SELECT *, sum(e) OVER (PARTITION BY scene_name, candidate_id) AS total FROM e)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    trace = sets.explode_sets(table(spark, d, "mask_graph_trace").where("candidate_id is not null"), "member_observation_ids", "candidate_id", name="observation_id")
    target = table(spark, d, "backprojection_candidates").groupBy("candidate_id").agg(F.max_by("class_id", F.when(F.col("class_id").isNotNull(), F.col("record_id"))).alias("target"))
    o = obs(spark, d).select("observation_id", "scene_name", "class_id", (F.coalesce("score", F.lit(0.0)) * F.coalesce("sam_score", F.lit(0.0))).alias("e"))
    return trace.join(o, "observation_id").join(target, "candidate_id").where("class_id is not null and target is not null")


@query(with_views("obs", CONSENSUS + """ SELECT scene_name, candidate_id, sum(e) FILTER (WHERE l = target) / any_value(total) AS consensus_raw, coalesce(sum(e) FILTER (WHERE l = target), 0) / any_value(total) AS label_consensus_score,
    greatest(0, 1 - coalesce(sum(e) FILTER (WHERE l = target), 0) / any_value(total)) AS label_conflict_score, (coalesce(sum(e) FILTER (WHERE l = target), 0) - coalesce(max(e) FILTER (WHERE l <> target), 0)) / any_value(total) AS label_margin,
    -sum(e / total * ln(greatest(e / total, 1e-12))) / ln(greatest(2, count(*))) AS label_entropy, any_value(total) AS total_evidence, arg_max(l, (e, -l)) FILTER (WHERE l <> target) AS top_conflict, coalesce(max(e) FILTER (WHERE l <> target), 0) AS top_conflict_evidence
    FROM f WHERE total > 0 GROUP BY 1, 2""").replace("sum(e) FILTER (WHERE l = target) / any_value(total) AS consensus_raw, ", ""))
def a4_label_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of a candidate's observations with its class."""
    return votes.label_consensus(_evidence(spark, d), ["scene_name", "candidate_id"], "class_id", "e", "target")


@query(with_views("links obs", "SELECT trace_id, 1 - product(1 - score) AS evidence FROM links JOIN obs USING (observation_id) WHERE score IS NOT NULL GROUP BY 1"))
def a7_noisy_or(spark: SparkSession, d: str) -> DataFrame:
    """Joint confidence of a trace's observations."""
    rows = links(spark, d).select("trace_id", "observation_id").join(obs(spark, d).select("observation_id", "score"), "observation_id").where("score is not null")
    return votes.noisy_or(rows, ["trace_id"], "score")


@query(with_views("obs", CONSENSUS + """, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY e DESC, l) AS place FROM e),
    b AS (SELECT candidate_id, target, max(l) FILTER (WHERE place = 1) AS best_label, max(e) FILTER (WHERE place = 1) AS best, coalesce(max(e) FILTER (WHERE place = 2), 0) AS second FROM r WHERE place <= 2 GROUP BY 1, 2)
    SELECT *, CASE WHEN best_label = target THEN 'keep_same' WHEN best < 0.3 THEN 'weak' WHEN best - second < 0.1 THEN 'margin' ELSE 'replace' END AS decision FROM b"""))
def a8_rescore(spark: SparkSession, d: str) -> DataFrame:
    """Whether a candidate's class gives way to its best-supported one."""
    best = _evidence(spark, d).groupBy("scene_name", "candidate_id", "target", "class_id").agg(F.sum("e").alias("e"))
    return votes.rescore(best, ["candidate_id"], "class_id", "e", "target", 0.3, 0.1)


@query(with_views("cand", "SELECT record_id, CASE WHEN stddev_pop(score) OVER w < 1e-6 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END AS z FROM cand WINDOW w AS (PARTITION BY scene_name, kind)"))
def a9_group_z(spark: SparkSession, d: str) -> DataFrame:
    """z-scores within scene and source."""
    return ranking.with_group_z(cand(spark, d).select("record_id", "scene_name", "kind", "score"), ["scene_name", "kind"], "score").select("record_id", "z")


@query(with_views("cand", "SELECT kind, class_name, count(*) AS n, avg(score) AS mean_score, avg(views) AS mean_views, grouping(kind) * 2 + grouping(class_name) AS level FROM cand GROUP BY GROUPING SETS ((kind), (class_name), (kind, class_name))"))
def a10_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Means by source, by class and by both, in one pass."""
    rows = cand(spark, d)
    return rows.groupingSets([[F.col("kind")], [F.col("class_name")], [F.col("kind"), F.col("class_name")]], "kind", "class_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("views").alias("mean_views"), F.grouping_id().cast("long").alias("level")
    )


@query(with_views("cand", "SELECT kind, min(mean_iou) AS min_iou, avg(mean_iou) AS mean_iou, max(mean_iou) AS max_iou, min(covered) AS min_covered, avg(covered) AS mean_covered, max(covered) AS max_covered FROM cand GROUP BY 1"))
def a11_feature_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Least, mean and largest of features per source."""
    return cand(spark, d).groupBy("kind").agg(*[f(c).alias(f"{n}_{a}") for c, a in (("mean_iou", "iou"), ("covered", "covered")) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])


@query(with_views("cand", """SELECT CASE WHEN grouping(kind) = 1 THEN 'total' ELSE coalesce(kind, 'none') END AS kind, count(*) FILTER (WHERE split = 'head') AS head, count(*) FILTER (WHERE split = 'common') AS common, count(*) FILTER (WHERE split = 'tail') AS tail, count(*) AS total
    FROM cand JOIN classes USING (class_id) GROUP BY GROUPING SETS ((kind), ())"""))
def a12_cross_table(spark: SparkSession, d: str) -> DataFrame:
    """Cross table of source and split with totals."""
    rows = cand(spark, d).join(F.broadcast(table(spark, d, "classes").select("class_id", "split")), "class_id")
    name = F.when(F.grouping("kind") == 1, "total").otherwise(F.coalesce("kind", F.lit("none")))
    return rows.groupingSets([[F.col("kind")], []], "kind").agg(name.alias("name"), *[F.count_if(F.col("split") == s).alias(s) for s in ("head", "common", "tail")], F.count(F.lit(1)).alias("total")).select(F.col("name").alias("kind"), "head", "common", "tail", "total")


@query(with_views("pts", ", z AS (SELECT scene_name, candidate_id, count(*) AS n FROM pts GROUP BY 1, 2) SELECT scene_name, count(*) AS segments, avg(n) AS mean_size, quantile_cont(n, 0.5) AS median_size, quantile_cont(n, 0.9) AS p90_size, quantile_cont(n, 0.99) AS p99_size, max(n) AS max_size, count(*) FILTER (WHERE n > 10) AS over_10, count(*) FILTER (WHERE n > 50) AS over_50 FROM z GROUP BY 1"))
def a13_segment_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of seed sizes per scene."""
    return sets.segment_sizes(pts(spark, d), ["scene_name"], "candidate_id")


@query(with_views("obs", """, v AS (SELECT scene_name, frame_index, coalesce(class_id, -1) AS l, count(*) AS c FROM obs WHERE frame_index IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT scene_name, frame_index, sum(c) AS n, coalesce(max(c) FILTER (WHERE l >= 0), 0) / sum(c)::DOUBLE AS s FROM v GROUP BY 1, 2)
    SELECT scene_name, count(*) AS segments, count(*) FILTER (WHERE s < 0.95) AS mixed_segments, coalesce(sum(n) FILTER (WHERE s < 0.95), 0) AS mixed_points, sum(n * s) / sum(n) AS weighted_purity FROM p GROUP BY 1"""))
def a14_purity(spark: SparkSession, d: str) -> DataFrame:
    """How pure the frames of a scene are in class."""
    rows = obs(spark, d).where("frame_index is not null").withColumn("class_id", F.coalesce("class_id", F.lit(-1)))
    return sets.purity_summary(sets.purity(rows, ["scene_name"], "frame_index", "class_id"), ["scene_name"])


@query(with_views("obs", """, c AS (SELECT scene_name, class_id AS r, frame_index AS f, count(*) AS n FROM obs WHERE class_id IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1, 2, 3), a AS (SELECT scene_name, r, count(*) AS k, sum(n) AS n FROM c GROUP BY 1, 2), b AS (SELECT scene_name, f, count(*) AS k, sum(n) AS n FROM c GROUP BY 1, 2),
    x AS (SELECT scene_name, count(*) AS reference_segments, count(*) FILTER (WHERE k > 1) AS split_reference_segments, coalesce(sum(n) FILTER (WHERE k > 1), 0) AS split_reference_points, sum(n) AS point_count FROM a GROUP BY 1),
    y AS (SELECT scene_name, count(*) AS compared_segments, count(*) FILTER (WHERE k > 1) AS merged_compared_segments, coalesce(sum(n) FILTER (WHERE k > 1), 0) AS merged_compared_points FROM b GROUP BY 1) SELECT * FROM x JOIN y USING (scene_name)"""))
def a15_partition_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How frames split and merge classes."""
    return sets.partition_overlap(obs(spark, d), ["scene_name"], "class_id", "frame_index")


@query(with_views("obs", """, a AS (SELECT scene_name, class_id, sum(score) AS w FROM obs WHERE class_id IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2), b AS (SELECT scene_name, class_id, sum(sam_score) AS w FROM obs WHERE class_id IS NOT NULL AND sam_score IS NOT NULL GROUP BY 1, 2)
    SELECT scene_name, sum(least(coalesce(a.w, 0), coalesce(b.w, 0))) AS overlap_mass, sum(greatest(coalesce(a.w, 0), coalesce(b.w, 0))) AS union_mass, sum(least(coalesce(a.w, 0), coalesce(b.w, 0))) / sum(greatest(coalesce(a.w, 0), coalesce(b.w, 0))) AS jaccard FROM a FULL JOIN b USING (scene_name, class_id) GROUP BY 1"""))
def a16_weighted_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Weighted Jaccard of two score masses per scene over classes."""
    o = obs(spark, d).where("class_id is not null")
    return sets.weighted_jaccard(o.where("score is not null"), o.where("sam_score is not null").withColumn("score", F.col("sam_score")), ["scene_name"], "class_id", "score")


@query(with_views("pts", """, g AS (SELECT scene_name, candidate_id, CAST(floor(item / 100) AS BIGINT) AS seg, count(*) AS hits FROM pts GROUP BY 1, 2, 3), s AS (SELECT scene_name, CAST(floor(item / 100) AS BIGINT) AS seg, count(DISTINCT item) AS size FROM pts GROUP BY 1, 2)
    SELECT scene_name, candidate_id, seg, hits, size, hits / size::DOUBLE AS coverage, CASE WHEN hits / size::DOUBLE >= 0.8 THEN 'core' WHEN hits / size::DOUBLE >= 0.3 THEN 'partial' ELSE 'weak' END AS band FROM g JOIN s USING (scene_name, seg)"""))
def a18_segment_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each block of points that a seed covers."""
    p = pts(spark, d).withColumn("seg", F.floor(F.col("item") / 100))
    sizes = p.groupBy("scene_name", "seg").agg(F.count_distinct("item").alias("size"))
    return sets.segment_coverage(p, sizes, ["scene_name", "candidate_id"], "seg")


@query(with_views("links obs", """, t AS (SELECT trace_id, name, sum(coalesce(score, 0)) AS v FROM links JOIN obs USING (observation_id) LEFT JOIN classes USING (class_id) GROUP BY 1, 2)
    SELECT a.trace_id, a.confidence, a.frames, b.name FROM (SELECT trace_id, sum(coalesce(score, 0) * coalesce(sam_score, 0)) AS confidence, count(DISTINCT frame_index) AS frames FROM links JOIN obs USING (observation_id) GROUP BY 1) a
    JOIN (SELECT trace_id, arg_max(name, (v, name)) FILTER (WHERE name IS NOT NULL) AS name FROM t GROUP BY 1) b USING (trace_id)"""))
def a19_track_summary(spark: SparkSession, d: str) -> DataFrame:
    """Confidence, frames and winning class of every trace; a tie of votes goes to the larger name."""
    o = obs(spark, d).select("observation_id", "frame_index", "class_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("sam_score", F.lit(0.0)).alias("sam"))
    rows = cut(links(spark, d).select("trace_id", "observation_id").join(o, "observation_id").join(F.broadcast(table(spark, d, "classes").select("class_id", "name")), "class_id", "left"))
    total = rows.groupBy("trace_id").agg(F.sum(F.col("score") * F.col("sam")).alias("confidence"), F.count_distinct("frame_index").alias("frames"))
    vote = rows.groupBy("trace_id", "name").agg(F.sum("score").alias("v"))
    return total.join(vote.groupBy("trace_id").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("v", "name"))).alias("name")), "trace_id")


@query(with_views("links obs", """, r AS (SELECT l.scene_name, trace_id, class_id, frame_index, coalesce(score, 0) AS s FROM links l JOIN obs USING (observation_id) WHERE class_id IS NOT NULL), t AS (SELECT scene_name, trace_id, count(DISTINCT frame_index) AS f FROM r GROUP BY 1, 2),
    e AS (SELECT scene_name, trace_id, class_id, sum(s) AS weight, count(DISTINCT frame_index) AS views FROM r GROUP BY 1, 2, 3) SELECT scene_name, trace_id, class_id, weight, views FROM e JOIN t USING (scene_name, trace_id) WHERE weight >= 0.5 AND views >= CASE WHEN f > 1 THEN 2 ELSE 1 END"""))
def a21_point_vote(spark: SparkSession, d: str) -> DataFrame:
    """Labels of traces with enough weight and, over several views, two of them."""
    o = obs(spark, d).select("observation_id", "frame_index", "class_id", F.coalesce("score", F.lit(0.0)).alias("s")).where("class_id is not null")
    return votes.point_vote(links(spark, d).join(o, "observation_id"), ["scene_name", "trace_id"], "class_id", "s", 0.5, 1, "frame_index")


@query(with_views("links obs", ", p AS (SELECT a.observation_id AS l, b.observation_id AS r FROM links a JOIN links b ON a.trace_id = b.trace_id AND a.observation_id < b.observation_id) SELECT least(x.class_id, y.class_id) AS class_a, greatest(x.class_id, y.class_id) AS class_b, count(*) AS contacts, avg(abs(x.score - y.score)) AS mean_diff FROM p JOIN obs x ON x.observation_id = l JOIN obs y ON y.observation_id = r WHERE x.class_id IS NOT NULL AND y.class_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2"))
def a24_edge_aggregation(spark: SparkSession, d: str) -> DataFrame:
    """Contacts between classes over pairs of linked observations."""
    o = obs(spark, d).select("observation_id", "class_id", "score").where("class_id is not null")
    seen = links(spark, d).select("trace_id", "observation_id").join(o, "observation_id").select("trace_id", "observation_id", "class_id", "score")
    met = seen.toDF("t", "a", "ca", "sa").join(seen.toDF("t", "b", "cb", "sb"), "t").where("a < b")
    return met.groupBy(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b")).agg(F.count(F.lit(1)).alias("contacts"), F.avg(F.abs(F.col("sa") - F.col("sb"))).alias("mean_diff")).where("contacts >= 2")


@query(with_views("cand obs", "SELECT before, count(*) AS fired, count(*) FILTER (WHERE score > 0.8) AS high FROM (SELECT CASE WHEN views < 2 THEN 'single' ELSE 'multi' END AS before, score FROM cand) GROUP BY 1"))
def a38_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters over rows."""
    return cand(spark, d).groupBy(F.when(F.col("views") < 2, "single").otherwise("multi").alias("before")).agg(F.count(F.lit(1)).alias("fired"), F.count_if(F.col("score") > 0.8).alias("high"))


@query(with_views("cand", "SELECT class_id, count(*) AS n, count(*) FILTER (WHERE mean_iou >= 0.5) AS n_good, count(*) FILTER (WHERE mean_iou >= 0.5) / count(*)::DOUBLE AS good_rate, avg(score) FILTER (WHERE mean_iou >= 0.5) AS good_score FROM cand GROUP BY 1"))
def a39_threshold_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rates over a threshold per class."""
    good = F.col("mean_iou") >= 0.5
    return cand(spark, d).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_good"), (F.count_if(good) / F.count(F.lit(1))).alias("good_rate"), F.avg(F.when(good, F.col("score"))).alias("good_score"))


@query(with_views("pts", PAIRS + """, u AS (SELECT scene_name, a AS id, b AS other, iou, inter / size_a::DOUBLE AS cover FROM pairs UNION ALL SELECT scene_name, b, a, iou, inter / size_b::DOUBLE FROM pairs),
    c AS (SELECT a.scene_name, a.candidate_id AS id, count(DISTINCT a.item) AS covered FROM pts a JOIN pts b ON a.scene_name = b.scene_name AND a.item = b.item AND a.candidate_id <> b.candidate_id GROUP BY 1, 2)
    SELECT z.scene_name, z.candidate_id AS id, coalesce(covered, 0) / z.n::DOUBLE AS covered_ratio, coalesce(max(iou), 0) AS best_iou, coalesce(max(cover), 0) AS best_coverage FROM z LEFT JOIN c ON c.scene_name = z.scene_name AND c.id = z.candidate_id LEFT JOIN u ON u.scene_name = z.scene_name AND u.id = z.candidate_id GROUP BY 1, 2, 3"""))
def a40_against_all(spark: SparkSession, d: str) -> DataFrame:
    """A seed against all others: covered by any, best IoU, best coverage."""
    p = pts(spark, d)
    several = p.groupBy("scene_name", "item").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    covered = p.join(several, ["scene_name", "item"], "left_semi").groupBy("scene_name", F.col("candidate_id").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    size = p.groupBy("scene_name", F.col("candidate_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    q = seed_pairs(spark, d)
    best = q.select("scene_name", F.col("a").alias("id"), "iou", F.col("cover_a").alias("cover")).union(q.select("scene_name", "b", "iou", "cover_b")).groupBy("scene_name", "id").agg(F.max("iou").alias("iou"), F.max("cover").alias("cover"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return size.join(covered, ["scene_name", "id"], "left").join(best, ["scene_name", "id"], "left").select("scene_name", "id", zero(F.col("c") / F.col("n")).alias("covered_ratio"), zero("iou").alias("best_iou"), zero("cover").alias("best_coverage"))


@query(with_views("cand", "SELECT record_id, CASE WHEN count(*) OVER c >= 20 THEN CASE WHEN stddev_pop(score) OVER c < 1e-6 THEN 0 ELSE (score - avg(score) OVER c) / stddev_pop(score) OVER c END ELSE CASE WHEN stddev_pop(score) OVER s < 1e-6 THEN 0 ELSE (score - avg(score) OVER s) / stddev_pop(score) OVER s END END AS z FROM cand WINDOW c AS (PARTITION BY scene_name, class_id), s AS (PARTITION BY scene_name)"))
def a43_z_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """z-score in the class, or in the scene where the class is small."""
    return ranking.with_group_z(cand(spark, d).select("record_id", "scene_name", "class_id", "score"), ["scene_name", "class_id"], "score", fallback=["scene_name"], least=20).select("record_id", "z")


# ---- ranks


@query(with_views("obs", "SELECT observation_id, place FROM (SELECT observation_id, row_number() OVER (PARTITION BY scene_name, frame_index ORDER BY score DESC NULLS LAST, observation_id) AS place FROM obs) WHERE place <= 3"))
def o3_top_per_frame(spark: SparkSession, d: str) -> DataFrame:
    """Best three observations of every frame."""
    return ranking.top_k(obs(spark, d), ["scene_name", "frame_index"], [F.col("score").desc_nulls_last(), F.col("observation_id")], 3).select("observation_id", "place")


@query(with_views("cand", "SELECT record_id, row_number() OVER (PARTITION BY scene_name ORDER BY views DESC, mean_iou DESC, score DESC, record_id) AS by_support, row_number() OVER (PARTITION BY scene_name ORDER BY score * mean_iou DESC, record_id) AS by_product FROM cand"))
def o4_policies(spark: SparkSession, d: str) -> DataFrame:
    """Places of records under two orders."""
    w = Window.partitionBy("scene_name")
    return cand(spark, d).select("record_id", F.row_number().over(w.orderBy(F.desc("views"), F.desc("mean_iou"), F.desc("score"), "record_id")).alias("by_support"), F.row_number().over(w.orderBy((F.col("score") * F.col("mean_iou")).desc(), "record_id")).alias("by_product"))


@query(with_views("cand", "SELECT record_id FROM (SELECT record_id, score, max(score) OVER (PARTITION BY scene_name, class_id) AS b, count(*) OVER (PARTITION BY scene_name, class_id) AS n, row_number() OVER (PARTITION BY scene_name, class_id ORDER BY score DESC NULLS LAST, record_id) AS p FROM cand) WHERE score >= b * 0.9 OR p <= ceil(n * 0.2)"))
def o5_relative_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Records near their class's best, and a least share of each class."""
    return ranking.relative_threshold(cand(spark, d).select("record_id", "scene_name", "class_id", "score"), ["scene_name", "class_id"], "score", 0.9, 0.2, "record_id").select("record_id")


@query(with_views("links obs", ", r AS (SELECT l.scene_name, trace_id, observation_id, row_number() OVER (PARTITION BY l.scene_name, trace_id ORDER BY score DESC NULLS LAST, observation_id) AS p FROM links l JOIN obs USING (observation_id)) SELECT scene_name, trace_id, count(*) AS merged, max(observation_id) FILTER (WHERE p = 1) AS best_view FROM r WHERE p <= 2 GROUP BY 1, 2"))
def o6_seed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Best view and union of the best two views of every trace."""
    rows = links(spark, d).join(obs(spark, d).select("observation_id", "score"), "observation_id")
    top = ranking.top_k(rows, ["scene_name", "trace_id"], [F.col("score").desc_nulls_last(), F.col("observation_id")], 2)
    return top.groupBy("scene_name", "trace_id").agg(F.count(F.lit(1)).alias("merged"), F.max(F.when(F.col("place") == 1, F.col("observation_id"))).alias("best_view"))


@query(with_views("cand", "SELECT record_id, sum(score) OVER (PARTITION BY scene_name ORDER BY score DESC, record_id ROWS UNBOUNDED PRECEDING) AS running FROM cand"))
def o7_running_sum(spark: SparkSession, d: str) -> DataFrame:
    """Running sum by score."""
    rows = cand(spark, d).select("record_id", "scene_name", "score")
    return running_totals(rows, ["scene_name"], [F.desc("score"), F.col("record_id")], {"running": ("sum", "score")}).select("record_id", "running")


@query("SELECT scene_name, row_number() OVER (ORDER BY try_cast(regexp_extract(scene_name, '([0-9]+)', 1) AS BIGINT) NULLS FIRST, scene_name) AS place FROM (SELECT DISTINCT scene_name FROM observations WHERE scene_name IS NOT NULL)")
def o8_natural_sort(spark: SparkSession, d: str) -> DataFrame:
    """Scenes in natural order."""
    names = table(spark, d, "observations").where("scene_name is not null").select("scene_name").distinct()
    return names.select("scene_name", F.row_number().over(Window.orderBy(*ranking.natural_order("scene_name"))).alias("place"))


@query("SELECT scene_name, frame_index FROM (SELECT scene_name, frame_index, row_number() OVER (PARTITION BY scene_name ORDER BY frame_index) - 1 AS p FROM (SELECT DISTINCT scene_name, frame_index FROM observations WHERE frame_index IS NOT NULL)) WHERE p % 5 = 0 AND p < 50")
def o9_every_nth(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth frame of a scene, ten at most."""
    frames = table(spark, d, "observations").where("frame_index is not null").select("scene_name", "frame_index").distinct()
    return ranking.every_nth(frames, ["scene_name"], "frame_index", 5, 10)


@query(with_views("cand", ", s AS (SELECT scene_name, avg(mean_iou) AS iou, count(*) AS n FROM cand GROUP BY 1), u AS ((SELECT scene_name, 'low_iou' AS r FROM s ORDER BY iou, scene_name LIMIT 5) UNION ALL (SELECT scene_name, 'many' FROM s ORDER BY n DESC, scene_name LIMIT 5)) SELECT scene_name, string_agg(r, ';' ORDER BY r) AS reasons FROM u GROUP BY 1"))
def o10_review_list(spark: SparkSession, d: str) -> DataFrame:
    """Scenes to look at, with all reasons."""
    s = cand(spark, d).groupBy("scene_name").agg(F.avg("mean_iou").alias("iou"), F.count(F.lit(1)).alias("n"))
    return ranking.review_list(s, "scene_name", [("low_iou", F.col("iou").asc(), 5), ("many", F.col("n").desc(), 5)])


# ---- set operations


@query(with_views("pts", "SELECT scene_name, count(DISTINCT item) AS union_size FROM pts GROUP BY 1"))
def s2_union_size(spark: SparkSession, d: str) -> DataFrame:
    """Points of a scene that any seed has."""
    return pts(spark, d).select("scene_name", "item").distinct().groupBy("scene_name").agg(F.count(F.lit(1)).alias("union_size"))


@query("SELECT round_, dense_rank() OVER (ORDER BY round_, old_id) - 1 AS new_id, old_id FROM (SELECT 1 AS round_, candidate_id AS old_id FROM seed_points UNION SELECT 2, observation_id FROM observations)")
def s4_renumbered_union(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds under one dense numbering, by the exact distributed rank."""
    from scantable.common import distributed_rank

    a = table(spark, d, "seed_points").select(F.lit(1).alias("round_"), F.col("candidate_id").alias("old_id"))
    both = a.union(table(spark, d, "observations").select(F.lit(2), "observation_id")).distinct().withColumn("one", F.lit(1))
    return distributed_rank(both, ["one"], [F.col("round_"), F.col("old_id")], "n").select("round_", (F.col("n") - 1).alias("new_id"), "old_id")


@query("SELECT scene_name, dense_rank() OVER (ORDER BY scene_name) - 1 AS scene_index, count(*) AS n FROM observations WHERE scene_name IS NOT NULL GROUP BY 1")
def s5_dense_index(spark: SparkSession, d: str) -> DataFrame:
    """Dense index of scenes."""
    n = table(spark, d, "observations").where("scene_name is not null").groupBy("scene_name").agg(F.count(F.lit(1)).alias("n"))
    return n.select("scene_name", (F.dense_rank().over(Window.orderBy("scene_name")) - 1).alias("scene_index"), "n")


@query("""WITH r AS (SELECT scene_name, candidate_id, record_id, class_id, row_number() OVER (PARTITION BY scene_name, candidate_id ORDER BY record_id DESC) AS p FROM backprojection_candidates), a AS (SELECT * FROM r WHERE p = 1), b AS (SELECT * FROM r WHERE p = 2)
    SELECT a.scene_name, a.candidate_id, CASE WHEN b.candidate_id IS NULL THEN 'new' ELSE 'changed' END AS change, b.class_id AS before, a.class_id AS after FROM a LEFT JOIN b USING (scene_name, candidate_id) WHERE b.candidate_id IS NULL OR a.class_id IS DISTINCT FROM b.class_id""")
def s8_run_changes(spark: SparkSession, d: str) -> DataFrame:
    """What is new or changed in the last record of a candidate."""
    w = Window.partitionBy("scene_name", "candidate_id").orderBy(F.desc("record_id"))
    r = table(spark, d, "backprojection_candidates").select("scene_name", "candidate_id", "class_id", F.row_number().over(w).alias("p")).where("p <= 2")
    two = r.groupBy("scene_name", "candidate_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("p") == 2, F.col("class_id"))).alias("before"), F.max(F.when(F.col("p") == 1, F.col("class_id"))).alias("after"))
    change = F.when(F.col("n") == 1, "new").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return two.select("scene_name", "candidate_id", change.alias("change"), "before", "after").where("change is not null")
