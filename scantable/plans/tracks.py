"""Queries over tracks, multi-view support, parts and wholes, neighbours, and reports built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scantable.common import cut, running_totals, table
from scantable.functions import exprs as X
from scantable.operators import evaluate, geometry, greedy, ranking, sets, votes
from scantable.plans.evidence import IOU, PAIRS, box_pairs, seed_pairs
from scantable.plans.registry import query
from scantable.plans.scalars import QUALITY, quality
from scantable.plans.structure import JUDGED, RANKED, _judged, _seed_scores
from scantable.plans.views import cand, links, obs, pts, vec, with_views


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Observations of traces with what is known of them."""
    o = obs(spark, d).select("observation_id", "frame_index", "class_id", "score", "sam_score", "point_count")
    return links(spark, d).join(o, "observation_id")


MEMBERS = ", m AS (SELECT l.scene_name, l.trace_id, l.observation_id, o.frame_index, o.class_id, o.score, o.sam_score, o.point_count FROM links l JOIN obs o USING (observation_id))"


# ---- scores


@query(with_views("links obs", MEMBERS + """, v AS (SELECT trace_id, count(DISTINCT frame_index) AS views FROM m GROUP BY 1) SELECT m.trace_id, m.observation_id, 0.35 * coalesce(score, 0) + 0.25 * coalesce(sam_score, 0) + 0.20 * least(1, views / 4.0) + 0.10 * least(1, coalesce(point_count, 0) / 500.0)
    + 0.10 * CASE WHEN class_id IS NULL THEN 0 ELSE 1 END AS quality FROM m JOIN v USING (trace_id)"""))
def f11_graph_quality(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sum of an observation's scores, the views of its trace, its points and whether it has a class."""
    m = _members(spark, d)
    views = m.groupBy("trace_id").agg(F.count_distinct("frame_index").alias("views"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = 0.35 * zero("score") + 0.25 * zero("sam_score") + 0.20 * F.least(F.lit(1.0), F.col("views") / 4.0) + 0.10 * F.least(F.lit(1.0), zero("point_count") / 500.0) + 0.10 * F.col("class_id").isNotNull().cast("int")
    return m.join(views, "trace_id").select("trace_id", "observation_id", total.alias("quality"))


@query(with_views("cand", """, q AS (SELECT record_id, covered, kind, (0.30 * best_iou + 0.25 * mean_iou + 0.15 * least(1, views / 4.0) + 0.15 * (1 - covered) + 0.15) * CASE WHEN existing_iou >= 0.25 THEN 0.65 ELSE 1 END * CASE WHEN kind = 'maskgraphsingleview' THEN 0.85 ELSE 1 END AS q FROM cand)
    SELECT record_id, CASE WHEN starts_with(coalesce(kind, ''), 'maskgraph') THEN least(1.6, greatest(0.75, 0.9 + 0.7 * q + 0.1 * (1 - covered))) ELSE 1.0 END AS factor FROM q"""))
def f12_competition_factor(spark: SparkSession, d: str) -> DataFrame:
    """Factor of graph candidates between 0.75 and 1.6; 1 for other sources."""
    c = F.col
    q = 0.30 * c("best_iou") + 0.25 * c("mean_iou") + 0.15 * F.least(F.lit(1.0), c("views") / 4.0) + 0.15 * (1 - c("covered")) + 0.15
    q = q * F.when(c("existing_iou") >= 0.25, 0.65).otherwise(1.0) * F.when(c("kind") == "maskgraphsingleview", 0.85).otherwise(1.0)
    factor = X.clamp(0.9 + 0.7 * q + 0.1 * (1 - c("covered")), 0.75, 1.6)
    return cand(spark, d).select("record_id", F.when(F.coalesce("kind", F.lit("")).startswith("maskgraph"), factor).otherwise(1.0).alias("factor"))


@query(with_views("cand", """SELECT record_id, least(1, greatest(0, 0.35 * best_iou + 0.20 * least(1, greatest(0, mean_iou)) + 0.15 * least(1, greatest(0, score)) + 0.15 * least(1, ln(1 + greatest(0, coalesce(num_seed_points, 0))) / ln(641))
    + 0.10 * (1 - least(1, greatest(0, covered))) + 0.05 * (1 - least(1, greatest(0, area_ratio) / 0.30)))) AS quality FROM cand"""))
def f13_view_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of a view from geometry, scores, points and box."""
    c = F.col
    one = lambda x: X.clamp(x, 0.0, 1.0)
    points = F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0), F.coalesce("num_seed_points", F.lit(0))).cast("double")) / F.log(F.lit(641.0)))
    total = 0.35 * c("best_iou") + 0.20 * one(c("mean_iou")) + 0.15 * one(c("score")) + 0.15 * points + 0.10 * (1 - one(c("covered"))) + 0.05 * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("area_ratio")) / 0.30))
    return cand(spark, d).select("record_id", one(total).alias("quality"))


@query(with_views("vec", "SELECT vec_id, x / greatest(sqrt(x * x + y * y + z * z), 1e-6) AS nx, y / greatest(sqrt(x * x + y * y + z * z), 1e-6) AS ny, z / greatest(sqrt(x * x + y * y + z * z), 1e-6) AS nz, CASE WHEN (SELECT max(x) FROM vec) > 1 THEN x / 255 ELSE x END AS red FROM vec"))
def f29_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of length 1, and colours brought to 0-1 if any is above 1."""
    v = vec(spark, d)
    top = v.agg(F.max("x").alias("top"))
    size = F.greatest(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), F.lit(1e-6))
    return v.crossJoin(F.broadcast(top)).select("vec_id", *[(F.col(a) / size).alias(f"n{a}") for a in "xyz"], F.when(F.col("top") > 1, F.col("x") / 255).otherwise(F.col("x")).alias("red"))


@query(with_views("cand", "SELECT record_id, greatest(0, least(1, coalesce(fusion, score) * CASE WHEN views < 2 THEN 0.85 ELSE 1 END * (0.5 + 0.5 * least(1, greatest(0, mean_iou))))) AS proposal_score FROM cand"))
def f35_proposal_score(spark: SparkSession, d: str) -> DataFrame:
    """Final score: base score times factors, between 0 and 1."""
    score = F.coalesce("fusion", "score") * F.when(F.col("views") < 2, 0.85).otherwise(1.0) * (0.5 + 0.5 * X.clamp(F.col("mean_iou"), 0.0, 1.0))
    return cand(spark, d).select("record_id", X.clamp(score, 0.0, 1.0).alias("proposal_score"))


# ---- support over views


@query(with_views("links obs", MEMBERS + f""", b AS (SELECT a.observation_id, {IOU} AS iou FROM obs a JOIN obs b ON a.scene_name = b.scene_name AND a.frame_index = b.frame_index AND a.observation_id <> b.observation_id), t AS (SELECT observation_id, max(iou) AS iou FROM b GROUP BY 1)
    SELECT m.trace_id, coalesce(avg(t.iou) FILTER (WHERE t.iou > 0), 0) AS mean_iou, count(t.iou) FILTER (WHERE t.iou > 0) AS views FROM m LEFT JOIN t USING (observation_id) GROUP BY 1"""))
def a3_mean_best_iou(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the best box IoU over the views of a trace that have one."""
    p = box_pairs(spark, d, overlapping=True)
    each = p.select(F.col("a_observation_id").alias("observation_id"), "iou").union(p.select("b_observation_id", "iou"))
    best = each.groupBy("observation_id").agg(F.max("iou").alias("iou"))
    rows = links(spark, d).select("trace_id", "observation_id").join(obs(spark, d).select("observation_id"), "observation_id").join(best, "observation_id", "left")
    good = F.when(F.col("iou") > 0, F.col("iou"))
    return rows.groupBy("trace_id").agg(F.coalesce(F.avg(good), F.lit(0.0)).alias("mean_iou"), F.count(good).alias("views"))


@query(with_views("links obs", MEMBERS + """, c AS (SELECT trace_id, class_id, count(*) AS n FROM m WHERE class_id IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER w::DOUBLE AS p, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, class_id) AS r FROM c WINDOW w AS (PARTITION BY trace_id))
    SELECT trace_id, sum(n) AS label_vote_count, count(*) AS num_label_candidates, CASE WHEN count(*) > 1 THEN -sum(p * ln(p + 1e-12)) / ln(count(*)) ELSE 0 END AS label_entropy, max(p) FILTER (WHERE r = 1) AS top_label_ratio, coalesce(max(p) FILTER (WHERE r = 2), 0) AS second_label_ratio FROM p GROUP BY 1"""))
def a6_label_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Votes, entropy and the two largest shares of labels of a trace."""
    counts = _members(spark, d).where("class_id is not null").groupBy("trace_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("trace_id")
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "class_id")))
    k = F.count(F.lit(1))
    entropy = F.when(k > 1, F.sum(-F.col("p") * F.log(F.col("p") + 1e-12)) / F.log(k.cast("double"))).otherwise(0.0)
    return p.groupBy("trace_id").agg(F.sum("n").alias("label_vote_count"), k.alias("num_label_candidates"), entropy.alias("label_entropy"), F.max(F.when(F.col("r") == 1, F.col("p"))).alias("top_label_ratio"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("p"))), F.lit(0.0)).alias("second_label_ratio"))


@query(with_views("pts", """, g AS (SELECT scene_name, candidate_id, CAST(floor(item / 100) AS BIGINT) AS seg, count(*) AS hits FROM pts GROUP BY 1, 2, 3), s AS (SELECT scene_name, CAST(floor(item / 100) AS BIGINT) AS seg, count(DISTINCT item) AS size FROM pts GROUP BY 1, 2)
    SELECT scene_name, candidate_id, coalesce(sum(hits) FILTER (WHERE hits / size::DOUBLE < 0.3), 0) / sum(hits)::DOUBLE AS low_mass, greatest(0.5, 1 - 0.5 * coalesce(sum(hits) FILTER (WHERE hits / size::DOUBLE < 0.3), 0) / sum(hits)::DOUBLE) AS factor FROM g JOIN s USING (scene_name, seg) GROUP BY 1, 2"""))
def a17_low_occupancy(spark: SparkSession, d: str) -> DataFrame:
    """Share of a seed in blocks it hardly covers, and the factor that follows."""
    p = pts(spark, d).withColumn("seg", F.floor(F.col("item") / 100))
    sizes = p.groupBy("scene_name", "seg").agg(F.count_distinct("item").alias("size"))
    cover = sets.segment_coverage(p, sizes, ["scene_name", "candidate_id"], "seg")
    low = F.sum(F.when(F.col("band") == "weak", F.col("hits")).otherwise(0)) / F.sum("hits")
    return cover.groupBy("scene_name", "candidate_id").agg(low.alias("low_mass")).withColumn("factor", F.greatest(F.lit(0.5), 1 - 0.5 * F.col("low_mass")))


@query(with_views("links obs", MEMBERS + """, f AS (SELECT trace_id, class_id, frame_index, count(*) AS hits, avg(coalesce(score, 0)) AS cover FROM m WHERE class_id IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1, 2, 3), v AS (SELECT trace_id, count(DISTINCT frame_index) AS visible FROM f GROUP BY 1)
    SELECT trace_id, class_id, count(*) FILTER (WHERE cover >= 0.5) AS support, visible, sum(cover) AS coverage FROM f JOIN v USING (trace_id) GROUP BY 1, 2, visible HAVING count(*) FILTER (WHERE cover >= 0.5) >= 1 AND count(*) FILTER (WHERE cover >= 0.5) / visible::DOUBLE >= 0.3"""))
def a20_frame_support(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a trace by frames that support them, over those that see it."""
    f = _members(spark, d).where("class_id is not null and frame_index is not null").groupBy("trace_id", "class_id", "frame_index").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("cover"))
    f = cut(f)
    v = f.groupBy("trace_id").agg(F.count_distinct("frame_index").alias("visible"))
    out = f.join(v, "trace_id").groupBy("trace_id", "class_id", "visible").agg(F.count_if(F.col("cover") >= 0.5).alias("support"), F.sum("cover").alias("coverage"))
    return out.where((F.col("support") >= 1) & (F.col("support") / F.col("visible") >= 0.3)).select("trace_id", "class_id", "support", "visible", "coverage")


@query(with_views("links obs", MEMBERS + """, e AS (SELECT scene_name, class_id, count(DISTINCT frame_index) FILTER (WHERE score >= 0.7) AS core, count(DISTINCT frame_index) FILTER (WHERE score >= 0.4 AND score < 0.7) AS part, count(DISTINCT frame_index) FILTER (WHERE score < 0.4) AS weak FROM m WHERE class_id IS NOT NULL GROUP BY 1, 2)
    SELECT *, CASE WHEN core >= 2 AND weak = 0 THEN 'core' WHEN core >= 1 AND weak > core THEN 'conflict' WHEN core + part >= 1 THEN 'boundary' ELSE 'unresolved' END AS role FROM e"""))
def a22_frame_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Frames of core, partial and weak evidence per scene and class, and the role that follows."""
    s = F.col("score")
    n = lambda cond: F.count_distinct(F.when(cond, F.col("frame_index")))
    e = _members(spark, d).where("class_id is not null").groupBy("scene_name", "class_id").agg(n(s >= 0.7).alias("core"), n((s >= 0.4) & (s < 0.7)).alias("part"), n(s < 0.4).alias("weak"))
    c = F.col
    rules = [("core", (c("core") >= 2) & (c("weak") == 0)), ("conflict", (c("core") >= 1) & (c("weak") > c("core"))), ("boundary", c("core") + c("part") >= 1)]
    return e.withColumn("role", X.first_reason(rules, "unresolved"))


@query(with_views("links obs", MEMBERS + """, v AS (SELECT DISTINCT trace_id, frame_index, class_id FROM m WHERE class_id IS NOT NULL AND frame_index IS NOT NULL), z AS (SELECT trace_id, frame_index, count(*) AS n FROM v GROUP BY 1, 2), q AS (SELECT a.trace_id, a.frame_index AS f, b.frame_index AS g, a.n AS na, b.n AS nb FROM z a JOIN z b ON a.trace_id = b.trace_id AND a.frame_index < b.frame_index),
    c AS (SELECT a.trace_id, a.frame_index AS f, b.frame_index AS g, count(*) AS k FROM v a JOIN v b ON a.trace_id = b.trace_id AND a.frame_index < b.frame_index AND a.class_id = b.class_id GROUP BY 1, 2, 3), s AS (SELECT trace_id, coalesce(k, 0) / (na + nb - coalesce(k, 0))::DOUBLE AS j FROM q LEFT JOIN c USING (trace_id, f, g))
    SELECT trace_id, count(*) AS pairs, avg(j) AS mean_siou, min(j) AS min_siou, max(j) AS max_siou FROM s GROUP BY 1"""))
def a26_view_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Set overlap of all pairs of views of a trace."""
    v = cut(_members(spark, d).where("class_id is not null and frame_index is not null").select("trace_id", "frame_index", "class_id").distinct())
    z = v.groupBy("trace_id", "frame_index").agg(F.count(F.lit(1)).alias("n"))
    q = z.toDF("trace_id", "f", "na").join(z.toDF("trace_id", "g", "nb"), "trace_id").where("f < g")
    c = v.toDF("trace_id", "f", "class_id").join(v.toDF("trace_id", "g", "class_id"), ["trace_id", "class_id"]).where("f < g").groupBy("trace_id", "f", "g").agg(F.count(F.lit(1)).alias("k"))
    k = F.coalesce("k", F.lit(0))
    s = q.join(c, ["trace_id", "f", "g"], "left").select("trace_id", (k / (F.col("na") + F.col("nb") - k)).alias("j"))
    return s.groupBy("trace_id").agg(F.count(F.lit(1)).alias("pairs"), F.avg("j").alias("mean_siou"), F.min("j").alias("min_siou"), F.max("j").alias("max_siou"))


@query(with_views("cand", """, t AS (SELECT scene_name, candidate_id, arg_min(class_id, record_id) AS b, arg_max(class_id, record_id) AS a, arg_max(class_id, (score, record_id)) AS t, max(views) AS v, count(*) AS n FROM cand WHERE class_id IS NOT NULL GROUP BY 1, 2), f AS (SELECT * FROM t WHERE v >= 3 AND n > 1)
    SELECT count(*) AS fired, count(*) FILTER (WHERE a = t AND b <> t) AS helpful, count(*) FILTER (WHERE b = t AND a <> t) AS harmful, count(*) - count(*) FILTER (WHERE a = t AND b <> t) - count(*) FILTER (WHERE b = t AND a <> t) AS neutral, count(*) FILTER (WHERE a = t AND b <> t) - count(*) FILTER (WHERE b = t AND a <> t) AS net FROM f"""))
def a33_rule_effect(spark: SparkSession, d: str) -> DataFrame:
    """Effect of taking the last class instead of the first, against that of the best score."""
    rows = cand(spark, d).where("class_id is not null").groupBy("scene_name", "candidate_id").agg(F.min_by("class_id", "record_id").alias("b"), F.max_by("class_id", "record_id").alias("a"), F.max_by("class_id", F.struct("score", "record_id")).alias("t"), F.max("views").alias("v"), F.count(F.lit(1)).alias("n"))
    return votes.rule_effect(rows.withColumn("fires", (F.col("v") >= 3) & (F.col("n") > 1)), "fires", "b", "a", "t")


@query(with_views("vec", "SELECT label, avg(x) AS mean_x, avg(x * x) AS mean_square_x, stddev_pop(x) AS dev_x FROM vec GROUP BY 1"))
def a35_colour_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Mean, mean of squares and deviation."""
    return vec(spark, d).groupBy("label").agg(F.avg("x").alias("mean_x"), F.avg(F.col("x") * F.col("x")).alias("mean_square_x"), F.stddev_pop("x").alias("dev_x"))


@query(with_views("pts", ", g AS (SELECT scene_name, CAST(floor(item / 100) AS BIGINT) AS seg, candidate_id, count(*) AS k FROM pts GROUP BY 1, 2, 3), s AS (SELECT scene_name, CAST(floor(item / 100) AS BIGINT) AS seg, count(DISTINCT item) AS n FROM pts GROUP BY 1, 2), h AS (SELECT scene_name, candidate_id, seg FROM g JOIN s USING (scene_name, seg) WHERE k / n::DOUBLE > 0.5) SELECT h.scene_name, h.candidate_id, count(DISTINCT p.item) AS points FROM h JOIN pts p ON p.scene_name = h.scene_name AND CAST(floor(p.item / 100) AS BIGINT) = h.seg GROUP BY 1, 2"))
def a36_segment_mask(spark: SparkSession, d: str) -> DataFrame:
    """Seeds as the blocks they hold by more than half, back to points."""
    p = pts(spark, d).withColumn("seg", F.floor(F.col("item") / 100))
    sizes = p.groupBy("scene_name", "seg").agg(F.count_distinct("item").alias("size"))
    held = sets.segment_coverage(p, sizes, ["scene_name", "candidate_id"], "seg").where("coverage > 0.5")
    return held.groupBy("scene_name", "candidate_id").agg(F.sum("size").alias("points"))


@query(with_views("links obs", MEMBERS + ", v AS (SELECT trace_id, class_id, count(*) AS c FROM m WHERE class_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT trace_id, max(c) AS c FROM v GROUP BY 1), a AS (SELECT trace_id, count(*) AS n, avg(coalesce(score, 0)) AS s FROM m GROUP BY 1) SELECT trace_id, round(coalesce(c, 0) / n::DOUBLE * s, 9) AS confidence FROM a LEFT JOIN t USING (trace_id)"))
def a37_mask_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Share of the winning class times the mean score inside."""
    m = _members(spark, d).withColumn("class_id", F.coalesce("class_id", F.lit(-1)))
    vote = votes.class_vote(m, ["trace_id"], "class_id", -1)
    return vote.join(m.groupBy("trace_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("s")), "trace_id").select("trace_id", F.round(F.col("share") * F.col("s"), 9).alias("confidence"))


@query(with_views("pts", """, c AS (SELECT a.scene_name, a.candidate_id, count(DISTINCT a.item) AS k FROM pts a JOIN pts b ON a.scene_name = b.scene_name AND a.item = b.item AND a.candidate_id <> b.candidate_id GROUP BY 1, 2), z AS (SELECT scene_name, candidate_id, count(*) AS n FROM pts GROUP BY 1, 2)
    SELECT scene_name, candidate_id, n - coalesce(k, 0) AS uncovered, (n - coalesce(k, 0)) / n::DOUBLE AS uncovered_ratio, CASE WHEN (n - coalesce(k, 0)) >= 20 AND (n - coalesce(k, 0)) / n::DOUBLE >= 0.5 THEN 'new_candidate' ELSE 'existing_support' END AS action FROM z LEFT JOIN c USING (scene_name, candidate_id)"""))
def a41_gap_test(spark: SparkSession, d: str) -> DataFrame:
    """Points of a seed that no other one has, and what they make of it."""
    p = pts(spark, d)
    alone = p.groupBy("scene_name", "item").agg(F.count(F.lit(1)).alias("k"), F.min("candidate_id").alias("candidate_id")).where("k = 1").groupBy("scene_name", "candidate_id").agg(F.count(F.lit(1)).alias("u"))
    out = p.groupBy("scene_name", "candidate_id").agg(F.count(F.lit(1)).alias("n")).join(alone, ["scene_name", "candidate_id"], "left")
    u = F.coalesce("u", F.lit(0))
    return out.select("scene_name", "candidate_id", u.alias("uncovered"), (u / F.col("n")).alias("uncovered_ratio"), F.when((u >= 20) & (u / F.col("n") >= 0.5), "new_candidate").otherwise("existing_support").alias("action"))


@query(with_views("cand pts", PAIRS + f""", q AS (SELECT scene_name, candidate_id, max({QUALITY}) AS q, max(CAST(starts_with(coalesce(kind, ''), 'maskgraph') AS INT)) AS g FROM cand GROUP BY 1, 2), u AS (SELECT scene_name, a AS id, b AS other, iou, containment FROM pairs UNION ALL SELECT scene_name, b, a, iou, containment FROM pairs)
    SELECT u.scene_name, id, max(greatest(containment, iou / 0.3) * q.q) AS evidence, arg_max(other, (greatest(containment, iou / 0.3) * q.q, -other)) AS best FROM u JOIN q ON q.scene_name = u.scene_name AND q.candidate_id = other WHERE g = 1 AND (containment >= 0.5 OR iou >= 0.3) GROUP BY 1, 2"""))
def a42_cross_source(spark: SparkSession, d: str) -> DataFrame:
    """Strongest support of a seed by graph candidates."""
    q = cand(spark, d).groupBy("scene_name", F.col("candidate_id").alias("other")).agg(F.max(quality()).alias("q"), F.max(F.coalesce("kind", F.lit("")).startswith("maskgraph")).alias("g")).where("g")
    p = seed_pairs(spark, d).where("containment >= 0.5 or iou >= 0.3").select("scene_name", "a", "b", "iou", "containment")
    u = p.toDF("scene_name", "id", "other", "iou", "containment").union(p.select("scene_name", "b", "a", "iou", "containment")).join(q, ["scene_name", "other"])
    value = F.greatest("containment", F.col("iou") / 0.3) * F.col("q")
    return u.groupBy("scene_name", "id").agg(F.max(value).alias("evidence"), F.max_by("other", F.struct(value, -F.col("other"))).alias("best"))


@query(with_views("links obs", MEMBERS + """, c AS (SELECT trace_id, class_id, count(*) AS n FROM m WHERE class_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT trace_id, arg_max(class_id, (n, -class_id)) AS k FROM c GROUP BY 1), f AS (SELECT trace_id, frame_index, max(score) AS s FROM m JOIN t USING (trace_id) WHERE class_id = k AND frame_index IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2)
    SELECT trace_id, count(*) AS views, avg(s) FILTER (WHERE s >= 0.5) AS mean_support, max(s) AS best_support FROM f GROUP BY 1"""))
def a44_multi_view_support(spark: SparkSession, d: str) -> DataFrame:
    """Best observation of the trace's class per frame; mean over supporting frames, best over all."""
    m = cut(_members(spark, d))
    k = votes.class_vote(m.where("class_id is not null"), ["trace_id"], "class_id", -1).select("trace_id", F.col("class_id").alias("k"))
    f = m.join(k, "trace_id").where("class_id = k and frame_index is not null and score is not null").groupBy("trace_id", "frame_index").agg(F.max("score").alias("s"))
    return f.groupBy("trace_id").agg(F.count(F.lit(1)).alias("views"), F.avg(F.when(F.col("s") >= 0.5, F.col("s"))).alias("mean_support"), F.max("s").alias("best_support"))


# ---- ranks over views


@query(with_views("links obs", MEMBERS + ", t AS (SELECT trace_id, count(*) AS n FROM m GROUP BY 1), f AS (SELECT trace_id, frame_index, count(*) AS k FROM m WHERE frame_index IS NOT NULL GROUP BY 1, 2) SELECT trace_id, frame_index, fraction, place FROM (SELECT trace_id, frame_index, k / n::DOUBLE AS fraction, row_number() OVER (PARTITION BY trace_id ORDER BY k DESC, frame_index) AS place FROM f JOIN t USING (trace_id)) WHERE place <= 2"))
def o1_top_frames(spark: SparkSession, d: str) -> DataFrame:
    """Two frames of a trace that see most of it."""
    m = _members(spark, d)
    f = m.where("frame_index is not null").groupBy("trace_id", "frame_index").agg(F.count(F.lit(1)).alias("k")).join(m.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")), "trace_id")
    return ranking.top_k(f, ["trace_id"], [F.desc("k"), F.col("frame_index")], 2).select("trace_id", "frame_index", (F.col("k") / F.col("n")).alias("fraction"), "place")


@query(with_views("links obs", MEMBERS + ", v AS (SELECT scene_name, trace_id, class_id, count(*) AS c FROM m WHERE class_id IS NOT NULL GROUP BY 1, 2, 3), w AS (SELECT *, c / max(c) OVER (PARTITION BY trace_id)::DOUBLE AS weight FROM v) SELECT scene_name, trace_id, class_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY scene_name ORDER BY weight DESC, trace_id, class_id) AS r FROM w) WHERE r <= 25"))
def o2_instance_class_top(spark: SparkSession, d: str) -> DataFrame:
    """The 25 strongest pairs of trace and class of a scene; a trace may come under several classes."""
    dist = votes.label_distribution(_members(spark, d).where("class_id is not null"), ["scene_name", "trace_id"], "class_id")
    return ranking.top_k(dist, ["scene_name"], [F.desc("weight"), F.col("trace_id"), F.col("class_id")], 25).select("scene_name", "trace_id", "class_id", "weight")


@query(with_views("cand", "SELECT record_id, 'strong_but_covered' AS list FROM cand WHERE score >= 0.9 AND covered >= 0.8 UNION ALL SELECT record_id, 'many_views_low_score' FROM cand WHERE views >= 8 AND score < 0.3 UNION ALL SELECT record_id, 'no_class' FROM cand WHERE class_name IS NULL"))
def o11_named_lists(spark: SparkSession, d: str) -> DataFrame:
    """Named review lists; one pass, a record may be in several."""
    c = F.col
    lists = F.array(F.when((c("score") >= 0.9) & (c("covered") >= 0.8), "strong_but_covered"), F.when((c("views") >= 8) & (c("score") < 0.3), "many_views_low_score"), F.when(c("class_name").isNull(), "no_class"))
    return cand(spark, d).select("record_id", F.explode(F.array_compact(lists)).alias("list"))


@query(with_views("links obs", MEMBERS + ", f AS (SELECT trace_id, frame_index, count(*) AS k FROM m WHERE frame_index IS NOT NULL GROUP BY 1, 2), s AS (SELECT a.trace_id, a.frame_index, sum(b.k / (1 + abs(a.frame_index - b.frame_index) / 10.0)) AS weight FROM f a JOIN f b ON a.trace_id = b.trace_id GROUP BY 1, 2) SELECT trace_id, arg_max(frame_index, (round(weight, 9), -frame_index)) AS pivot FROM s GROUP BY 1"))
def o14_pivot_frame(spark: SparkSession, d: str) -> DataFrame:
    """Frame of a trace that is nearest to what is seen of it."""
    f = cut(_members(spark, d).where("frame_index is not null").groupBy("trace_id", "frame_index").agg(F.count(F.lit(1)).alias("k")))
    near = f.select("trace_id", "frame_index").join(f.toDF("trace_id", "g", "k"), "trace_id")
    s = near.groupBy("trace_id", "frame_index").agg(F.round(F.sum(F.col("k") / (1 + F.abs(F.col("frame_index") - F.col("g")) / 10.0)), 9).alias("w"))
    return s.groupBy("trace_id").agg(F.max_by("frame_index", F.struct("w", -F.col("frame_index"))).alias("pivot"))


# ---- parts, wholes and relations


@query(with_views("pts", PAIRS + """, i AS (SELECT scene_name, CASE WHEN size_a > size_b THEN a ELSE b END AS parent, CASE WHEN size_a > size_b THEN b ELSE a END AS child FROM pairs WHERE containment >= 0.7 AND size_a <> size_b), k AS (SELECT scene_name, parent, count(*) AS children FROM i GROUP BY 1, 2 HAVING count(*) >= 2),
    c AS (SELECT i.scene_name, i.parent, count(DISTINCT p.item) AS covered FROM i JOIN pts p ON p.scene_name = i.scene_name AND p.candidate_id = i.child JOIN pts q ON q.scene_name = i.scene_name AND q.candidate_id = i.parent AND q.item = p.item GROUP BY 1, 2)
    SELECT scene_name, parent, children, covered / n::DOUBLE AS coverage, covered / n::DOUBLE >= 0.8 AS replaced FROM k JOIN c USING (scene_name, parent) JOIN z ON z.scene_name = k.scene_name AND z.candidate_id = parent"""))
def n11_parts_for_whole(spark: SparkSession, d: str) -> DataFrame:
    """Seeds with two or more others inside, and how much of them these cover together."""
    big = F.col("size_a") > F.col("size_b")
    inside = cut(seed_pairs(spark, d).where("containment >= 0.7 and size_a <> size_b").select("scene_name", F.when(big, F.col("a")).otherwise(F.col("b")).alias("parent"), F.when(big, F.col("b")).otherwise(F.col("a")).alias("child")))
    several = inside.groupBy("scene_name", "parent").agg(F.count(F.lit(1)).alias("children")).where("children >= 2")
    p = pts(spark, d)
    part = inside.join(several.select("scene_name", "parent"), ["scene_name", "parent"], "left_semi").join(p.withColumnRenamed("candidate_id", "child"), ["scene_name", "child"]).select("scene_name", "parent", "item").distinct()
    covered = part.join(p.withColumnRenamed("candidate_id", "parent"), ["scene_name", "parent", "item"], "left_semi").groupBy("scene_name", "parent").agg(F.count(F.lit(1)).alias("covered"))
    size = p.groupBy("scene_name", F.col("candidate_id").alias("parent")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("covered") / F.col("n")
    return several.join(covered, ["scene_name", "parent"]).join(size, ["scene_name", "parent"]).select("scene_name", "parent", "children", share.alias("coverage"), (share >= 0.8).alias("replaced"))


@query()
def n14_capped_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Suppression within classes in order of score, then ten seeds a class and scene, fifty a scene."""
    s = cut(_seed_scores(spark, d).where("class_id is not null"))
    side = lambda c: s.select("scene_name", "class_id", F.col("candidate_id").alias(c), F.struct(-F.col("score"), F.col("candidate_id")).alias(f"r{c}"))
    pairs = sets.similar_pairs(pts(spark, d), ["scene_name"], "candidate_id", 0.5).select("scene_name", "a", "b").join(side("a"), ["scene_name", "a"]).join(side("b"), ["scene_name", "class_id", "b"])
    conflicts = greedy.directed(pairs, ["scene_name"], "a", "b", F.col("ra"), F.col("rb"))
    left = greedy.suppress(s.withColumnRenamed("candidate_id", "worse"), ["scene_name"], conflicts, "better", "worse")
    order = [F.desc("score"), F.col("worse")]
    left = ranking.top_k(left, ["scene_name", "class_id"], order, 10).drop("place")
    return ranking.top_k(left, ["scene_name"], order, 50).select("scene_name", F.col("worse").alias("candidate_id"), "class_id")


@query(with_views("pts", PAIRS + """, u AS (SELECT scene_name, a AS id, iou, inter / size_a::DOUBLE AS mine, inter / size_b::DOUBLE AS theirs FROM pairs UNION ALL SELECT scene_name, b, iou, inter / size_b::DOUBLE, inter / size_a::DOUBLE FROM pairs),
    r AS (SELECT scene_name, id, count(*) FILTER (WHERE mine >= 0.8 AND theirs < 0.8) AS parents, count(*) FILTER (WHERE theirs >= 0.8 AND mine < 0.8) AS children, count(*) FILTER (WHERE iou >= 0.2 AND mine < 0.8 AND theirs < 0.8) AS conflicts FROM u GROUP BY 1, 2)
    SELECT z.scene_name, z.candidate_id AS id, coalesce(parents, 0) AS parents, coalesce(children, 0) AS children, coalesce(conflicts, 0) AS conflicts, CASE WHEN coalesce(children, 0) >= 2 THEN 'container' WHEN coalesce(parents, 0) >= 1 THEN 'part' WHEN coalesce(conflicts, 0) >= 1 THEN 'ambiguous' ELSE 'leaf' END AS role FROM z LEFT JOIN r ON r.scene_name = z.scene_name AND r.id = z.candidate_id"""))
def g12_evidence_tree(spark: SparkSession, d: str) -> DataFrame:
    """Parents, children and conflicts of every seed, and its role."""
    q = cut(seed_pairs(spark, d))
    u = q.select("scene_name", F.col("a").alias("id"), "iou", F.col("cover_a").alias("mine"), F.col("cover_b").alias("theirs")).union(q.select("scene_name", "b", "iou", "cover_b", "cover_a"))
    r = u.groupBy("scene_name", "id").agg(F.expr("count_if(mine >= 0.8 and theirs < 0.8)").alias("parents"), F.expr("count_if(theirs >= 0.8 and mine < 0.8)").alias("children"), F.expr("count_if(iou >= 0.2 and mine < 0.8 and theirs < 0.8)").alias("conflicts"))
    out = pts(spark, d).select("scene_name", F.col("candidate_id").alias("id")).distinct().join(r, ["scene_name", "id"], "left").fillna(0, ["parents", "children", "conflicts"])
    return out.withColumn("role", X.first_reason([("container", F.col("children") >= 2), ("part", F.col("parents") >= 1), ("ambiguous", F.col("conflicts") >= 1)], "leaf"))


@query(with_views("links obs", MEMBERS + """, p AS (SELECT DISTINCT a.observation_id AS a, b.observation_id AS b, a.frame_index AS fa, b.frame_index AS fb, a.class_id AS ca, b.class_id AS cb, abs(coalesce(a.score, 0) - coalesce(b.score, 0)) AS gap FROM m a JOIN m b ON a.trace_id = b.trace_id AND a.observation_id < b.observation_id)
    SELECT a, b, CASE WHEN fa = fb THEN CASE WHEN ca = cb THEN 'containment' ELSE 'mutex' END WHEN gap > 0.6 THEN 'conflict' WHEN ca IS DISTINCT FROM cb THEN 'uncertain' WHEN gap > 0.3 THEN 'weak' ELSE 'same_object' END AS relation FROM p"""))
def g7_pair_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relation of observations that share a trace, by an ordered cascade."""
    m = _members(spark, d).select("trace_id", "observation_id", "frame_index", "class_id", F.coalesce("score", F.lit(0.0)).alias("s"))
    p = m.toDF("t", "a", "fa", "ca", "sa").join(m.toDF("t", "b", "fb", "cb", "sb"), "t").where("a < b").drop("t").distinct()
    same, gap = F.col("fa") == F.col("fb"), F.abs(F.col("sa") - F.col("sb"))
    rules = [("containment", same & (F.col("ca") == F.col("cb"))), ("mutex", same), ("conflict", gap > 0.6), ("uncertain", ~F.col("ca").eqNullSafe(F.col("cb"))), ("weak", gap > 0.3)]
    return p.select("a", "b", X.first_reason(rules, "same_object").alias("relation"))


KNN = ", k AS (SELECT * FROM (SELECT p.label, p.vec_id AS a, q.vec_id AS b, (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 AS d2, row_number() OVER (PARTITION BY p.vec_id ORDER BY (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2, q.vec_id) AS place FROM vec p JOIN vec q ON p.label = q.label AND p.vec_id <> q.vec_id) WHERE place <= 3)"


def _knn(spark: SparkSession, d: str) -> DataFrame:
    v = vec(spark, d)
    return geometry.nearest(v.withColumnRenamed("vec_id", "a"), v.withColumnRenamed("vec_id", "b"), ["label"], ["x", "y", "z"], 3, 0.05)


@query(with_views("vec", KNN + " SELECT label, a, b, sqrt(d2) / (SELECT quantile_cont(sqrt(d2), 0.5) FROM k WHERE a < b) AS weight FROM k WHERE a < b"))
def g5_neighbour_weights(spark: SparkSession, d: str) -> DataFrame:
    """Edges to later neighbours, by distance over the median one."""
    k = cut(_knn(spark, d).where("a < b").withColumn("dist", F.sqrt("d2")))
    return k.crossJoin(F.broadcast(k.agg(F.percentile("dist", 0.5).alias("mid")))).select("label", "a", "b", (F.col("dist") / F.col("mid")).alias("weight"))


@query(with_views("vec", KNN + " SELECT k.label, k.a, sum(q.z / (sqrt(k.d2) + 1e-8)) / sum(1 / (sqrt(k.d2) + 1e-8)) AS z_interpolated FROM k JOIN vec q ON q.vec_id = k.b GROUP BY 1, 2"))
def v8_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """A value at each point from its three neighbours, weighted by inverse distance."""
    w = 1 / (F.sqrt("d2") + 1e-8)
    k = _knn(spark, d).join(vec(spark, d).select(F.col("vec_id").alias("b"), "z"), "b")
    return k.groupBy("label", "a").agg((F.sum(F.col("z") * w) / F.sum(w)).alias("z_interpolated"))


@query(with_views("vec", "SELECT p.label, p.vec_id AS a, min((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2) AS d2, p.x < 0 AS from_left FROM vec p JOIN vec q ON p.label = q.label AND (p.x < 0) <> (q.x < 0) GROUP BY 1, 2, 4"))
def j15_both_directions(spark: SparkSession, d: str) -> DataFrame:
    """Squared distance to the nearest point of the other side, both ways."""
    v = vec(spark, d)
    left, right = v.where("x < 0"), v.where("x >= 0")
    one = lambda a, b, flag: geometry.nearest(a.withColumnRenamed("vec_id", "a"), b.withColumnRenamed("vec_id", "b"), ["label"], ["x", "y", "z"], 1, 0.05).select("label", "a", "d2", F.lit(flag).alias("from_left"))
    return one(left, right, True).union(one(right, left, False))


def _other_side(spark: SparkSession, d: str, metric: str) -> DataFrame:
    v = vec(spark, d)
    left, right = v.where("x < 0"), v.where("x >= 0")
    one = lambda a, b: geometry.nearest(a.withColumnRenamed("vec_id", "a"), b.withColumnRenamed("vec_id", "b"), ["label"], ["x", "y", "z"], 1, 0.05, metric=metric).select("label", "a", F.col("d2").alias("distance"))
    return one(left, right).union(one(right, left))


@query(with_views("vec", "SELECT p.label, p.vec_id AS a, min(abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z)) AS distance FROM vec p JOIN vec q ON p.label = q.label AND (p.x < 0) <> (q.x < 0) GROUP BY 1, 2"))
def j15_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Sum of amounts to the nearest point of the other side, both ways."""
    return _other_side(spark, d, "l1")


@query(with_views("vec", ", h AS (SELECT p.label, p.vec_id AS a, list_sum(list_transform([p.x - q.x, p.y - q.y, p.z - q.z], lambda t: CASE WHEN abs(t) <= 1 THEN t * t / 2 ELSE abs(t) - 0.5 END)) AS distance FROM vec p JOIN vec q ON p.label = q.label AND (p.x < 0) <> (q.x < 0)) SELECT label, a, min(distance) AS distance FROM h GROUP BY 1, 2"))
def j15_huber(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed sum of amounts to the nearest point of the other side, both ways."""
    return _other_side(spark, d, "huber")


@query(with_views("obs", """SELECT o.observation_id, arg_min(b.class_id, ((b.x2 - b.x1) + (b.y2 - b.y1), b.observation_id)) AS label FROM obs o JOIN obs b ON o.scene_name = b.scene_name AND o.frame_index = b.frame_index AND b.class_id IS NOT NULL
    AND (o.x1 + o.x2) / 2 >= b.x1 AND (o.x1 + o.x2) / 2 < b.x2 AND (o.y1 + o.y2) / 2 >= b.y1 AND (o.y1 + o.y2) / 2 < b.y2 GROUP BY 1"""))
def geo_label_map(spark: SparkSession, d: str) -> DataFrame:
    """Label at each centre: that of the smallest box over it, without painting an image."""
    o = obs(spark, d)
    p = o.select("scene_name", "frame_index", "observation_id", ((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py"))
    b = o.where("class_id is not null").select("scene_name", "frame_index", F.col("observation_id").alias("box"), "class_id", "x1", "y1", "x2", "y2")
    over = p.join(b, ["scene_name", "frame_index"]).where("px >= x1 and px < x2 and py >= y1 and py < y2")
    return over.groupBy("observation_id").agg(F.min_by("class_id", F.struct((F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")), F.col("box"))).alias("label"))


@query(with_views("vec", "SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2, count(*) AS n FROM vec GROUP BY 1"))
def geo_segment_stats(spark: SparkSession, d: str) -> DataFrame:
    """Centre and box of each label's points."""
    return vec(spark, d).groupBy("label").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"], *[f(a).alias(f"{a}{i}") for a in "xyz" for i, f in ((1, F.min), (2, F.max))], F.count(F.lit(1)).alias("n"))


@query(with_views("vec", """, b AS (SELECT label, CAST(floor(z / 0.1) AS BIGINT) AS slab, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM vec GROUP BY 1, 2)
    SELECT p.slab, p.label AS a, q.label AS b, greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1)) / nullif((p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1)), 0) AS iou
    FROM b p JOIN b q ON p.slab = q.slab AND p.label < q.label"""))
def geo_box_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the labels' boxes within slabs."""
    b = vec(spark, d).groupBy("label", F.floor(F.col("z") / 0.1).alias("slab")).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    side = lambda s: b.select("slab", F.col("label").alias(s), F.struct("x1", "y1", "x2", "y2").alias(f"r{s}"))
    box = lambda s: tuple(F.col(f"r{s}.{c}") for c in ("x1", "y1", "x2", "y2"))
    return side("a").join(side("b"), "slab").where("a < b").select("slab", "a", "b", X.box_iou(box("a"), box("b")).alias("iou"))


@query(with_views("pts", ", r AS (SELECT scene_name, candidate_id, min(item) - 5 AS lo, max(item) + 5 AS hi, count(*) AS n FROM pts GROUP BY 1, 2), u AS (SELECT DISTINCT scene_name, item FROM pts), g AS (SELECT r.scene_name, r.candidate_id, r.n, count(*) AS grown FROM r JOIN u ON u.scene_name = r.scene_name AND u.item BETWEEN lo AND hi GROUP BY 1, 2, 3) SELECT scene_name, candidate_id, n, CASE WHEN grown / n::DOUBLE > 3 THEN n ELSE grown END AS grown, CASE WHEN grown / n::DOUBLE > 3 THEN 1.0 ELSE grown / n::DOUBLE END AS ratio FROM g"))
def geo_grown_range(spark: SparkSession, d: str) -> DataFrame:
    """Points in the padded range of a seed, unless that is more than three times the seed.

    The count in a range is a difference of two running counts, so no seed is joined to the points between its ends.
    """
    p = pts(spark, d)
    r = p.groupBy("scene_name", "candidate_id").agg((F.min("item") - 5).alias("lo"), (F.max("item") + 5).alias("hi"), F.count(F.lit(1)).alias("n"))
    marks = p.select("scene_name", "item").distinct().select("scene_name", F.col("item").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("candidate_id"))
    marks = marks.union(r.select("scene_name", "lo", F.lit(0), F.lit(0), "candidate_id")).union(r.select("scene_name", "hi", F.lit(2), F.lit(0), "candidate_id"))
    counts = running_totals(marks, ["scene_name"], [F.col("at"), F.col("kind")], {"c": ("sum", "one")}).where("candidate_id is not null").groupBy("scene_name", "candidate_id").agg((F.max("c") - F.min("c")).alias("g"))
    wide = F.col("g") / F.col("n") > 3
    return counts.join(r, ["scene_name", "candidate_id"]).select("scene_name", "candidate_id", "n", F.when(wide, F.col("n")).otherwise(F.col("g")).alias("grown"), F.when(wide, F.lit(1.0)).otherwise(F.col("g") / F.col("n")).alias("ratio"))


# ---- sets, ids, evaluation, reports


@query(with_views("cand pts", PAIRS + RANKED + " SELECT DISTINCT scene_name, item FROM pts WHERE (scene_name, item) NOT IN (SELECT (p.scene_name, p.item) FROM pts p JOIN s USING (scene_name, candidate_id) JOIN classes k USING (class_id) WHERE k.is_base)"))
def s3_uncovered(spark: SparkSession, d: str) -> DataFrame:
    """Points that no seed of a base class has."""
    base = _seed_scores(spark, d).join(F.broadcast(table(spark, d, "classes").where("is_base").select("class_id")), "class_id", "left_semi").select("scene_name", "candidate_id")
    p = pts(spark, d)
    covered = p.join(base, ["scene_name", "candidate_id"], "left_semi").select("scene_name", "item")
    return p.select("scene_name", "item").distinct().join(covered, ["scene_name", "item"], "left_anti")


@query("SELECT source, count(*) AS n FROM (SELECT 'candidates' AS source, scene_name, candidate_id AS id FROM backprojection_candidates UNION ALL SELECT 'seeds', scene_name, candidate_id FROM seed_points UNION ALL SELECT 'traces', scene_name, trace_id FROM mask_graph_trace) GROUP BY 1")
def s6_concatenation(spark: SparkSession, d: str) -> DataFrame:
    """Three lists as one."""
    part = lambda name, t, i: table(spark, d, t).select(F.lit(name).alias("source"), "scene_name", F.col(i).alias("id"))
    return part("candidates", "backprojection_candidates", "candidate_id").union(part("seeds", "seed_points", "candidate_id")).union(part("traces", "mask_graph_trace", "trace_id")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT scene_name, class_id, dense_rank() OVER (PARTITION BY scene_name ORDER BY class_id) - 1 AS code, first_id FROM (SELECT scene_name, class_id, min(observation_id) AS first_id FROM observations WHERE class_id IS NOT NULL GROUP BY 1, 2)")
def v2_dense_codes(spark: SparkSession, d: str) -> DataFrame:
    """Dense codes of the classes of a scene with their first observation."""
    first = table(spark, d, "observations").where("class_id is not null").groupBy("scene_name", "class_id").agg(F.min("observation_id").alias("first_id"))
    return first.select("scene_name", "class_id", (F.dense_rank().over(Window.partitionBy("scene_name").orderBy("class_id")) - 1).alias("code"), "first_id")


@query("SELECT candidate_id, md5(concat(scene_name, '/', CAST(candidate_id AS VARCHAR))) AS name, count(*) AS n FROM seed_points GROUP BY 1, 2")
def v11_instance_names(spark: SparkSession, d: str) -> DataFrame:
    """Instances under hashed names."""
    name = F.md5(F.concat("scene_name", F.lit("/"), F.col("candidate_id").cast("string")))
    return table(spark, d, "seed_points").groupBy("candidate_id", name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT class_id, name, CASE WHEN class_id = (SELECT max(class_id) FROM classes) THEN -1 ELSE class_id * 10 + 1 END AS dataset_id FROM classes")
def e2_dataset_ids(spark: SparkSession, d: str) -> DataFrame:
    """Dataset ids of predicted ids; the last one is background."""
    k = table(spark, d, "classes")
    return k.crossJoin(F.broadcast(k.agg(F.max("class_id").alias("last")))).select("class_id", "name", F.when(F.col("class_id") == F.col("last"), -1).otherwise(F.col("class_id") * 10 + 1).alias("dataset_id"))


@query(with_views("obs", JUDGED + """, t AS (SELECT split, sum(positive) AS total FROM j GROUP BY 1), c AS (SELECT split, score, sum(sum(positive)) OVER w AS tp FROM j GROUP BY 1, 2 WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), r AS (SELECT split, score, tp / total::DOUBLE AS r FROM c JOIN t USING (split)),
    s AS (SELECT split, r, r * (coalesce(lead(r) OVER w, r) - coalesce(lag(r) OVER w, 0)) / 2 AS part FROM r WINDOW w AS (PARTITION BY split ORDER BY score DESC)) SELECT split, sum(part) AS ar, max(r) AS top_recall FROM s GROUP BY 1"""))
def e10_average_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall over half steps of recall, and the largest one."""
    return evaluate.average_recall(_judged(spark, d), ["split"])


@query(with_views("cand pts", PAIRS + RANKED + """, g AS (SELECT s.* FROM s JOIN classes k USING (class_id) WHERE k.is_base), h AS (SELECT DISTINCT p.scene_name, g.class_id FROM pairs p JOIN g ON g.scene_name = p.scene_name AND g.candidate_id IN (p.a, p.b) WHERE p.iou > 0.5)
    SELECT scene_name, count(DISTINCT h.class_id) / count(DISTINCT g.class_id)::DOUBLE AS pcdc FROM g LEFT JOIN h USING (scene_name, class_id) GROUP BY 1"""))
def e11_class_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of a scene's base classes with a seed that another one matches."""
    g = cut(_seed_scores(spark, d).join(F.broadcast(table(spark, d, "classes").where("is_base").select("class_id")), "class_id", "left_semi").select("scene_name", "candidate_id", "class_id"))
    q = sets.similar_pairs(pts(spark, d), ["scene_name"], "candidate_id", 0.5)
    hit = q.select("scene_name", F.explode(F.array("a", "b")).alias("candidate_id")).join(g, ["scene_name", "candidate_id"]).groupBy("scene_name").agg(F.count_distinct("class_id").alias("m"))
    return g.groupBy("scene_name").agg(F.count_distinct("class_id").alias("k")).join(hit, "scene_name", "left").select("scene_name", (F.coalesce("m", F.lit(0)) / F.col("k")).alias("pcdc"))


@query(with_views("cand", """, r AS (SELECT class_name, score, row_number() OVER (PARTITION BY scene_name, candidate_id ORDER BY record_id) AS p, count(*) OVER (PARTITION BY scene_name, candidate_id) AS n FROM cand WHERE class_name IS NOT NULL), a AS (SELECT class_name, avg(score) AS first_score, count(*) AS n FROM r WHERE p = 1 GROUP BY 1), b AS (SELECT class_name, avg(score) AS last_score FROM r WHERE p = n GROUP BY 1),
    c AS (SELECT class_name, n, first_score, last_score, last_score - first_score AS delta FROM a JOIN b USING (class_name)), u AS ((SELECT *, 'gain' AS side FROM c ORDER BY delta DESC, class_name LIMIT 10) UNION ALL (SELECT *, 'drop' FROM c ORDER BY delta, class_name LIMIT 10)) SELECT * FROM u"""))
def q17_run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Ten largest gains and drops per class between first and last records: a report."""
    rows = cand(spark, d).where("class_name is not null").groupBy("scene_name", "candidate_id").agg(F.min_by(F.struct("class_name", "score"), "record_id").alias("a"), F.max_by(F.struct("class_name", "score"), "record_id").alias("b"))
    rows = cut(rows)
    a = rows.groupBy(F.col("a.class_name").alias("class_name")).agg(F.avg("a.score").alias("first_score"), F.count(F.lit(1)).alias("n"))
    b = rows.groupBy(F.col("b.class_name").alias("class_name")).agg(F.avg("b.score").alias("last_score"))
    c = a.join(b, "class_name").select("class_name", "n", "first_score", "last_score", (F.col("last_score") - F.col("first_score")).alias("delta"))
    gain = c.orderBy(F.desc("delta"), "class_name").limit(10).withColumn("side", F.lit("gain"))
    return gain.union(c.orderBy("delta", "class_name").limit(10).withColumn("side", F.lit("drop")))


@query(with_views("links obs", MEMBERS + """, c AS (SELECT trace_id, class_id, count(*) AS n FROM m WHERE class_id IS NOT NULL GROUP BY 1, 2), k AS (SELECT trace_id, arg_max(class_id, (n, -class_id)) AS class_id FROM c GROUP BY 1)
    SELECT m.trace_id, k.class_id, round(avg(coalesce(score, 0) * coalesce(sam_score, 0)), 9) AS score, count(DISTINCT frame_index) AS support_view_count, sum(coalesce(point_count, 0)) AS points FROM m JOIN k USING (trace_id) GROUP BY 1, 2 HAVING sum(coalesce(point_count, 0)) >= 100 AND count(DISTINCT frame_index) >= 2"""))
def q21_refined_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates from traces: voted class, mean of detector times mask score, enough points and views."""
    m = cut(_members(spark, d))
    k = votes.class_vote(m.where("class_id is not null"), ["trace_id"], "class_id", -1).select("trace_id", "class_id")
    each = m.groupBy("trace_id").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0)) * F.coalesce("sam_score", F.lit(0.0))), 9).alias("score"), F.count_distinct("frame_index").alias("support_view_count"), F.sum(F.coalesce("point_count", F.lit(0))).alias("points"))
    return each.where("points >= 100 and support_view_count >= 2").join(k, "trace_id").select("trace_id", "class_id", "score", "support_view_count", "points")
