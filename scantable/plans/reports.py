"""Diagnostic reports as composite queries: seeds of base classes stand for known instances, all others for proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scantable.common import cut, table
from scantable.functions import exprs as X
from scantable.operators import ranking, sets, votes
from scantable.plans.evidence import PAIRS, seed_pairs
from scantable.plans.registry import query
from scantable.plans.structure import COMPONENTS, RANKED, _components, _seed_scores
from scantable.plans.tracks import MEMBERS, _members
from scantable.plans.views import cand, obs, pts, with_views

#: proposals (p) against known instances (g): overlap from either side and whether classes agree
KNOWN = """, k AS (SELECT s.*, c.is_base, c.split FROM s JOIN classes c USING (class_id)), u AS (SELECT scene_name, a AS id, b AS other, iou, inter / size_a::DOUBLE AS mine, inter / size_b::DOUBLE AS theirs FROM pairs UNION ALL SELECT scene_name, b, a, iou, inter / size_b::DOUBLE, inter / size_a::DOUBLE FROM pairs),
    h AS (SELECT u.scene_name, u.id, u.other, u.iou, u.mine, u.theirs, p.class_id = g.class_id AS same_class FROM u JOIN k p ON p.scene_name = u.scene_name AND p.candidate_id = u.id AND NOT p.is_base JOIN k g ON g.scene_name = u.scene_name AND g.candidate_id = u.other AND g.is_base),
    best AS (SELECT scene_name, id, arg_max(other, (iou, -other)) AS other, max(iou) AS iou FROM h GROUP BY 1, 2), e AS (SELECT p.scene_name, p.candidate_id, p.class_id, p.split, p.score, coalesce(b.iou, 0) AS iou, coalesce(h.mine, 0) AS precision, coalesce(h.theirs, 0) AS coverage, coalesce(h.same_class, FALSE) AS same_class
        FROM k p LEFT JOIN best b ON b.scene_name = p.scene_name AND b.id = p.candidate_id LEFT JOIN h ON h.scene_name = b.scene_name AND h.id = b.id AND h.other = b.other WHERE NOT p.is_base)"""

TYPE = "CASE WHEN iou >= 0.5 AND same_class THEN 'correct' WHEN iou >= 0.5 THEN 'wrong_class' WHEN precision >= 0.8 THEN 'fragment' WHEN coverage >= 0.8 THEN 'merged' WHEN iou >= 0.1 THEN 'poorly_placed' ELSE 'background' END"


def error_type() -> F.Column:
    """How a proposal misses, by the first rule that holds."""
    c = F.col
    return X.first_reason([("correct", (c("iou") >= 0.5) & c("same_class")), ("wrong_class", c("iou") >= 0.5), ("fragment", c("precision") >= 0.8), ("merged", c("coverage") >= 0.8), ("poorly_placed", c("iou") >= 0.1)], "background")


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(all seeds with class facts, overlaps of proposals with known instances)."""
    k = cut(_seed_scores(spark, d).join(F.broadcast(table(spark, d, "classes").select("class_id", "is_base", "split")), "class_id"))
    q = seed_pairs(spark, d).select("scene_name", "a", "b", "iou", "cover_a", "cover_b")
    u = q.toDF("scene_name", "id", "other", "iou", "mine", "theirs").union(q.select("scene_name", "b", "a", "iou", "cover_b", "cover_a"))
    side = lambda c, base: k.where(F.col("is_base") == base).select("scene_name", F.col("candidate_id").alias(c), F.col("class_id").alias(f"class_{c}"))
    h = u.join(side("id", False), ["scene_name", "id"]).join(side("other", True), ["scene_name", "other"])
    return k, h.select("scene_name", "id", "other", "iou", "mine", "theirs", (F.col("class_id") == F.col("class_other")).alias("same_class"))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    """Every proposal with its best known instance."""
    k, h = _known(spark, d)
    best = h.groupBy("scene_name", "id").agg(F.max_by(F.struct("iou", "mine", "theirs", "same_class"), F.struct("iou", -F.col("other"))).alias("b"))
    out = k.where("not is_base").join(best.withColumnRenamed("id", "candidate_id"), ["scene_name", "candidate_id"], "left")
    zero = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0.0))
    return out.select("scene_name", "candidate_id", "class_id", "split", "score", zero("iou").alias("iou"), zero("mine").alias("precision"), zero("theirs").alias("coverage"), F.coalesce("b.same_class", F.lit(False)).alias("same_class"))


@query(with_views("cand pts", PAIRS + RANKED + KNOWN + f" SELECT split, {TYPE} AS error_type, count(*) AS n, avg(score) AS mean_score FROM e GROUP BY 1, 2"))
def q2_error_report(spark: SparkSession, d: str) -> DataFrame:
    """Proposals by kind of error and split."""
    return _errors(spark, d).groupBy("split", error_type().alias("error_type")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query(with_views("cand", """, t AS (SELECT scene_name, candidate_id, arg_min(class_id, record_id) AS f, arg_max(class_id, record_id) AS l, arg_max(class_id, (score, record_id)) AS b FROM cand WHERE class_id IS NOT NULL GROUP BY 1, 2), v AS (SELECT scene_name, candidate_id, class_id, count(*) AS c FROM cand WHERE class_id IS NOT NULL GROUP BY 1, 2, 3),
    m AS (SELECT scene_name, candidate_id, arg_max(class_id, (c, -class_id)) AS m FROM v GROUP BY 1, 2) SELECT count(*) AS n, avg(CAST(f = m AS INT)) AS first_agrees, avg(CAST(l = m AS INT)) AS last_agrees, avg(CAST(b = m AS INT)) AS best_agrees FROM t JOIN m USING (scene_name, candidate_id)"""))
def q3_semantics(spark: SparkSession, d: str) -> DataFrame:
    """How often the first, last and best-scored class agree with the vote over a candidate's records."""
    rows = cand(spark, d).where("class_id is not null")
    one = rows.groupBy("scene_name", "candidate_id").agg(F.min_by("class_id", "record_id").alias("f"), F.max_by("class_id", "record_id").alias("l"), F.max_by("class_id", F.struct("score", "record_id")).alias("b"))
    vote = votes.class_vote(rows, ["scene_name", "candidate_id"], "class_id", -1).select("scene_name", "candidate_id", F.col("class_id").alias("m"))
    agrees = lambda c: F.avg((F.col(c) == F.col("m")).cast("int"))
    return one.join(vote, ["scene_name", "candidate_id"]).agg(F.count(F.lit(1)).alias("n"), agrees("f").alias("first_agrees"), agrees("l").alias("last_agrees"), agrees("b").alias("best_agrees"))


LEDGER = "CASE WHEN l.score < 0.2 THEN 'score_below_minimum' WHEN l.views < 2 THEN 'too_few_views' WHEN l.existing_iou > 0.5 THEN 'covered_by_existing' ELSE 'accepted' END"


@query(with_views("cand pts", PAIRS + RANKED + KNOWN + f""", y AS (SELECT *, row_number() OVER (PARTITION BY scene_name, candidate_id ORDER BY record_id DESC) AS p FROM cand), z2 AS (SELECT l.scene_name, l.candidate_id, {LEDGER} AS decision FROM y l WHERE p = 1)
    SELECT decision, {TYPE} AS error_type, count(*) AS n FROM e JOIN z2 USING (scene_name, candidate_id) GROUP BY 1, 2"""))
def q4_decision_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on proposals against what they really are."""
    c = F.col
    rules = [("score_below_minimum", c("score") < 0.2), ("too_few_views", c("views") < 2), ("covered_by_existing", c("existing_iou") > 0.5)]
    last = cand(spark, d).groupBy("scene_name", "candidate_id").agg(F.max_by(F.struct("score", "views", "existing_iou"), "record_id").alias("l")).select("scene_name", "candidate_id", "l.*")
    decided = last.select("scene_name", "candidate_id", X.first_reason(rules, "accepted").alias("decision"))
    return _errors(spark, d).join(decided, ["scene_name", "candidate_id"]).groupBy("decision", error_type().alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


FUNNEL = """, f AS (SELECT g.scene_name, g.candidate_id, g.split, coalesce(max(h.iou), 0) AS iou, coalesce(max(h.theirs), 0) AS cover, coalesce(max(h.iou) FILTER (WHERE h.same_class), 0) AS class_iou FROM k g LEFT JOIN h ON h.scene_name = g.scene_name AND h.other = g.candidate_id WHERE g.is_base GROUP BY 1, 2, 3)"""


def _instances(spark: SparkSession, d: str) -> DataFrame:
    """Every known instance with the best that proposals reach on it."""
    k, h = _known(spark, d)
    reach = h.groupBy("scene_name", F.col("other").alias("candidate_id")).agg(F.max("iou").alias("iou"), F.max("theirs").alias("cover"), F.max(F.when(F.col("same_class"), F.col("iou"))).alias("class_iou"))
    out = k.where("is_base").join(reach, ["scene_name", "candidate_id"], "left")
    return out.select("scene_name", "candidate_id", "split", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("iou", "cover", "class_iou")])


@query(with_views("cand pts", PAIRS + RANKED + KNOWN + FUNNEL + " SELECT split, CASE WHEN cover = 0 THEN 'not_seeded' WHEN cover < 0.5 THEN 'low_coverage' WHEN iou < 0.5 THEN 'poor_mask' WHEN class_iou < 0.5 THEN 'wrong_class' ELSE 'found' END AS stage, count(*) AS n FROM f GROUP BY 1, 2"))
def q5_failure_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Stage at which a known instance is lost."""
    c = F.col
    stage = X.first_reason([("not_seeded", c("cover") == 0), ("low_coverage", c("cover") < 0.5), ("poor_mask", c("iou") < 0.5), ("wrong_class", c("class_iou") < 0.5)], "found")
    return _instances(spark, d).groupBy("split", stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("cand pts", PAIRS + RANKED + KNOWN + FUNNEL + " SELECT split, count(*) AS instances, avg(CAST(iou >= 0.25 AS INT)) AS recall25, avg(CAST(iou >= 0.5 AS INT)) AS recall50, avg(CAST(class_iou >= 0.5 AS INT)) AS class_recall50, avg(iou) AS mean_iou FROM f GROUP BY 1"))
def q11_oracle_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of known instances by any proposal."""
    share = lambda cond: F.avg(cond.cast("int"))
    return _instances(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("instances"), share(F.col("iou") >= 0.25).alias("recall25"), share(F.col("iou") >= 0.5).alias("recall50"), share(F.col("class_iou") >= 0.5).alias("class_recall50"), F.avg("iou").alias("mean_iou"))


@query(with_views("obs", """, v AS (SELECT scene_name, frame_index, class_id AS l, count(*) AS c FROM obs WHERE frame_index IS NOT NULL AND class_id IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT scene_name, frame_index, sum(c) AS n, max(c) / sum(c)::DOUBLE AS s FROM v GROUP BY 1, 2)
    SELECT CASE WHEN n < 2 THEN 'too_small' WHEN s < 0.5 THEN 'mixed' WHEN s < 0.8 THEN 'weak_majority' ELSE 'reliable' END AS reason, count(*) AS segments, sum(n) AS points FROM p GROUP BY 1"""))
def q7_unreliable(spark: SparkSession, d: str) -> DataFrame:
    """Frames as segments: why they aren't reliable."""
    pure = sets.purity(obs(spark, d).where("frame_index is not null and class_id is not null"), ["scene_name"], "frame_index", "class_id")
    reason = X.first_reason([("too_small", F.col("n") < 2), ("mixed", F.col("majority_share") < 0.5), ("weak_majority", F.col("majority_share") < 0.8)], "reliable")
    return pure.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("points"))


@query(with_views("obs", """, s AS (SELECT scene_name, count(*) AS observations, count(DISTINCT frame_index) AS frames, avg(score) AS mean_score, count(*) FILTER (WHERE score IS NULL OR sam_score IS NULL) / count(*)::DOUBLE AS missing FROM obs GROUP BY 1),
    u AS ((SELECT scene_name, 'low_score' AS r FROM s ORDER BY mean_score, scene_name LIMIT 5) UNION ALL (SELECT scene_name, 'missing' FROM s ORDER BY missing DESC, scene_name LIMIT 5) UNION ALL (SELECT scene_name, 'many' FROM s ORDER BY observations DESC, scene_name LIMIT 5))
    SELECT scene_name, string_agg(r, ';' ORDER BY r) AS reasons FROM u GROUP BY 1"""))
def q10_quality_review(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of low score, missing scores or many observations: a short review list."""
    gap = F.count_if(F.col("score").isNull() | F.col("sam_score").isNull()) / F.count(F.lit(1))
    s = obs(spark, d).groupBy("scene_name").agg(F.count(F.lit(1)).alias("observations"), F.avg("score").alias("mean_score"), gap.alias("missing"))
    return ranking.review_list(cut(s), "scene_name", [("low_score", F.col("mean_score").asc_nulls_last(), 5), ("missing", F.col("missing").desc(), 5), ("many", F.col("observations").desc(), 5)])


@query(with_views("obs", """, c AS (SELECT class_id AS r, frame_index AS f, count(*) AS n FROM obs WHERE class_id IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1, 2), a AS (SELECT r, count(*) AS k, sum(n) AS n, max(n) AS m FROM c GROUP BY 1), b AS (SELECT f, count(*) AS k, sum(n) AS n, max(n) AS m FROM c GROUP BY 1)
    SELECT 'class' AS method, count(*) AS segments, avg(n) AS mean_size, max(n) AS max_size, sum(m) / sum(n) AS weighted_purity, count(*) FILTER (WHERE k > 1) AS shared FROM a UNION ALL SELECT 'frame', count(*), avg(n), max(n), sum(m) / sum(n), count(*) FILTER (WHERE k > 1) FROM b"""))
def q12_methods(spark: SparkSession, d: str) -> DataFrame:
    """Two partitions of the observations compared: sizes, purity against each other, cells that are shared."""
    c = cut(obs(spark, d).where("class_id is not null and frame_index is not null").groupBy("class_id", "frame_index").agg(F.count(F.lit(1)).alias("n")))

    def side(key: str, name: str) -> DataFrame:
        s = c.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max("n").alias("m"))
        return s.agg(F.lit(name).alias("method"), F.count(F.lit(1)).alias("segments"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"), (F.sum("m") / F.sum("n")).alias("weighted_purity"), F.count_if(F.col("k") > 1).alias("shared"))

    return side("class_id", "class").union(side("frame_index", "frame"))


@query(with_views("cand pts", PAIRS + RANKED + KNOWN + """, y AS (SELECT scene_name, candidate_id, arg_max(kind, record_id) FILTER (WHERE kind IS NOT NULL) AS kind FROM cand GROUP BY 1, 2)
    SELECT y.kind, count(*) AS proposals, count(*) FILTER (WHERE iou >= 0.5) AS hits, count(*) FILTER (WHERE iou >= 0.5) / count(*)::DOUBLE AS hit_rate, avg(precision) AS mean_precision, avg(coverage) AS mean_coverage FROM e JOIN y USING (scene_name, candidate_id) GROUP BY 1"""))
def q15_applied_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the proposals of each source kind hit."""
    kind = cand(spark, d).groupBy("scene_name", "candidate_id").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("record_id"))).alias("kind"))
    hit = F.count_if(F.col("iou") >= 0.5)
    return _errors(spark, d).join(kind, ["scene_name", "candidate_id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("proposals"), hit.alias("hits"), (hit / F.count(F.lit(1))).alias("hit_rate"), F.avg("precision").alias("mean_precision"), F.avg("coverage").alias("mean_coverage"))


@query(with_views("cand", """, g(variant, min_score, min_views, max_covered) AS (VALUES ('base', 0.3, 2, 0.8), ('score_low', 0.1, 2, 0.8), ('score_high', 0.6, 2, 0.8), ('views_high', 0.3, 4, 0.8), ('covered_low', 0.3, 2, 0.4))
    SELECT variant, count(*) AS kept, avg(score) AS mean_score, avg(mean_iou) AS mean_iou FROM g JOIN cand ON score >= min_score AND views >= min_views AND covered <= max_covered GROUP BY 1"""))
def q18_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One-factor sweep of three limits, all variants in one pass over the records."""
    variants = [("base", 0.3, 2, 0.8), ("score_low", 0.1, 2, 0.8), ("score_high", 0.6, 2, 0.8), ("views_high", 0.3, 4, 0.8), ("covered_low", 0.3, 2, 0.4)]
    hit = F.array_compact(F.array(*[F.when((F.col("score") >= s) & (F.col("views") >= v) & (F.col("covered") <= c), F.lit(name)) for name, s, v, c in variants]))
    each = cand(spark, d).select(F.explode(hit).alias("variant"), "score", "mean_iou")
    return each.groupBy("variant").agg(F.count(F.lit(1)).alias("kept"), F.avg("score").alias("mean_score"), F.avg("mean_iou").alias("mean_iou"))


@query(with_views("cand", """SELECT action, count(*) AS n, avg(score) AS mean_score FROM (SELECT score, CASE WHEN score >= 0.8 AND views >= 3 AND covered < 0.3 THEN 'accept' WHEN mean_iou >= 0.5 AND covered < 0.6 THEN 'keep_core' WHEN score >= 0.4 OR views >= 5 THEN 'review' ELSE 'reject' END AS action FROM cand) GROUP BY 1"""))
def q20_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions on records by an ordered cascade."""
    c = F.col
    rules = [("accept", (c("score") >= 0.8) & (c("views") >= 3) & (c("covered") < 0.3)), ("keep_core", (c("mean_iou") >= 0.5) & (c("covered") < 0.6)), ("review", (c("score") >= 0.4) | (c("views") >= 5))]
    return cand(spark, d).groupBy(X.first_reason(rules, "reject").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query("WITH RECURSIVE" + with_views("links obs", COMPONENTS + """, gg AS (SELECT component, count(*) AS size, count(DISTINCT frame_index) AS frames, avg(coalesce(score, 0)) AS mean_score, coalesce(sum(point_count), 0) AS points FROM k JOIN obs ON observation_id = node GROUP BY 1)
    SELECT component, CASE WHEN frames < 2 THEN 'single_view' WHEN points < 200 THEN 'too_few_points' WHEN mean_score < 0.5 THEN 'low_score' ELSE 'keep' END AS decision, size FROM gg""")[4:])
def q22_quality_filter(spark: SparkSession, d: str) -> DataFrame:
    """Decision on every group of observations, from its size and scores alone."""
    o = obs(spark, d).select(F.col("observation_id").alias("node"), "frame_index", "score", "point_count")
    g = _components(spark, d).join(o, "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("frame_index").alias("frames"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("points"))
    return g.select("component", X.first_reason([("single_view", F.col("frames") < 2), ("too_few_points", F.col("points") < 200), ("low_score", F.col("mean_score") < 0.5)], "keep").alias("decision"), "size")


@query(with_views("cand obs links", MEMBERS + """, v AS (SELECT trace_id, avg(score) AS confidence FROM m WHERE score IS NOT NULL GROUP BY 1), t AS (SELECT candidate_id, max(confidence) AS confidence FROM (SELECT DISTINCT candidate_id, trace_id FROM mask_graph_trace WHERE candidate_id IS NOT NULL) JOIN v USING (trace_id) GROUP BY 1)
    SELECT c.record_id, coalesce(t.confidence >= 0.6, TRUE) AS passes FROM cand c LEFT JOIN t USING (candidate_id) WHERE class_name IN ('armchair', 'sink', 'tap')"""))
def q23_verified_filter(spark: SparkSession, d: str) -> DataFrame:
    """Records of some classes with whether their traces confirm them; without a verdict they pass."""
    v = _members(spark, d).where("score is not null").groupBy("trace_id").agg(F.avg("score").alias("confidence"))
    t = table(spark, d, "mask_graph_trace").where("candidate_id is not null").select("candidate_id", "trace_id").distinct().join(v, "trace_id").groupBy("candidate_id").agg(F.max("confidence").alias("confidence"))
    return cand(spark, d).where(F.col("class_name").isin("armchair", "sink", "tap")).join(t, "candidate_id", "left").select("record_id", F.coalesce(F.col("confidence") >= 0.6, F.lit(True)).alias("passes"))


@query(with_views("links obs", MEMBERS + """, e AS (SELECT trace_id, class_id, sum(coalesce(score, 0)) AS s FROM m WHERE class_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY s DESC, class_id) AS p FROM e), t AS (SELECT trace_id, max(class_id) FILTER (WHERE p = 1) AS best, max(s) FILTER (WHERE p = 1) AS s1, coalesce(max(s) FILTER (WHERE p = 2), 0) AS s2 FROM r GROUP BY 1),
    z AS (SELECT *, CASE WHEN stddev_pop(s1) OVER w < 1e-6 THEN 0 ELSE (s1 - avg(s1) OVER w) / stddev_pop(s1) OVER w END AS z FROM t WINDOW w AS (PARTITION BY best)) SELECT trace_id, best, z > 0 AND s1 - s2 > 0.2 AS confirmed FROM z"""))
def q24_class_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether a trace's best class stands out in its class and against the second one."""
    e = _members(spark, d).where("class_id is not null").groupBy("trace_id", "class_id").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("s"))
    top = ranking.top_k(e, ["trace_id"], [F.desc("s"), F.col("class_id")], 2)
    t = top.groupBy("trace_id").agg(F.max(F.when(F.col("place") == 1, F.col("class_id"))).alias("best"), F.max(F.when(F.col("place") == 1, F.col("s"))).alias("s1"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("s"))), F.lit(0.0)).alias("s2"))
    return ranking.with_group_z(t, ["best"], "s1").select("trace_id", "best", ((F.col("z") > 0) & (F.col("s1") - F.col("s2") > 0.2)).alias("confirmed"))


# ---- further parts


@query(with_views("links obs", MEMBERS + """, e AS (SELECT scene_name, trace_id, class_id, sum(coalesce(score, 0)) AS s, count(*) AS n FROM m WHERE class_id IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT scene_name, class_id, sum(s) AS s, sum(n) AS n FROM e GROUP BY 1, 2) SELECT scene_name, class_id, s / sum(s) OVER (PARTITION BY scene_name) AS share, n FROM t WHERE s > 0"""))
def a5_merged_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of traces merged to scenes: sums add up, ratios are taken at the end."""
    part = _members(spark, d).where("class_id is not null").groupBy("scene_name", "trace_id", "class_id").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("scene_name", "class_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("s > 0")
    return whole.select("scene_name", "class_id", (F.col("s") / F.sum("s").over(Window.partitionBy("scene_name"))).alias("share"), "n")


@query(with_views("links obs", MEMBERS + """, f AS (SELECT trace_id, class_id, count(DISTINCT frame_index) AS frames, avg(coalesce(score, 0)) AS inside, avg(coalesce(sam_score, 0)) AS consistent FROM m WHERE class_id IS NOT NULL GROUP BY 1, 2)
    SELECT trace_id, class_id, CASE WHEN frames >= 2 AND inside >= 0.6 AND consistent >= 0.6 THEN 'strong' WHEN inside >= 0.6 AND consistent >= 0.6 THEN 'single_strong' WHEN inside >= 0.6 THEN 'depth_conflict' WHEN consistent >= 0.6 THEN 'boundary' WHEN frames >= 2 THEN 'weak' ELSE 'none' END AS support FROM f"""))
def a23_support_labels(spark: SparkSession, d: str) -> DataFrame:
    """Support of each label of a trace, in six kinds."""
    f = _members(spark, d).where("class_id is not null").groupBy("trace_id", "class_id").agg(F.count_distinct("frame_index").alias("frames"), F.avg(F.coalesce("score", F.lit(0.0))).alias("inside"), F.avg(F.coalesce("sam_score", F.lit(0.0))).alias("consistent"))
    a, b, two = F.col("inside") >= 0.6, F.col("consistent") >= 0.6, F.col("frames") >= 2
    return f.select("trace_id", "class_id", X.first_reason([("strong", two & a & b), ("single_strong", a & b), ("depth_conflict", a), ("boundary", b), ("weak", two)], "none").alias("support"))


@query(with_views("obs", """, b AS (SELECT scene_name, frame_index, CAST(floor(coalesce(point_count, 0) / 50.0) AS BIGINT) AS bin, count(*) AS n FROM obs WHERE frame_index IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT scene_name, frame_index, arg_max(bin, (n, -bin)) AS bin, sum(n) AS total FROM b GROUP BY 1, 2)
    SELECT t.scene_name, t.frame_index, t.bin, sum(b.n) AS kept, sum(b.n) / any_value(total)::DOUBLE AS share FROM t JOIN b ON b.scene_name = t.scene_name AND b.frame_index = t.frame_index AND b.bin BETWEEN t.bin - 1 AND t.bin + 1 GROUP BY 1, 2, 3"""))
def geo_dominant_bin(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent bin of a frame and what lies in it or beside it."""
    b = obs(spark, d).where("frame_index is not null").groupBy("scene_name", "frame_index", F.floor(F.coalesce("point_count", F.lit(0)) / 50.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per = F.collect_list(F.struct("bin", "n"))  # the bins of one frame
    t = b.groupBy("scene_name", "frame_index").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.sum("n").alias("total"), per.alias("bins"))
    kept = F.aggregate(F.filter("bins", lambda x: F.abs(x["bin"] - F.col("bin")) <= 1), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return t.select("scene_name", "frame_index", "bin", kept.alias("kept"), (kept / F.col("total")).alias("share"))


@query("WITH RECURSIVE" + with_views("links obs", COMPONENTS + ", r AS (SELECT component, count(*) AS nodes FROM k GROUP BY 1), p AS (SELECT component, count(DISTINCT class_id) AS parts FROM k JOIN obs ON observation_id = node GROUP BY 1) SELECT CASE WHEN parts = 0 THEN 'dropped' WHEN parts = 1 THEN 'unchanged' ELSE 'split' END AS outcome, count(*) AS components, sum(nodes) AS nodes FROM r JOIN p USING (component) GROUP BY 1")[4:])
def g14_partition_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Groups that their members' classes split, leave as they are, or drop."""
    o = obs(spark, d).select(F.col("observation_id").alias("node"), "class_id")
    g = cut(_components(spark, d))
    nodes = g.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    parts = g.join(o, "node").groupBy("component").agg(F.count_distinct("class_id").alias("parts"))
    outcome = X.first_reason([("dropped", F.col("parts") == 0), ("unchanged", F.col("parts") == 1)], "split")
    return nodes.join(parts, "component").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("components"), F.sum("nodes").alias("nodes"))


@query(with_views("pts", """, g AS (SELECT scene_name, candidate_id, CAST(floor(item / 100) AS BIGINT) AS seg, count(*) AS hits FROM pts GROUP BY 1, 2, 3), s AS (SELECT scene_name, CAST(floor(item / 100) AS BIGINT) AS seg, count(DISTINCT item) AS size FROM pts GROUP BY 1, 2), c AS (SELECT scene_name, candidate_id, hits, size, hits / size::DOUBLE AS cover FROM g JOIN s USING (scene_name, seg)),
    r AS (SELECT scene_name, candidate_id, sum(hits) AS n, coalesce(sum(size) FILTER (WHERE cover >= 0.5), 0) AS refined, coalesce(sum(hits) FILTER (WHERE cover >= 0.5), 0) AS retained FROM c GROUP BY 1, 2)
    SELECT scene_name, candidate_id, CASE WHEN retained < n * 0.5 THEN n WHEN refined > n * 2 THEN n ELSE refined END AS points, CASE WHEN retained < n * 0.5 THEN 'kept_retention' WHEN refined > n * 2 THEN 'kept_expansion' ELSE 'refined' END AS how FROM r"""))
def g13_refinement(spark: SparkSession, d: str) -> DataFrame:
    """Seeds as the blocks they half cover, or as they were where too much is lost or gained."""
    p = pts(spark, d).withColumn("seg", F.floor(F.col("item") / 100))
    sizes = p.groupBy("scene_name", "seg").agg(F.count_distinct("item").alias("size"))
    c = sets.segment_coverage(p, sizes, ["scene_name", "candidate_id"], "seg")
    held = lambda v: F.sum(F.when(F.col("coverage") >= 0.5, F.col(v)).otherwise(0))
    r = c.groupBy("scene_name", "candidate_id").agg(F.sum("hits").alias("n"), held("size").alias("refined"), held("hits").alias("retained"))
    how = X.first_reason([("kept_retention", F.col("retained") < F.col("n") * 0.5), ("kept_expansion", F.col("refined") > F.col("n") * 2)], "refined")
    return r.select("scene_name", "candidate_id", F.when(how == "refined", F.col("refined")).otherwise(F.col("n")).alias("points"), how.alias("how"))


@query("SELECT scene_name, class_id, count(*) AS points, min(observation_id) AS first_id FROM observations WHERE class_id IS NOT NULL AND class_id NOT IN (0, 1) GROUP BY 1, 2 HAVING count(*) >= 2")
def v3_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instances of a scene without ignored classes and small ones."""
    rows = table(spark, d, "observations").where(F.col("class_id").isNotNull() & ~F.col("class_id").isin(0, 1))
    return rows.groupBy("scene_name", "class_id").agg(F.count(F.lit(1)).alias("points"), F.min("observation_id").alias("first_id")).where("points >= 2")
