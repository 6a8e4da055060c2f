"""Queries whose result depends on the order of steps; tested on small cases, as SQL can't state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantable.common import cut
from scantable.operators import greedy, kernels
from scantable.plans.registry import query
from scantable.plans.structure import _seed_scores
from scantable.plans.tracks import _members
from scantable.plans.views import links, obs, pts, vec


def _seed_sets(spark: SparkSession, d: str) -> DataFrame:
    items = pts(spark, d).groupBy("scene_name", "candidate_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return items.join(_seed_scores(spark, d).select("scene_name", "candidate_id", "class_id", "score"), ["scene_name", "candidate_id"]).where("class_id is not null")


@query()
def n6_absorb(spark: SparkSession, d: str) -> DataFrame:
    """Seeds joining the best proposal of their class in order of id."""
    return kernels.absorb(_seed_sets(spark, d).withColumn("at", F.col("candidate_id")), ["scene_name"], "candidate_id", "at", "class_id", "items", 0.5)


@query()
def n8_best_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of a scene and class merged by best pairs."""
    rows = cut(_seed_sets(spark, d))
    parts = greedy.linked_sets(rows.select("scene_name", "class_id", "candidate_id", F.explode("items").alias("item")), ["scene_name", "class_id"], "candidate_id")
    out = kernels.merge_best_pairs(rows.join(parts, ["scene_name", "class_id", "candidate_id"]), ["scene_name", "class_id", "part"], "candidate_id", "items", 0.4, 5).drop("part")
    return out.withColumn("members", F.concat_ws(",", F.col("members").cast("array<string>")))


@query()
def n10_containment(spark: SparkSession, d: str) -> DataFrame:
    """Seeds with those they hold carved out."""
    return kernels.resolve_containment(_seed_sets(spark, d), ["scene_name", "class_id"], "candidate_id", "score", "items", "carve", 0.8)


@query()
def n13_accepted_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a trace whose new classes are worth more than nothing."""
    m = _members(spark, d).where("frame_index is not null and class_id is not null")
    worth = m.groupBy("trace_id", "class_id").agg((F.sum(2 * F.coalesce("score", F.lit(0.0))) - F.count(F.lit(1))).alias("worth"))
    return kernels.accept_frames(m.select("trace_id", "frame_index", "class_id").distinct().join(worth, ["trace_id", "class_id"]), ["trace_id"], "frame_index", "class_id", "worth")


@query()
def g8_constrained_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Observations clustered along traces; a pair of one frame is in conflict."""
    o = obs(spark, d).select("observation_id", "frame_index", F.coalesce("score", F.lit(0.0)).alias("q"))
    seen = links(spark, d).join(o.select("observation_id", "frame_index"), "observation_id").select("scene_name", "trace_id", "observation_id", "frame_index").distinct()
    e = seen.toDF("scene_name", "t", "a", "fa").join(seen.toDF("scene_name", "t", "b", "fb"), ["scene_name", "t"]).where("a < b").groupBy("scene_name", "a", "b").agg(F.max(F.col("fa").eqNullSafe(F.col("fb"))).alias("conflict"))
    nodes = seen.select("scene_name", "observation_id").distinct().join(o, "observation_id")
    return kernels.constrained_clusters(nodes, e, ["scene_name"], "observation_id", "q")


@query()
def v5_random_crop(spark: SparkSession, d: str) -> DataFrame:
    """A box of points of each label."""
    return kernels.random_crop(vec(spark, d), ["label"], "vec_id", ["x", "y", "z"], 0.3, 5)


@query()
def v9_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    """Scenes over five folds with even classes."""
    return kernels.stratified_folds(obs(spark, d), "scene_name", "class_id", 5)
