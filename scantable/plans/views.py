"""Relations the queries share, as DataFrames and as SQL of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantable.common import same_name, table
from scantable.functions.exprs import safe_double
from scantable.operators.sets import explode_sets

#: SQL of the relations below; a query's SQL starts with the ones it needs.
SQL = {
    "cand": """cand AS (SELECT record_id, scene_name, candidate_id, nullif(regexp_replace(lower(source_kind), '[^\\p{L}\\p{N}]', '', 'g'), '') AS kind, class_id, class_name, coalesce(CASE WHEN isfinite(score) THEN score END, 0.0) AS score,
        CASE WHEN isfinite(fusion_score) THEN fusion_score END AS fusion, coalesce(CASE WHEN isfinite(support_mean_iou) THEN support_mean_iou END, 0.0) AS mean_iou,
        coalesce(CASE WHEN isfinite(support_best_iou) THEN support_best_iou END, 0.0) AS best_iou, coalesce(CASE WHEN isfinite(seed_in_existing_mask_ratio) THEN seed_in_existing_mask_ratio END, 0.0) AS covered,
        coalesce(CASE WHEN isfinite(best_existing_iou) THEN best_existing_iou END, 0.0) AS existing_iou, coalesce(CASE WHEN isfinite(box_area_ratio) THEN box_area_ratio END, 0.0) AS area_ratio,
        coalesce(support_view_count, 0) AS views, num_seed_points, support_views, source_json FROM backprojection_candidates)""",
    "pts": "pts AS (SELECT DISTINCT scene_name, candidate_id, item FROM (SELECT scene_name, candidate_id, unnest(point_indices) AS item FROM seed_points) WHERE item >= 0)",
    "obs": """obs AS (SELECT observation_id, scene_name, frame_index, class_id, CASE WHEN isfinite(score) THEN score END AS score, CASE WHEN isfinite(sam_score) THEN sam_score END AS sam_score, point_count,
        (observation_id % 97) * 6.0 AS x1, (observation_id % 89) * 5.0 AS y1, (observation_id % 97) * 6.0 + 20 + (observation_id % 7) * 10 AS x2, (observation_id % 89) * 5.0 + 15 + (observation_id % 5) * 12 AS y2 FROM observations)""",
    "links": "links AS (SELECT DISTINCT scene_name, trace_id, m AS observation_id FROM (SELECT scene_name, trace_id, unnest(member_observation_ids) AS m FROM mask_graph_trace) WHERE m >= 0)",
    "vec": "vec AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)",
}


def with_views(names: str, body: str) -> str:
    """SQL of a query over the named relations."""
    return f"WITH {', '.join(SQL[n] for n in names.split())} {body}"


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate records with finite numbers and one spelling of the source kind."""
    d = table(spark, sf_dir, "backprojection_candidates")
    zero = {"mean_iou": "support_mean_iou", "best_iou": "support_best_iou", "covered": "seed_in_existing_mask_ratio", "existing_iou": "best_existing_iou", "area_ratio": "box_area_ratio"}
    return d.select(
        "record_id", "scene_name", "candidate_id", same_name("source_kind").alias("kind"), "class_id", "class_name", safe_double("score", 0.0).alias("score"), safe_double("fusion_score").alias("fusion"),
        *[safe_double(c, 0.0).alias(a) for a, c in zero.items()], F.coalesce("support_view_count", F.lit(0)).alias("views"), "num_seed_points", "support_views", "source_json",
    )


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct points of every candidate's seed."""
    return explode_sets(table(spark, sf_dir, "seed_points"), "point_indices", "scene_name", "candidate_id")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with finite scores and a made-up box each."""
    d = table(spark, sf_dir, "observations")
    i = F.col("observation_id")
    x1, y1 = (i % 97) * 6.0, (i % 89) * 5.0
    return d.select(
        "observation_id", "scene_name", "frame_index", "class_id", safe_double("score").alias("score"), safe_double("sam_score").alias("sam_score"), "point_count",
        x1.alias("x1"), y1.alias("y1"), (x1 + 20 + (i % 7) * 10).alias("x2"), (y1 + 15 + (i % 5) * 12).alias("y2"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct observations of every trace."""
    return explode_sets(table(spark, sf_dir, "mask_graph_trace"), "member_observation_ids", "scene_name", "trace_id", name="observation_id")


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three axes of the embeddings as points."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(a) for i, a in enumerate("xyz")])
