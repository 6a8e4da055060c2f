"""Evidence on pairs of views: depth relations, mutual visibility, and which pairs are looked at."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantable.operators.greedy import grouped_kernel
from scantable.operators.ranking import top_k


def directed_depth(pairs: DataFrame, members: DataFrame, seen: DataFrame, masks: DataFrame, scene: str = "scene") -> DataFrame:
    """What the points of a source view meet in the frame of a target view, per directed pair.

    pairs: scene, src, dst, frame_id (of dst), distinct; members: scene, obs, point_id; seen: scene, frame_id, point_id, expected, measured - depths of
    points at their pixel; masks: scene, obs, point_id - points inside a view's mask. (scene, src, dst, input, valid, consistent, inside, inside_consistent, consistent_ratio,
    inside_consistent_ratio, conflict_ratio, inside_conflict_ratio, median_error, p90_error). Valid points have both depths above 0; they are consistent
    within min(0.10, max(0.04, 0.03 x measured)). A pair without valid points has ratios and errors of 0. Each pair is computed once, by equi-joins on points.
    """
    p = pairs.join(members.select(scene, F.col("obs").alias("src"), "point_id"), [scene, "src"])
    p = p.join(seen, [scene, "frame_id", "point_id"], "left").join(masks.select(scene, F.col("obs").alias("dst"), "point_id", F.lit(True).alias("__in")), [scene, "dst", "point_id"], "left")
    valid = (F.col("measured") > 0) & (F.col("expected") > 0)
    error = F.abs(F.col("expected") - F.col("measured"))
    good = error <= F.least(F.lit(0.10), F.greatest(F.lit(0.04), 0.03 * F.col("measured")))
    inside = F.col("__in").isNotNull()
    c = p.groupBy(scene, "src", "dst").agg(
        F.count(F.lit(1)).alias("input"), F.count_if(valid).alias("valid"), F.count_if(valid & good).alias("consistent"), F.count_if(valid & inside).alias("inside"), F.count_if(valid & inside & good).alias("inside_consistent"),
        F.coalesce(F.median(F.when(valid, error)), F.lit(0.0)).alias("median_error"), F.coalesce(F.percentile(F.when(valid, error), 0.9), F.lit(0.0)).alias("p90_error"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    rest = lambda a, b: (F.col(b) - F.col(a)) / F.greatest(F.lit(1), F.col(b))
    return c.withColumns({
        "consistent_ratio": share("consistent", "valid"), "inside_consistent_ratio": share("inside_consistent", "inside"),
        "conflict_ratio": rest("consistent", "valid"), "inside_conflict_ratio": rest("inside_consistent", "inside"),
    })


def mutual_visible(pairs: DataFrame, members: DataFrame, visible: DataFrame, masks: DataFrame, scene: str = "scene") -> DataFrame:
    """Of two views, the points of each that the other one sees and holds in its mask, and how the two sets overlap.

    pairs: scene, a, b, frame_a, frame_b, distinct; visible: scene, frame_id, point_id. (scene, a, b, and per direction visible_ratio and inside_ratio; depth_consistency and
    mask_consistency: the smaller of both directions; shared, visible_iou, visible_containment of the two point sets). Nothing seen gives 0.
    """
    ways = pairs.select(scene, "a", "b", F.col("a").alias("obs"), F.col("b").alias("other"), F.col("frame_b").alias("frame_id"), F.lit("ab").alias("way"))
    ways = ways.union(pairs.select(scene, "a", "b", "b", "a", "frame_a", F.lit("ba")))
    p = ways.join(members, [scene, "obs"]).join(visible.select(scene, "frame_id", "point_id", F.lit(True).alias("__v")), [scene, "frame_id", "point_id"], "left")
    p = p.join(masks.select(scene, F.col("obs").alias("other"), "point_id", F.lit(True).alias("__m")), [scene, "other", "point_id"], "left")
    seen, held = F.col("__v").isNotNull(), F.col("__v").isNotNull() & F.col("__m").isNotNull()
    each = p.groupBy(scene, "a", "b", "point_id").agg(*[F.count_if(F.col("way") == w).alias(f"in_{w}") for w in ("ab", "ba")], *[F.count_if((F.col("way") == w) & seen).alias(f"v_{w}") for w in ("ab", "ba")], *[F.count_if((F.col("way") == w) & held).alias(f"h_{w}") for w in ("ab", "ba")])
    both = (F.col("h_ab") > 0) & (F.col("h_ba") > 0)
    c = each.groupBy(scene, "a", "b").agg(*[F.sum(f"{k}_{w}").alias(f"{k}_{w}") for k in ("in", "v", "h") for w in ("ab", "ba")], F.count_if(both).alias("shared"))
    ratio = lambda x, y: F.col(x) / F.greatest(F.lit(1), F.col(y))
    out = c.select(
        scene, "a", "b", ratio("v_ab", "in_ab").alias("visible_ab"), ratio("v_ba", "in_ba").alias("visible_ba"), ratio("h_ab", "v_ab").alias("inside_ab"), ratio("h_ba", "v_ba").alias("inside_ba"), "shared",
        (F.col("shared") / F.greatest(F.lit(1), F.col("h_ab") + F.col("h_ba") - F.col("shared"))).alias("visible_iou"), (F.col("shared") / F.greatest(F.lit(1), F.least("h_ab", "h_ba"))).alias("visible_containment"),
    )
    return out.withColumns({"depth_consistency": F.least("visible_ab", "visible_ba"), "mask_consistency": F.least("inside_ab", "inside_ba")})


def pair_relation(depth: DataFrame, visible: DataFrame, scene: str = "scene", least_valid: int = 5, least_share: float = 0.15, conflict_points: int = 3, support: float = 0.65) -> DataFrame:
    """(scene, a, b, judgeable, hard_conflict, support_score, relation) of pairs, from both directions' depths and what they see of one another.

    A direction can be judged with enough valid points, in number and share. A hard conflict is a direction in which 0.6 of enough points inside the mask
    disagree, or 0.4 in both. relation, the first that holds: conflict, same_object (depths agree, views overlap, support_score), containment, weak_support (any overlap),
    uncertain.
    """
    names = ("input", "valid", "inside", "consistent_ratio", "inside_consistent_ratio", "inside_conflict_ratio")
    way = lambda s, d, mark: depth.select(scene, F.col("src").alias(s), F.col("dst").alias(d), *[F.col(n).alias(f"{n}_{mark}") for n in names])
    p = visible.join(way("a", "b", "x"), [scene, "a", "b"]).join(way("b", "a", "y"), [scene, "a", "b"])
    c = F.col
    both = lambda f: f("x") & f("y")
    judgeable = both(lambda m: (c(f"valid_{m}") >= least_valid) & (c(f"valid_{m}") >= c(f"input_{m}") * least_share))
    against = lambda share: lambda m: (c(f"inside_{m}") >= conflict_points) & (c(f"inside_conflict_ratio_{m}") >= share)
    hard = against(0.6)("x") | against(0.6)("y") | both(against(0.4))
    lower = lambda n: F.least(c(f"{n}_x"), c(f"{n}_y"))
    score = 0.35 * F.least(F.lit(1.0), c("visible_iou") / 0.2) + 0.25 * F.least(F.lit(1.0), c("visible_containment") / 0.5) + 0.25 * lower("consistent_ratio") + 0.15 * lower("inside_consistent_ratio")
    p = p.select(scene, "a", "b", judgeable.alias("judgeable"), hard.alias("hard_conflict"), score.alias("support_score"), "visible_iou", "visible_containment", lower("consistent_ratio").alias("__c"), lower("inside_consistent_ratio").alias("__i"))
    same = c("judgeable") & (c("__c") >= 0.75) & (c("__i") >= 0.60) & ((c("visible_iou") >= 0.08) | (c("visible_containment") >= 0.45)) & (c("support_score") >= support)
    relation = F.when(c("hard_conflict"), "conflict").when(same, "same_object").when(c("visible_containment") >= 0.5, "containment").when(c("visible_iou") > 0, "weak_support").otherwise("uncertain")
    return p.select(scene, "a", "b", "judgeable", "hard_conflict", "support_score", relation.alias("relation"))


def bucket_pairs(members: DataFrame, segment: str, id_col: str, frame: str, confidence: str, cap: int, exact: bool = True) -> DataFrame:
    """(a, b), a < b: pairs of rows of different frames that meet in a segment whose bucket holds at most cap rows.

    exact: rows arrive in order of id, meet what the bucket holds then, and the least confident (the latest on a tie) leaves a full bucket, so
    what came early keeps its pairs; a segment is scanned by one task that holds cap rows and makes at most cap pairs a row. Otherwise the
    cap most confident rows of a segment meet one another. Null frames differ from all others, null confidences are least.
    """
    rows = members.where(F.col(segment).isNotNull() & F.col(id_col).isNotNull())
    if not exact:
        top = top_k(rows, [segment], [F.col(confidence).desc_nulls_last(), F.col(id_col)], cap).select(segment, F.col(id_col).alias("i"), F.col(frame).alias("f"))
        met = top.toDF(segment, "a", "fa").join(top.toDF(segment, "b", "fb"), segment).where((F.col("a") < F.col("b")) & ~(F.coalesce(F.col("fa") == F.col("fb"), F.lit(False))))
        return met.select("a", "b").distinct()
    kind = members.schema[id_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting: dict = {}  # id -> (confidence, arrival, frame) of what the bucket holds
        a, b = [], []
        for at, (i, f, s) in enumerate(sorted(zip(pdf[id_col], pdf[frame], pdf[confidence].fillna(-np.inf)), key=lambda r: r[0])):
            met = [j for j, (_, _, other) in waiting.items() if j != i and not f == other]
            a += [min(i, j) for j in met]
            b += [max(i, j) for j in met]
            waiting[i] = (s, -at, f)
            if len(waiting) > cap:
                waiting.pop(min(waiting, key=lambda j: waiting[j][:2]))
        return pd.DataFrame({"a": a, "b": b})

    return grouped_kernel(rows.select(segment, id_col, frame, confidence), [segment], f"a {kind}, b {kind}", run).distinct()
