"""Votes, evidence and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_vote(votes: DataFrame, key: list[str], label: str, background: int) -> DataFrame:
    """(key, label, share): the most frequent label over 0 of each key; share over all votes, those without a label (-1) included.

    A tie goes to the smallest label; without any label it is background, share 0.
    """
    counts = votes.groupBy(*key, label).agg(F.count(F.lit(1)).alias("__c"))
    best = F.max_by(F.struct(F.col(label).alias("l"), F.col("__c").alias("c")), F.when(F.col(label) >= 0, F.struct("__c", -F.col(label))))
    out = counts.groupBy(*key).agg(F.sum("__c").alias("__n"), best.alias("__b"))
    return out.select(*key, F.coalesce("__b.l", F.lit(background)).alias(label), F.coalesce(F.col("__b.c") / F.col("__n"), F.lit(0.0)).alias("share"))


def label_distribution(votes: DataFrame, key: list[str], label: str) -> DataFrame:
    """(key, label, weight): counts of labels from 0 over the largest count of the key."""
    counts = votes.where(F.col(label) >= 0).groupBy(*key, label).agg(F.count(F.lit(1)).alias("__c"))
    return counts.select(*key, label, (F.col("__c") / F.max("__c").over(Window.partitionBy(*key))).alias("weight"))


def label_consensus(evidence: DataFrame, key: list[str], label: str, value: str, target: str) -> DataFrame:
    """Agreement of weighted evidence with the target label of each key.

    (key, label_consensus_score, label_conflict_score, label_margin, label_entropy, total_evidence, top_conflict, top_conflict_evidence):
    share of evidence for the target, the rest, lead over the strongest other label, and the entropy of the shares over log(max(2, labels)).
    Keys without positive evidence give no row. A tie of conflicts goes to the smallest label.
    """
    each = evidence.groupBy(*key, target, label).agg(F.sum(value).alias("__e"))
    w = Window.partitionBy(*key)
    each = each.withColumn("__total", F.sum("__e").over(w)).where("__total > 0").withColumn("__p", F.col("__e") / F.col("__total"))
    other = F.col(label) != F.col(target)
    out = each.groupBy(*key).agg(
        F.sum(F.when(~other, F.col("__e")).otherwise(0.0)).alias("__t"), F.first("__total").alias("total_evidence"), F.count(F.lit(1)).alias("__k"),
        F.sum(-F.col("__p") * F.log(F.greatest("__p", F.lit(1e-12)))).alias("__h"), F.max_by(F.struct(F.col(label).alias("l"), F.col("__e").alias("e")), F.when(other, F.struct("__e", -F.col(label)))).alias("__c"),
    )
    consensus = F.col("__t") / F.col("total_evidence")
    against = F.coalesce(F.col("__c.e"), F.lit(0.0))
    return out.select(
        *key, consensus.alias("label_consensus_score"), F.greatest(F.lit(0.0), 1 - consensus).alias("label_conflict_score"), ((F.col("__t") - against) / F.col("total_evidence")).alias("label_margin"),
        (F.col("__h") / F.log(F.greatest(F.lit(2), F.col("__k")).cast("double"))).alias("label_entropy"), "total_evidence", F.col("__c.l").alias("top_conflict"), against.alias("top_conflict_evidence"),
    )


def noisy_or(evidence: DataFrame, key: list[str], confidence: str) -> DataFrame:
    """(key, evidence): 1 - product of (1 - c) over confidences in [0, 1]; nulls are left out, none at all gives 0."""
    return evidence.groupBy(*key).agg(F.coalesce(1 - F.product(1 - F.col(confidence)), F.lit(0.0)).alias("evidence"))


def rescore(best: DataFrame, key: list[str], label: str, value: str, current: str, least: float, margin: float) -> DataFrame:
    """(key, current, best_label, best, second, decision): whether each key's label is replaced by its best-supported one.

    Reasons in order: keep_same (it is the best), weak (best below least), margin (lead over the second too small), replace.
    """
    by = Window.partitionBy(*key).orderBy(F.col(value).desc(), F.col(label))
    two = best.withColumn("__place", F.row_number().over(by)).where("__place <= 2")
    out = two.groupBy(*key, current).agg(
        F.max(F.when(F.col("__place") == 1, F.col(label))).alias("best_label"), F.max(F.when(F.col("__place") == 1, F.col(value))).alias("best"), F.coalesce(F.max(F.when(F.col("__place") == 2, F.col(value))), F.lit(0.0)).alias("second")
    )
    decision = F.when(F.col("best_label") == F.col(current), "keep_same").when(F.col("best") < least, "weak").when(F.col("best") - F.col("second") < margin, "margin").otherwise("replace")
    return out.withColumn("decision", decision)


def point_vote(rows: DataFrame, key: list[str], item: str, weight: str, least_weight: float, least_views: int, view: str) -> DataFrame:
    """(key, item, weight, views): items whose summed weight and number of views reach the limits; with several views at least two."""
    each = rows.groupBy(*key, item).agg(F.sum(weight).alias("weight"), F.count_distinct(view).alias("views"))
    total = rows.groupBy(*key).agg(F.count_distinct(view).alias("all_views"))
    need = F.greatest(F.lit(least_views), F.when(F.col("all_views") > 1, 2).otherwise(1))
    return each.join(total, key).where((F.col("weight") >= least_weight) & (F.col("views") >= need)).select(*key, item, "weight", "views")


def rule_effect(rows: DataFrame, fires: str, before: str, after: str, truth: str) -> DataFrame:
    """(fired, helpful, harmful, neutral, net): what a rule that replaces labels does where it fires."""
    hit = rows.where(F.col(fires))
    good = (F.col(after) == F.col(truth)) & (F.col(before) != F.col(truth))
    bad = (F.col(before) == F.col(truth)) & (F.col(after) != F.col(truth))
    out = hit.agg(F.count(F.lit(1)).alias("fired"), F.count_if(good).alias("helpful"), F.count_if(bad).alias("harmful"))
    return out.select("*", (F.col("fired") - F.col("helpful") - F.col("harmful")).alias("neutral"), (F.col("helpful") - F.col("harmful")).alias("net"))
