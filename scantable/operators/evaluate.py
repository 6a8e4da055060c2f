"""Average precision of scored point sets against labelled instances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scantable.common import cut, distributed_rank, running_totals, small_or_not
from scantable.operators.greedy import grouped_kernel

#: fixed values: IoU thresholds of the benchmark; the first is reported alone and not averaged
OVERLAPS = (0.25, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)


def labelled_instances(points: DataFrame, valid: DataFrame, label: str = "label", base: int = 1000) -> DataFrame:
    """(scene, gt_id, class_id, gt_n): the instances of points whose label is class * base + number; 0 and other classes are none."""
    out = points.where(F.col(label) > 0).groupBy("scene", F.col(label).alias("gt_id")).agg(F.count(F.lit(1)).alias("gt_n"))
    kind = valid.schema["class_id"].dataType
    return out.withColumn("class_id", F.floor(F.col("gt_id") / base).cast(kind)).join(small_or_not(valid.select("class_id")), "class_id", "left_semi").select("scene", "gt_id", "class_id", "gt_n")


def assign(pred_points: DataFrame, preds: DataFrame, gt_points: DataFrame, gts: DataFrame, valid: DataFrame, region: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, instances, pairs) ready for matching.

    pred_points: scene, pred_id, point; preds: scene, pred_id, class_id, score; gt_points: scene, point, gt_id (a point
    belongs to one instance; points of no valid class are void); gts: scene, gt_id, class_id; valid: class_id. Predictions under
    region points, without score, or of no valid class are left out; pairs share a point and the class. Predictions carry their void points.
    Points are joined once and counted per prediction and instance; all else follows from these counts.
    """
    cells = pred_points.join(gt_points, ["scene", "point"], "left").groupBy("scene", "pred_id", "gt_id").agg(F.count(F.lit(1)).alias("inter"))
    sizes = gt_points.groupBy("scene", "gt_id").agg(F.count(F.lit(1)).alias("gt_n"))
    known = gts.join(valid, "class_id", "left_semi")
    instances = cut(known.join(sizes, ["scene", "gt_id"]).select("scene", "gt_id", "class_id", "gt_n"))
    met = cells.join(instances.withColumnRenamed("class_id", "gt_class"), ["scene", "gt_id"], "left")
    held = F.collect_list(F.when(F.col("gt_n").isNotNull(), F.struct("gt_id", "gt_class", "gt_n", "inter")))  # the instances a prediction meets
    of = met.groupBy("scene", "pred_id").agg(F.sum("inter").alias("n"), F.sum(F.when(F.col("gt_n").isNull(), F.col("inter")).otherwise(0)).alias("void"), held.alias("met"))
    asked = preds.where(F.col("score").isNotNull()).join(valid, "class_id", "left_semi")
    both = cut(asked.join(of.where(F.col("n") >= region), ["scene", "pred_id"]).select("scene", "pred_id", "class_id", "score", "n", "void", "met"))
    iou = F.col("m.inter") / (F.col("n") + F.col("m.gt_n") - F.col("m.inter"))
    pairs = both.select("scene", "pred_id", "class_id", "score", "n", "void", F.explode("met").alias("m")).where("m.gt_class = class_id")
    pairs = pairs.select("scene", "m.gt_id", "class_id", "pred_id", "m.inter", iou.alias("iou"), "score", "n", "void", "m.gt_n")
    return both.drop("met"), instances, pairs


def match(good: DataFrame, instances: DataFrame, pairs: DataFrame, region: int, overlaps: tuple[float, ...] = OVERLAPS, groups_below: int | None = None) -> DataFrame:
    """(class_id, overlap, score, positive): scored outcomes; a NULL score is an instance nobody matched.

    Instances in order of id take predictions in order of id that overlap by more than the threshold and weren't taken; a second one for
    the same instance makes the lower score a false positive and stays free. Predictions that overlap no instance enough are false
    positives unless void points, points of small instances and of groups (ids below groups_below) make up more than the threshold of them. As instances are
    disjoint, a prediction rarely reaches two of them, never from a threshold of 0.5 on: where none does, an instance's best
    score is the match and the others are false positives, by aggregation. Only scenes and classes with such a conflict go to
    the ordered kernel, which gets the hits of one scene and class.
    """
    grid = F.explode(F.array(*[F.lit(float(o)) for o in overlaps])).alias("overlap")
    reached = F.filter(F.array(*[F.lit(float(o)) for o in overlaps]), lambda o: o < F.col("iou"))
    hits = cut(pairs.where(F.col("gt_n") >= region).select("scene", "class_id", "gt_id", "pred_id", "score", F.explode(reached).alias("overlap")))
    key = ["scene", "class_id", "overlap"]
    torn = small_or_not(cut(hits.where("overlap < 0.5").groupBy(*key, "pred_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*key).distinct()))
    place = F.row_number().over(Window.partitionBy(*key, "gt_id").orderBy(F.desc("score")))
    easy = hits.join(torn, key, "left_anti").select(*key, "gt_id", "score", (place == 1).cast("int").alias("positive"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gt_id", "pred_id"])
        taken: set = set()
        held: dict = {}
        out = []
        for gt, p, s in zip(pdf.gt_id, pdf.pred_id, pdf.score):
            if p in taken:
                continue
            if gt not in held:
                held[gt] = s
                taken.add(p)
            else:
                out.append((gt, min(held[gt], s), 0))
                held[gt] = max(held[gt], s)
        out += [(gt, s, 1) for gt, s in held.items()]
        res = pd.DataFrame(out, columns=["gt_id", "score", "positive"])
        for at, k in enumerate(key):
            res.insert(at, k, pdf[k].iloc[0])
        return res

    id_type = instances.schema["gt_id"].dataType.simpleString()
    class_type = instances.schema["class_id"].dataType.simpleString()
    scene_type = instances.schema["scene"].dataType.simpleString()
    hard = grouped_kernel(hits.join(torn, key, "left_semi"), key, f"scene {scene_type}, class_id {class_type}, overlap double, gt_id {id_type}, score double, positive int", run)
    outcomes = cut(easy.unionByName(hard))
    matched = outcomes.where("positive = 1").select("scene", "gt_id", "overlap")
    lone = instances.where(F.col("gt_n") >= region).select("scene", "class_id", "gt_id", grid).join(matched, ["scene", "gt_id", "overlap"], "left_anti")
    aside = F.col("gt_n") < region
    if groups_below is not None:
        aside = aside | (F.col("gt_id") < groups_below)
    enough = pairs.groupBy("scene", "pred_id").agg(F.max("iou").alias("best"), F.sum(F.when(aside, F.col("inter")).otherwise(0)).alias("small"))
    rest = good.join(enough, ["scene", "pred_id"], "left").select("class_id", "score", "best", "void", "small", "n", grid)
    ignored = (F.col("void") + F.coalesce("small", F.lit(0))) / F.col("n")
    wrong = rest.where((F.coalesce("best", F.lit(0.0)) <= F.col("overlap")) & (ignored <= F.col("overlap")))
    return (
        outcomes.select("class_id", "overlap", "score", "positive")
        .unionByName(lone.select("class_id", "overlap", F.lit(None).cast("double").alias("score"), F.lit(1).alias("positive")))
        .unionByName(wrong.select("class_id", "overlap", "score", F.lit(0).alias("positive")))
    )


def precision_recall(outcomes: DataFrame, key: list[str]) -> DataFrame:
    """(key, score, t, c, tp, n, total, precision, recall): the curve over distinct scores, from the highest.

    t and c: positives and outcomes of this very score; unmatched instances count in recall only. Scores are counted before
    the curve is run through, and it is run through in parts: a key of all outcomes doesn't gather in one task.
    """
    truth = cut(outcomes.groupBy(*key).agg(F.sum("positive").alias("total")))
    each = outcomes.where("score is not null").groupBy(*key, "score").agg(F.sum("positive").alias("t"), F.count(F.lit(1)).alias("c"))
    curve = running_totals(each, key, [F.desc("score")], {"tp": ("sum", "t"), "n": ("sum", "c")})
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    out = curve.join(small_or_not(truth), key) if key else curve.crossJoin(F.broadcast(truth))
    return out.select(*key, "score", "t", "c", "tp", "n", "total", (F.col("tp") / F.col("n")).alias("precision"), recall.alias("recall"))


def _before(value: Column, own: Column, n: Column, c: Column, first: float) -> Column:
    """The ratio at the next higher score: what was reached without the outcomes of this one."""
    return F.coalesce((value - own) / F.nullif(n - c, F.lit(0)), F.lit(first))


def average_precision(outcomes: DataFrame, key: list[str]) -> DataFrame:
    """(key, ap): area under the curve by half steps of recall to both neighbours, the curve ending at precision 1, recall 0.

    0 with instances but no outcome, NULL without instances. In closed form: each score's positives weigh the mean of the precision
    there and at the next higher score, so neighbours in the curve needn't meet.
    """
    outcomes = cut(outcomes.select(*key, "score", "positive"))
    c = F.col
    mean = (c("precision") + _before(c("tp"), c("t"), c("n"), c("c"), 1.0)) / 2
    area = precision_recall(outcomes, key).groupBy(*key).agg(F.sum(c("t") * mean / F.nullif(c("total"), F.lit(0))).alias("area"))
    has = outcomes.groupBy(*key).agg(F.sum("positive").alias("total"))
    return has.join(area, key, "left").select(*key, F.when(F.col("total") > 0, F.coalesce("area", F.lit(0.0))).alias("ap"))


def average_recall(outcomes: DataFrame, key: list[str]) -> DataFrame:
    """(key, ar, top_recall): recall over half steps of recall, in the same closed form, and the largest recall."""
    c = F.col
    curve = precision_recall(cut(outcomes.select(*key, "score", "positive")), key)
    lower = (c("tp") - c("t")) / F.nullif(c("total"), F.lit(0))
    return curve.groupBy(*key).agg(F.sum(c("t") * (c("recall") + lower) / 2 / F.nullif(c("total"), F.lit(0))).alias("ar"), F.max("recall").alias("top_recall"))


def summary(ap: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, class_name, split, is_base, ap, ap50, ap25): per class; ap over the thresholds without 0.25."""
    out = ap.groupBy("class_id").agg(
        F.avg(F.when(F.col("overlap") > 0.25, F.col("ap"))).alias("ap"), F.max(F.when(F.col("overlap") == 0.5, F.col("ap"))).alias("ap50"), F.max(F.when(F.col("overlap") == 0.25, F.col("ap"))).alias("ap25")
    )
    return classes.join(out, "class_id", "left").select("class_id", F.col("name").alias("class_name"), "split", "is_base", "ap", "ap50", "ap25")


def averages(per_class: DataFrame) -> DataFrame:
    """(scope, classes, ap, ap50, ap25): means over all classes, each split, base and novel ones; classes without instances are left out."""
    scopes = F.array(F.lit("all"), F.concat(F.lit("split "), "split"), F.when(F.col("is_base"), "base").otherwise("novel"))
    each = per_class.select(F.explode(F.array_compact(scopes)).alias("scope"), "ap", "ap50", "ap25")
    return each.groupBy("scope").agg(F.count("ap50").alias("classes"), *[F.avg(c).alias(c) for c in ("ap", "ap50", "ap25")])


def _placed(rows: DataFrame, key: list[str], score: str, positive: str, id_col: str) -> DataFrame:
    """The positives with their place among all rows (n) and among the positives (tp), by score descending, then id."""
    order = [F.col(score).desc_nulls_last(), F.col(id_col).asc()]
    ranked = distributed_rank(rows.select(*key, score, id_col, positive), key, order, "n").where(F.col(positive) == 1)
    return distributed_rank(ranked, key, order, "tp")


def ranking_ap(rows: DataFrame, key: list[str], score: str, positive: str, id_col: str) -> DataFrame:
    """(key, ap): mean precision at the positives, by score descending, then id; 0 without positives."""
    hits = _placed(rows, key, score, positive, id_col).groupBy(*key).agg(F.avg(F.col("tp") / F.col("n")).alias("ap"))
    return rows.select(*key).distinct().join(hits, key, "left").select(*key, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def voc_ap(rows: DataFrame, key: list[str], score: str, positive: str, id_col: str, eleven: bool = False, total: DataFrame | None = None) -> DataFrame:
    """(key, ap): area under the envelope of precision - at each recall the largest precision at it or beyond.

    eleven: the mean of the envelope at recalls 0, 0.1, ..., 1 instead. total: key, total - positives to be found; by default
    those of the rows. Keys without a positive give 0.
    """
    placed = _placed(rows, key, score, positive, id_col).withColumn("p", F.col("tp") / F.col("n"))
    best = running_totals(placed, key, [F.desc("tp")], {"best": ("max", "p")})
    total = rows.groupBy(*key).agg(F.sum(positive).alias("total")) if total is None else total
    # a recall is reached from its first positive on: the envelope at r is that of the positive number ceil(r * total)
    marks = F.aggregate(F.sequence(F.lit(0), F.lit(10)), F.lit(0), lambda n, i: n + F.when(F.greatest(F.lit(1), F.ceil(i * F.col("total") / 10)) == F.col("tp"), 1).otherwise(0))
    weight = marks / F.lit(11.0) if eleven else F.lit(1.0) / F.col("total")
    area = best.join(total, key).groupBy(*key).agg(F.sum(F.col("best") * weight).alias("ap"))
    return rows.select(*key).distinct().join(area, key, "left").select(*key, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def box_outcomes(pairs: DataFrame, preds: DataFrame, key: list[str], overlaps: tuple[float, ...]) -> DataFrame:
    """(key, overlap, pred_id, score, positive): each predicted box against the true one it overlaps most.

    pairs: key, pred_id, gt_id, iou; preds: key, pred_id, score. A box is a hit if its overlap is above the threshold and no box of better
    score (then smaller id) is a hit of the same true box; a tie of overlaps goes to the smaller gt_id.
    """
    best = pairs.groupBy(*key, "pred_id").agg(F.max_by(F.struct("gt_id", "iou"), F.struct("iou", -F.col("gt_id"))).alias("b"))
    grid = F.explode(F.array(*[F.lit(float(o)) for o in overlaps])).alias("overlap")
    each = preds.join(best, [*key, "pred_id"], "left").select(*key, "pred_id", "score", F.col("b.gt_id").alias("gt_id"), F.coalesce("b.iou", F.lit(0.0)).alias("iou"), grid)
    hit = F.col("iou") > F.col("overlap")
    first = F.row_number().over(Window.partitionBy(*key, "overlap", "gt_id").orderBy(F.col("score").desc_nulls_last(), "pred_id"))
    hits = each.where(hit).select(*key, "overlap", "pred_id", "score", (first == 1).cast("int").alias("positive"))
    return hits.unionByName(each.where(~hit).select(*key, "overlap", "pred_id", "score", F.lit(0).alias("positive")))


def confusion(rows: DataFrame, target: str, pred: str, classes: DataFrame, ignore: tuple[int, ...] = ()) -> DataFrame:
    """(target, pred, n) on the whole class grid: missing cells are 0; ignored and unknown targets are left out.

    The grid has a row per pair of classes, of at most 5000 classes; more raise ValueError.
    """
    ids = classes.select("class_id").distinct()
    if ids.limit(5001).count() > 5000:
        raise ValueError("a grid of more than 5000 classes")
    grid = ids.select(F.col("class_id").alias(target)).crossJoin(F.broadcast(ids.select(F.col("class_id").alias(pred))))
    counts = rows.where(~F.col(target).isin(*ignore) if ignore else F.lit(True)).groupBy(target, pred).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [target, pred], "left").select(target, pred, F.coalesce("n", F.lit(0)).alias("n"))


def class_iou(matrix: DataFrame, target: str, pred: str) -> DataFrame:
    """(class_id, iou): diagonal over row and column sums less the diagonal; NULL for 0 / 0."""
    rows = matrix.groupBy(F.col(target).alias("class_id")).agg(F.sum("n").alias("r"), F.sum(F.when(F.col(target) == F.col(pred), F.col("n")).otherwise(0)).alias("d"))
    cols = matrix.groupBy(F.col(pred).alias("class_id")).agg(F.sum("n").alias("c"))
    return rows.join(cols, "class_id").select("class_id", (F.col("d") / F.nullif(F.col("r") + F.col("c") - F.col("d"), F.lit(0))).alias("iou"))


def binary_metrics(rows: DataFrame, score: str, positive: str, threshold: float = 0.5) -> DataFrame:
    """(n, accuracy, precision, recall, f1) of score >= threshold; denominators are at least 1, or 1e-12 for f1."""
    yes, true = F.col(score) >= threshold, F.col(positive) == 1
    c = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(~yes & ~true).alias("tn"))
    c = c.select("n", ((F.col("tp") + F.col("tn")) / F.greatest("n", F.lit(1))).alias("accuracy"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"))
    return c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))


def threshold_table(rows: DataFrame, score: str, positive: str, least_recall: float) -> DataFrame:
    """(threshold, precision, recall): of all score thresholds with enough recall the one of best precision, then most recall."""
    curve = precision_recall(rows.select(F.col(score).alias("score"), F.col(positive).alias("positive")), [])
    ok = curve.select(F.col("score").alias("threshold"), "precision", (F.col("tp") / F.greatest("total", F.lit(1))).alias("recall")).where(F.col("recall") >= least_recall)
    return ok.orderBy(F.col("precision").desc(), F.col("recall").desc(), F.col("threshold").desc()).limit(1)
