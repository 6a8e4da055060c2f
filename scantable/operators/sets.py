"""Overlap of sets, partitions and segments, on one row per (set, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_sets(df: DataFrame, values: str, *keys: str, name: str = "item") -> DataFrame:
    """keys and one row per distinct non-negative element; null, empty and negative elements give no row."""
    return df.select(*keys, F.explode(values).alias(name)).where(F.col(name) >= 0).distinct()


def overlap_pairs(a: DataFrame, b: DataFrame, block: list[str], a_id: str, b_id: str, item: str = "item", extra: Column | None = None) -> DataFrame:
    """Sizes and overlaps of all pairs of sets of a and b that share an item in the same block.

    a: block, a_id, item; b: block, b_id, item; rows distinct. (block, a_id, b_id, inter, size_a, size_b, iou, containment,
    cover_a, cover_b): containment over the smaller set, cover over each. extra: a condition on the ids. Pairs without
    a common item don't come out: they are never formed, as the join is on (block, item). Counts are combined before the
    shuffle, and AQE splits an item that is in very many sets.
    """
    on = [*block, item]
    met = a.select(*on, a_id).join(b.select(*on, b_id), on)
    if extra is not None:
        met = met.where(extra)
    shared = met.groupBy(*block, a_id, b_id).agg(F.count(F.lit(1)).alias("inter"))
    size_a = a.groupBy(*block, a_id).agg(F.count(F.lit(1)).alias("size_a"))
    size_b = b.groupBy(*block, b_id).agg(F.count(F.lit(1)).alias("size_b"))
    out = shared.join(size_a, [*block, a_id]).join(size_b, [*block, b_id])
    inter, sa, sb = F.col("inter"), F.col("size_a"), F.col("size_b")
    return out.select(
        *block, a_id, b_id, "inter", "size_a", "size_b", (inter / (sa + sb - inter)).alias("iou"), (inter / F.least(sa, sb)).alias("containment"), (inter / sa).alias("cover_a"), (inter / sb).alias("cover_b")
    )


def similar_pairs(sets: DataFrame, block: list[str], id_col: str, threshold: float, item: str = "item") -> DataFrame:
    """(block, a, b, inter, size_a, size_b, iou) of all pairs a < b of sets of a block with an IoU above threshold, exactly.

    sets: block, id_col, item; rows distinct. Two such sets share one of the rarest items of each: of n items, the
    n - ceil(threshold n) + 1 that are in the fewest sets. Pairs meet on those, so an item that very many sets hold is joined only
    where a set has hardly any other; sizes that exclude the threshold drop out, and what is left is counted over all items.
    """
    held = sets.groupBy(*block, item).agg(F.count(F.lit(1)).alias("__f"))
    own = sets.groupBy(*block, id_col).agg(F.count(F.lit(1)).alias("__n"))
    rare = sets.join(held, [*block, item]).withColumn("__r", F.row_number().over(Window.partitionBy(*block, id_col).orderBy("__f", item))).join(own, [*block, id_col])
    # the margin keeps rounding on the side of more candidates
    rare = rare.where(F.col("__r") <= F.col("__n") - F.ceil(F.col("__n") * threshold - 1e-9) + 1).select(*block, item, F.col(id_col).alias("a"), F.col("__n").alias("size_a"))
    other = rare.select(*block, item, F.col("a").alias("b"), F.col("size_a").alias("size_b"))
    fits = (F.col("a") < F.col("b")) & (F.least("size_a", "size_b") > F.greatest("size_a", "size_b") * (threshold - 1e-9))
    pairs = rare.join(other, [*block, item]).where(fits).select(*block, "a", "b", "size_a", "size_b").distinct()
    side = lambda c: sets.select(*block, F.col(id_col).alias(c), item)
    met = pairs.join(side("a"), [*block, "a"]).join(side("b"), [*block, "b", item])
    out = met.groupBy(*block, "a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("inter"))
    out = out.withColumn("iou", F.col("inter") / (F.col("size_a") + F.col("size_b") - F.col("inter"))).where(F.col("iou") > threshold)
    return out.select(*block, "a", "b", "inter", "size_a", "size_b", "iou")


def best_match(pairs: DataFrame, left: DataFrame, keys: list[str], other: str, by: str = "iou") -> DataFrame:
    """Every row of left with its best partner: the largest by, then the smallest other; id -1 and 0 without one."""
    best = pairs.groupBy(*keys).agg(F.max_by(F.struct(F.col(other).alias("o"), F.col(by).alias("v")), F.struct(F.col(by), -F.col(other))).alias("__best"))
    return left.select(*keys).join(best, keys, "left").select(*keys, F.coalesce("__best.o", F.lit(-1)).cast("long").alias(other), F.coalesce("__best.v", F.lit(0.0)).alias(by))


def partition_overlap(rows: DataFrame, block: list[str], ref: str, cmp: str) -> DataFrame:
    """How a second partition splits and merges the cells of a first one, per block.

    (block, reference_segments, compared_segments, split_reference_segments, split_reference_points, merged_compared_segments,
    merged_compared_points, point_count). A row with a null cell is left out.
    """
    cells = rows.where(F.col(ref).isNotNull() & F.col(cmp).isNotNull()).groupBy(*block, ref, cmp).agg(F.count(F.lit(1)).alias("__n"))
    side = lambda key, names: cells.groupBy(*block, key).agg(F.count(F.lit(1)).alias("__k"), F.sum("__n").alias("__n")).groupBy(*block).agg(
        F.count(F.lit(1)).alias(names[0]), F.count_if(F.col("__k") > 1).alias(names[1]), F.sum(F.when(F.col("__k") > 1, F.col("__n")).otherwise(0)).alias(names[2]), F.sum("__n").alias(names[3])
    )
    refs = side(ref, ("reference_segments", "split_reference_segments", "split_reference_points", "point_count"))
    cmps = side(cmp, ("compared_segments", "merged_compared_segments", "merged_compared_points", "__m")).drop("__m")
    return refs.join(cmps, block) if block else refs.crossJoin(F.broadcast(cmps))


def purity(rows: DataFrame, block: list[str], segment: str, target: str, threshold: float = 0.95) -> DataFrame:
    """(block, segment, n, majority_label, majority_share, is_mixed): the most frequent non-negative target of each segment.

    Negative and null targets count in n but can't be the majority; a tie goes to the smallest. Without a majority the label is
    -1 and the share 0.
    """
    counts = rows.groupBy(*block, segment, target).agg(F.count(F.lit(1)).alias("__c"))
    best = F.max_by(F.struct(F.col(target).alias("t"), F.col("__c").alias("c")), F.when(F.col(target) >= 0, F.struct("__c", -F.col(target))))
    out = counts.groupBy(*block, segment).agg(F.sum("__c").alias("n"), best.alias("__b"))
    share = F.coalesce(F.col("__b.c"), F.lit(0)) / F.col("n")
    out = out.select(*block, segment, "n", F.coalesce("__b.t", F.lit(-1)).alias("majority_label"), share.alias("majority_share"))
    return out.withColumn("is_mixed", F.col("majority_share") < threshold)


def purity_summary(pure: DataFrame, block: list[str]) -> DataFrame:
    """(block, segments, mixed_segments, mixed_points, weighted_purity) of purity()."""
    return pure.groupBy(*block).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if("is_mixed").alias("mixed_segments"), F.sum(F.when(F.col("is_mixed"), F.col("n")).otherwise(0)).alias("mixed_points"),
        (F.sum(F.col("n") * F.col("majority_share")) / F.sum("n")).alias("weighted_purity"),
    )


def segment_sizes(rows: DataFrame, block: list[str], segment: str, limits: tuple[int, ...] = (10, 50)) -> DataFrame:
    """(block, segments, mean, median, p90, p99, max, and over_L per limit) of segment sizes; percentiles interpolate."""
    sizes = rows.groupBy(*block, segment).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*block).agg(
        F.count(F.lit(1)).alias("segments"), F.avg("n").alias("mean_size"), *[F.percentile("n", p).alias(a) for p, a in ((0.5, "median_size"), (0.9, "p90_size"), (0.99, "p99_size"))], F.max("n").alias("max_size"),
        *[F.count_if(F.col("n") > limit).alias(f"over_{limit}") for limit in limits],
    )


def segment_coverage(rows: DataFrame, segments: DataFrame, keys: list[str], segment: str, core: float = 0.8, partial: float = 0.3) -> DataFrame:
    """(keys, segment, hits, size, coverage, band): share of each segment that a set covers, as core, partial or weak.

    rows: keys (block first), segment, one row per covered item; segments: block, segment, size.
    """
    hits = rows.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("hits"))
    out = hits.join(segments, [keys[0], segment]).withColumn("coverage", F.col("hits") / F.col("size"))
    band = F.when(F.col("coverage") >= core, "core").when(F.col("coverage") >= partial, "partial").otherwise("weak")
    return out.select(*keys, segment, "hits", "size", "coverage", band.alias("band"))


def weighted_jaccard(a: DataFrame, b: DataFrame, keys: list[str], cell: str, weight: str) -> DataFrame:
    """(keys, overlap_mass, union_mass, jaccard): sums of the smaller and larger weight per cell over both sides."""
    x = a.groupBy(*keys, cell).agg(F.sum(weight).alias("__wa"))
    y = b.groupBy(*keys, cell).agg(F.sum(weight).alias("__wb"))
    both = x.join(y, [*keys, cell], "full").select(*keys, F.coalesce("__wa", F.lit(0.0)).alias("__wa"), F.coalesce("__wb", F.lit(0.0)).alias("__wb"))
    out = both.groupBy(*keys).agg(F.sum(F.least("__wa", "__wb")).alias("overlap_mass"), F.sum(F.greatest("__wa", "__wb")).alias("union_mass"))
    return out.withColumn("jaccard", F.col("overlap_mass") / F.nullif(F.col("union_mass"), F.lit(0.0)))


def own_segments(claims: DataFrame, keys: list[str], owner: str, weight: str, ratio: float = 0.9) -> DataFrame:
    """(keys, owner): who owns each cell - the largest claim, nobody if the second comes within the ratio of it."""
    by = Window.partitionBy(*keys).orderBy(F.col(weight).desc(), F.col(owner))
    ranked = claims.select(*keys, owner, weight, F.row_number().over(by).alias("__place")).where("__place <= 2")
    two = ranked.groupBy(*keys).agg(F.max(F.when(F.col("__place") == 1, F.col(weight))).alias("__w1"), F.max(F.when(F.col("__place") == 2, F.col(weight))).alias("__w2"), F.max(F.when(F.col("__place") == 1, F.col(owner))).alias(owner))
    return two.where(F.col("__w2").isNull() | (F.col("__w2") < F.col("__w1") * ratio)).select(*keys, owner)


def shared_cells(rows: DataFrame, frame: list[str], cell: list[str], track: str, least: int) -> DataFrame:
    """rows without the cells that two or more tracks share in a frame, where the frame has at least so many of them."""
    crowded = rows.groupBy(*frame, *cell).agg(F.count_distinct(track).alias("__k")).where("__k >= 2")
    total = crowded.groupBy(*frame).agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") >= least)
    return rows.join(crowded.join(total, frame, "left_semi").select(*frame, *cell), [*frame, *cell], "left_anti")


def smallest_owner(masks: DataFrame, cell: list[str], area: str, label: str) -> DataFrame:
    """(cell, label): every cell belongs to the smallest of the masks over it; a tie to the smallest label."""
    return masks.groupBy(*cell).agg(F.min_by(label, F.struct(area, label)).alias(label))
