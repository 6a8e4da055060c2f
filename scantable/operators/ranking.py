"""Ranks, thresholds and samples within groups. Ties are always broken by an id, so a result is the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scantable.common import distributed_rank, with_group_totals


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group with their place; Spark cuts groups to k rows in each task before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def threshold_or_best(df: DataFrame, group: list[str], score: str, least: float, id_col: str) -> DataFrame:
    """Rows with a score of at least so much; where a group has none, its best row. Null scores are below everything."""
    best = df.groupBy(*group).agg(F.max_by(id_col, F.struct(score, -F.col(id_col))).alias("__best"), F.max(F.coalesce(F.col(score) >= least, F.lit(False))).alias("__any"))
    out = df.join(best, group)
    return out.where(F.when(F.col("__any"), F.col(score) >= least).otherwise(F.col(id_col) == F.col("__best"))).select(*df.columns)


def score_modes(df: DataFrame, group: list[str], score: str, modes: dict[str, str]) -> DataFrame:
    """df with a column per entry of modes (name -> mode): uniform (1), native, or calibrated.

    calibrated lies between the least and largest score of the group, 1 where they are equal.
    """
    if "calibrated" in modes.values():
        df = with_group_totals(df, group, F.min(score).alias("__low"), F.max(score).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    made = {
        "uniform": lambda: F.lit(1.0), "native": lambda: F.col(score),
        "calibrated": lambda: F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0)),
    }
    return df.withColumns({name: made[mode]() for name, mode in modes.items()}).drop("__low", "__high")


def relative_threshold(df: DataFrame, group: list[str], score: str, share: float, keep: float, id_col: str) -> DataFrame:
    """Rows that reach a share of their group's best score, and in any case the first keep share of the group, rounded up.

    Places are exact and distributed: a hot group isn't brought into one task. Null scores come last.
    """
    out = distributed_rank(with_group_totals(df, group, F.max(score).alias("__best"), F.count(F.lit(1)).alias("__n")), group, [F.col(score).desc_nulls_last(), F.col(id_col).asc()], "__place")
    return out.where((F.col(score) >= F.col("__best") * share) | (F.col("__place") <= F.ceil(F.col("__n") * keep))).select(*df.columns)


def review_list(df: DataFrame, id_col: str, lists: list[tuple[str, Column, int]]) -> DataFrame:
    """(id, reasons): union of several short lists - (reason, order, length) - with the reasons of a row together."""
    parts = None
    for reason, order, n in lists:
        one = df.orderBy(order, id_col).limit(n).select(id_col, F.lit(reason).alias("reason"))
        parts = one if parts is None else parts.union(one)
    return parts.groupBy(id_col).agg(F.concat_ws(";", F.array_sort(F.collect_set("reason"))).alias("reasons"))


def every_nth(df: DataFrame, group: list[str], order: str, stride: int, most: int | None = None) -> DataFrame:
    """Every stride-th row of each group in order, from the first; at most so many."""
    out = distributed_rank(df, group, [F.col(order)], "__at").withColumn("__at", F.col("__at") - 1).where(F.col("__at") % stride == 0)
    if most is not None:
        out = out.where(F.col("__at") < stride * most)
    return out.drop("__at")


def natural_order(name: str) -> list[Column]:
    """Order of names by their first number, then as text."""
    return [F.regexp_extract(name, r"(\d+)", 1).try_cast("long").asc_nulls_first(), F.col(name).asc()]


def seeded_splits(ids: DataFrame, id_col: str, seed: int, small: int = 48, large: int = 96) -> DataFrame:
    """(id, split flags even_small, even_large, odd_large): reproducible, nested and disjoint subsets by hash order.

    even_small lies in even_large; odd_large is disjoint from it. Fewer than 2 x large ids raise ValueError.
    """
    known = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    if known.limit(2 * large).count() < 2 * large:
        raise ValueError(f"Need at least {2 * large} ids")
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.col(id_col).cast("string")))
    first = known.orderBy(order, id_col).limit(2 * large)
    place = F.row_number().over(Window.orderBy(order, F.col(id_col)))
    out = first.select(id_col, place.alias("p"))
    return out.select(id_col, (F.col("p") <= small).alias("even_small"), (F.col("p") <= large).alias("even_large"), (F.col("p") > large).alias("odd_large"))


def with_group_z(df: DataFrame, group: list[str], value: str, name: str = "z", fallback: list[str] | None = None, least: int = 0) -> DataFrame:
    """df with the z-score within the group (population deviation; 0 where it is below 1e-6), within fallback if the group has fewer values."""

    def z(mark: str) -> Column:
        dev = F.col(f"__dev{mark}")
        return F.when(dev < 1e-6, F.lit(0.0)).otherwise((F.col(value) - F.col(f"__mean{mark}")) / dev)

    stats = lambda mark: (F.stddev_pop(value).alias(f"__dev{mark}"), F.avg(value).alias(f"__mean{mark}"), F.count(value).alias(f"__n{mark}"))
    out = with_group_totals(df, group, *stats("a"))
    if fallback is None:
        return out.withColumn(name, z("a")).select(*[c for c in df.columns if c != name], name)
    out = with_group_totals(out, fallback, *stats("b"))
    return out.withColumn(name, F.when(F.col("__na") >= least, z("a")).otherwise(z("b"))).select(*[c for c in df.columns if c != name], name)
