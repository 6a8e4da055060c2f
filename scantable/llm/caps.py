"""At most so many records per contributor: nested caps as a laminar matroid, kept greedily in ranked window passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scantable.common import distributed_rank, small_or_not, cut

#: Up to this cap Spark ranks within each map task before it shuffles (window group limit), so that a hot group sends
#: at most cap rows a task; beyond it, the exact distributed rank is used.
GROUP_LIMIT = 1000


@dataclass(frozen=True)
class Level:
    """One level of nested groups. Each level's columns must be a subset of the finer level's before it.

    cap: at most so many records. share: at most this share of all the records the group had at first, rounded down
    (at least one). With both, the smaller holds.
    """

    columns: tuple[str, ...]
    cap: int | None = None
    share: float | None = None


def laminar_caps(df: DataFrame, levels: list[Level], order: list[Column]) -> DataFrame:
    """The records that stay under all caps: the greedy optimum over the laminar matroid the nested groups form.

    Levels are given from the finest (author) to the coarsest (parent organisation). Each pass ranks the survivors of
    the pass before within its groups, by order, and keeps the first ones; as groups nest, this is the greedy choice.
    A null group value is a group of its own. End the order with a unique id: then ties are broken in the same way on
    every run. Repeated rows each count. Levels without cap and share change nothing. Extra columns are kept.
    """
    for fine, coarse in zip(levels, levels[1:]):
        if not set(coarse.columns) <= set(fine.columns):
            raise ValueError(f"{coarse.columns} isn't coarser than {fine.columns}")
    kept = df
    for level in levels:
        cols = list(level.columns)
        if level.share is None and level.cap is None:
            continue
        if level.share is None and level.cap <= GROUP_LIMIT:
            place = F.row_number().over(Window.partitionBy(*cols).orderBy(*order))
            kept = kept.withColumn("__place", place).where(F.col("__place") <= level.cap).drop("__place")
            continue
        most = F.lit(level.cap).cast("long") if level.cap is not None else F.lit(2**62)
        ranked = distributed_rank(kept, cols, order, "__place")
        if level.share is not None:
            sizes = cut(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__all")))
            sizes = sizes.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(cols)], "__all")
            match = F.lit(True)
            for i, c in enumerate(cols):
                match = match & F.col(c).eqNullSafe(F.col(f"__c{i}"))
            ranked = ranked.join(small_or_not(sizes), match)
            most = F.least(most, F.greatest(F.lit(1), F.floor(F.col("__all") * level.share)))
        kept = ranked.where(F.col("__place") <= most).select(*df.columns)
    return kept


def beyond_caps(df: DataFrame, levels: list[Level], order: list[Column], id_col: str) -> DataFrame:
    """The ids of the records that laminar_caps drops. id_col must be unique; a null id gives no row.

    The kept ids are removed from all ids by an anti-join on the id, which no hot group can skew.
    """
    kept = laminar_caps(df, levels, order).select(id_col)
    return df.select(id_col).where(F.col(id_col).isNotNull()).join(kept, id_col, "left_anti")
