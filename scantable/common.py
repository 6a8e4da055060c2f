"""Small helpers every operator shares: sessions, lineage cuts, bounded broadcasts, exact distributed ranks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest number of rows, and of bytes, any helper here will broadcast; beyond either the plain (AQE, skew-split) join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def local_session(cores: int | str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that is there."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scantable")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.constraintPropagation.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test-data folder (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir. Where it is unset, local sessions get a private one.

    On a cluster a folder of one machine would be lost with it and unseen by the others: RuntimeError.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/scantable-{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, write it to the shared checkpoint folder and cut its lineage.

    The copy survives lost executors, and Spark's cleaner removes it with its last reference where
    spark.cleaner.referenceTracking.cleanCheckpoints is on. Constraints aren't carried over: in an iteration they would
    double with every join, until planning takes longer than running. Nor are estimated sizes once they are beyond all data: they multiply with
    every join of a loop. Sessions that set spark.sql.constraintPropagation.enabled
    to false themselves, as local_session does, keep their settings untouched.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    setting = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(setting)
    if before == "false":
        return _sized(df.checkpoint(eager=True))
    spark.conf.set(setting, "false")
    try:
        return _sized(df.checkpoint(eager=True))
    finally:
        spark.conf.set(setting, before)


def _sized(df: DataFrame) -> DataFrame:
    """A checkpoint without its estimated size, if that has over 62 bits."""
    plan = df._jdf.queryExecution()
    if plan.analyzed().stats().sizeInBytes() < 1 << 62:
        return df
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), spark)


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows and most_bytes bytes (counted, as JSON text), else df itself.

    df must be cheap to count twice: a dimension table, or the result of cut().
    """
    size = F.octet_length(F.to_json(F.struct("*")))
    seen = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if seen.n <= limit and seen.b <= most_bytes else df


def same_name(col: Column | str) -> Column:
    """Letters and digits of a name in lower case; NULL where none are left.

    Two names are the same if these are equal.
    """
    text = F.col(col) if isinstance(col, str) else col
    key = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    return F.when(key != "", key)


def usable_score(col: Column | str) -> Column:
    """The score if it is a finite number from 0 to 1, else NULL."""
    score = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(score) & (score >= 0) & (score <= 1), score)


def usable_count(col: Column | str) -> Column:
    """The count if it is at least 1, else NULL."""
    count = F.col(col) if isinstance(col, str) else col
    return F.when(count >= 1, count)


def _ranged(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df in range partitions by (group, order), written, with the task (__pid) and place (__at) of each row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    ranged = cut(df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order))
    return ranged.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())


def null_safe_join(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of small, one row a key; null keys meet null keys. small is broadcast if its counted size allows."""
    named = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(small_or_not(named), match).drop(*[f"__k{i}" for i in range(len(keys))])


def with_group_totals(df: DataFrame, group: list[str], *totals: Column) -> DataFrame:
    """df with aggregates of its groups (null keys are a group): combined before they are shuffled, then joined back.

    A window without an order gives the same, but moves and sorts every row, a hot group's into one task.
    """
    return null_safe_join(df, cut(df.groupBy(*group).agg(*totals)), group)


def distributed_rank(df: DataFrame, group: Iterable[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Exact 1-based position of each row within its group, without ever bringing a group into one task.

    Rows are range-partitioned by (group, order), so a hot group spreads over many tasks; each row's
    position is its offset within (group, task) plus the sizes of the group's parts in earlier tasks.
    Rows equal in group and order get consecutive positions in no defined order: end the order with an id.
    An empty input gives an empty output.
    """
    group = list(group)
    marked = _ranged(df, group, order)
    sizes = marked.groupBy(*group, "__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.select(*group, "__pid", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__before")))
    return null_safe_join(marked, sizes, [*group, "__pid"]).select(*df.columns, (F.col("__at") + F.col("__before") + 1).alias(name))


def running_totals(df: DataFrame, group: Iterable[str], order: list[Column], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """df with running aggregates of each group in order, without ever bringing a group into one task.

    As distributed_rank: within a range partition by a window over the group's part there, and over the parts before by
    their aggregates. totals: name -> ("sum" or "max", column); nulls don't count. No value yet gives NULL.
    """
    group = list(group)
    marked = _ranged(df, group, order)
    here = Window.partitionBy("__pid", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    how = {"sum": F.sum, "max": F.max}
    parts = marked.groupBy(*group, "__pid").agg(*[how[h](c).alias(f"__t_{n}") for n, (h, c) in totals.items()])
    parts = cut(parts.select(*group, "__pid", *[how[h](f"__t_{n}").over(before).alias(f"__b_{n}") for n, (h, _) in totals.items()]))
    own = null_safe_join(marked.withColumns({f"__o_{n}": how[h](c).over(here) for n, (h, c) in totals.items()}), parts, [*group, "__pid"])
    both = lambda n: F.greatest(f"__o_{n}", f"__b_{n}") if totals[n][0] == "max" else F.coalesce(F.col(f"__o_{n}") + F.col(f"__b_{n}"), f"__o_{n}", f"__b_{n}")
    return own.select(*df.columns, *[both(n).alias(n) for n in totals])
