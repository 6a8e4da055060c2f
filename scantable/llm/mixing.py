"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scantable.common import cut, small_or_not

#: Buckets of the rate's logarithm in one calibration pass, and passes; each pass splits the bucket found before.
BUCKETS, PASSES = 2000, 2
#: Rates looked at: below the first nothing is drawn, beyond the last everything is at its cap.
LOWEST, HIGHEST = 1e-12, 1e5


@dataclass(frozen=True)
class Mixture:
    """rows: id, source, n_tokens, copy, position key; shares: source, target and actual shares; total: tokens aimed at."""

    rows: DataFrame
    shares: DataFrame
    total: float


def critical_rates(u: np.ndarray, most: int) -> np.ndarray:
    """[len(u), most]: the rates at which the inverse of the Poisson distribution at u reaches 1, 2, ..., most.

    The count of a record at a rate is the number of its critical rates up to it. Found by bisection on the logarithm.
    """
    out = np.empty((len(u), most))
    for k in range(1, most + 1):
        low, high = np.full(len(u), np.log(LOWEST)), np.full(len(u), np.log(HIGHEST))
        for _ in range(50):
            mid = (low + high) / 2
            rate = np.exp(mid)
            term = np.exp(-rate)
            below = term.copy()  # P(count < k)
            for i in range(1, k):
                term = term * rate / i
                below += term
            reached = u > below
            high, low = np.where(reached, mid, high), np.where(reached, low, mid)
        out[:, k - 1] = np.exp(high)
    return out


def poisson_mix(sizes: DataFrame, targets: DataFrame, id_col: str, source_col: str, size_col: str, total: float | None = None, seed: int = 5, max_sources: int = 1000) -> Mixture:
    """Repeat each record a Poisson number of times so that every source gets its target share of all tokens.

    targets: source (unique, at most max_sources), target_share, max_repeats. A record's count is the inverse of the
    Poisson distribution at its hash (seed, id, source): it depends on nothing else, so it is the same on every run. Rates
    are calibrated: a weighted quantile over the records' critical rates finds, per source, the rate whose realised tokens
    come nearest the target (counts grow with the rate), so shares hold for the draws made, not only on average. No
    record is used more than max_repeats times. total: tokens aimed at; by default as many as the scarcest source
    allows with every record at max_repeats; of a larger total, scarce sources give what they have at max_repeats and
    fall short of their share, which shares reports. A target without any text can't be met; the others keep their
    proportions, and shares reports it with 0. Sources without a target, and null sources, have no part. Records of
    size 0 or null have no part. The rows are shuffled globally: ordered by a hash of (seed, id, copy).
    Repeated ids are drawn alike. A target share of null or 0 asks for nothing.
    """
    goal = targets.select(F.col("source").alias("__s"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("int").alias("most"))
    rows = goal.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    unit = (F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    base = sizes.where((F.col(size_col) > 0) & F.col(source_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("n_tokens"), unit.alias("u"))
    dim = small_or_not(goal.where("share > 0 and most > 0"), max_sources)
    base = base.join(dim, base.source == dim["__s"]).drop("__s")

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = batch.column("most").to_numpy()
            rates = critical_rates(batch.column("u").to_numpy(), int(most.max(initial=1)))
            own = [pa.scalar(r[:m].tolist(), pa.list_(pa.float64())) for r, m in zip(rates, most)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "source", "n_tokens")] + [pa.array(own, pa.list_(pa.float64()))], names=["id", "source", "n_tokens", "rates"])

    id_type = sizes.schema[id_col].dataType.simpleString()
    base = cut(base.select("id", "source", "n_tokens", "u", "most").mapInArrow(thresholds, f"id {id_type}, source string, n_tokens long, rates array<double>"))
    have = {r.source: r.n for r in base.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row a target
    want = {r["__s"]: (r.share, r.most) for r in rows if r["__s"] in have and r.share > 0 and r.most > 0}
    shares = sum(s for s, _ in want.values())
    spark = sizes.sparkSession
    if not want:
        empty = base.limit(0).select("id", "source", "n_tokens", F.lit(0).alias("copy"), F.lit(0).cast("long").alias("position_key"))
        return Mixture(empty, _shares(goal, empty), 0.0)
    limit = min(have[s] * most * shares / share for s, (share, most) in want.items())
    aim = limit if total is None else total
    target = {s: aim * share / shares for s, (share, _) in want.items()}

    def lookup(values: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for s, v in values.items() for x in (s, float(v))])[F.col("source")]

    # weighted quantile of the critical rates: tokens come in at each of them, in the order of rates
    steps = base.select("source", "n_tokens", F.explode("rates").alias("rate")).withColumn("at", F.log("rate"))
    low = {s: math.log(LOWEST) for s in want}
    high = {s: math.log(HIGHEST) for s in want}
    done = {s: 0 for s in want}
    last = {s: 0 for s in want}
    for _ in range(PASSES):
        place = F.floor((F.col("at") - lookup(low)) / F.nullif(lookup(high) - lookup(low), F.lit(0.0)) * BUCKETS).cast("int")
        held = steps.where((F.col("at") >= lookup(low)) & (F.col("at") < lookup(high))).groupBy("source", place.alias("b")).agg(F.sum("n_tokens").alias("n"))
        sums: dict[str, dict[int, int]] = {s: {} for s in want}
        for r in held.collect():  # at most BUCKETS rows a source
            sums[r.source][min(r.b, BUCKETS - 1)] = r.n
        for s in want:
            width = (high[s] - low[s]) / BUCKETS
            for b in sorted(sums[s]):
                if done[s] + sums[s][b] > target[s]:
                    low[s], high[s], last[s] = low[s] + b * width, low[s] + (b + 1) * width, sums[s][b]
                    break
                done[s] += sums[s][b]
            else:
                low[s], last[s] = high[s], 0
    # the last bucket is taken too if that comes nearer
    rate = lookup({s: math.exp(high[s] if done[s] + last[s] - target[s] < target[s] - done[s] else low[s]) for s in want})
    count = F.size(F.filter("rates", lambda x: x <= rate))
    drawn = base.select("id", "source", "n_tokens", count.alias("k")).where("k > 0")
    copies = drawn.select("id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("copy"))
    key = F.xxhash64(F.lit(seed + 1), "id", "copy").alias("position_key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = copies.withColumn("position_key", key).repartitionByRange(parts, "position_key", "id").sortWithinPartitions("position_key", "id", "copy")
    return Mixture(mixed, _shares(goal, drawn.select("source", (F.col("n_tokens") * F.col("k")).alias("n_tokens"))), aim)


def _shares(goal: DataFrame, used: DataFrame) -> DataFrame:
    each = used.groupBy(F.col("source").alias("__u")).agg(F.sum("n_tokens").alias("tokens"))
    out = goal.join(each, goal["__s"] == each["__u"], "left").select(F.col("__s").alias("source"), "share", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    whole = out.agg(F.sum("tokens").alias("all"))
    return out.crossJoin(F.broadcast(whole)).select("source", F.col("share").alias("target_share"), "tokens", F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(F.lit(0.0)).alias("actual_share"))
