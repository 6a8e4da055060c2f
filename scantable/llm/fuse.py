"""One surviving record per group of duplicates by iterative truth discovery."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from scantable.common import cut, same_name


@dataclass(frozen=True)
class Fused:
    """chosen: one row per group; reliability: of each source, in the last round; rounds: those it took; converged: whether they settled."""

    chosen: DataFrame
    reliability: dict[int, float]
    sources: list[tuple[str | None, int]]
    rounds: int
    converged: bool


def discover_truth(
    records: DataFrame,
    key: list[str],
    source: str,
    sources: DataFrame,
    fields: dict[str, Column],
    recency: str,
    id_col: str,
    discount: float = 0.25,
    floor: float = 0.5,
    max_rounds: int = 100,
    tolerance: float = 1e-3,
    max_sources: int = 10_000,
) -> Fused:
    """Choose, for every group of key with two or more records, one value per field.

    Claims. A source's claim on a field of a group is the value of its latest record (by recency, nulls earliest, then
    largest id) whose value is usable (fields: name -> expression, NULL where it isn't). So a group has at most one claim
    a source, however many records it has; claims are pre-aggregated before they are shuffled.

    Rounds. A claim votes for its value with its source's reliability times discount**place, place counting the
    group's claims on this field by trust (sources: source name, trust_rank; names compare by letters and digits; a missing
    or unknown name ranks last), then recency, then id. The value with the largest sum of votes is chosen; a tie goes
    to the value of the earliest place. A source's reliability is then the share of its claims that were chosen, smoothed
    towards 1 by ten claims, and not below floor. Rounds go on until no reliability moves by more than tolerance; where max_rounds
    don't do, converged is false and a warning says so. Sums of votes within 1e-9 are ties.

    discount = 1 is plain truth discovery: agreeing sources outvote trusted ones. With discount < floor / (1 + floor) the sum
    of all later votes stays below the first one: the prior order decides, and the rounds only measure the sources.

    Result columns: key, n_records, and per field f: f (value), f_id (the id of the chosen value's earliest-placed record; NULL
    if no record has a usable value), f_support (share of the vote). Groups with a null in the key are no groups.
    """
    names = sources.select(same_name("source_kind").alias("name"), F.col("trust_rank").cast("long").alias("rank"))
    names = names.where("name is not null").groupBy("name").agg(F.min("rank").alias("rank")).orderBy("name")
    known = [(r.name, r["rank"]) for r in names.limit(max_sources + 1).collect()]
    if len(known) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    unknown_rank = max([r for _, r in known if r is not None], default=0) + 1
    known = [(n, unknown_rank if r is None else r) for n, r in known] + [(None, unknown_rank)]
    index = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(known[:-1]) for x in (n, i)]) if len(known) > 1 else None
    name = same_name(source)
    sid = F.coalesce(index[name], F.lit(len(known) - 1)) if index is not None else F.lit(0)

    has_key = F.lit(True)
    for k in key:
        has_key = has_key & F.col(k).isNotNull()
    base = records.where(has_key).select(*key, sid.alias("__sid"), *[
        F.when(v.isNotNull(), F.struct(F.col(recency).alias("ts"), F.col(id_col).alias("id"), v.alias("v"))).alias(f)
        for f, v in fields.items()
    ])
    per_source = base.groupBy(*key, "__sid").agg(F.count(F.lit(1)).alias("__n"), *[F.max(f).alias(f) for f in fields])
    ranks = F.array(*[F.lit(r) for _, r in known])
    groups = per_source.groupBy(*key).agg(
        F.sum("__n").alias("n_records"),
        *[
            F.collect_list(
                F.when(F.col(f).isNotNull(), F.struct((-F.get(ranks, F.col("__sid"))).alias("trust"), F.col(f)["ts"].alias("ts"), F.col(f)["id"].alias("id"), F.col("__sid").alias("sid"), F.col(f)["v"].alias("v")))
            ).alias(f)
            for f in fields
        ],
    )
    groups = groups.where("n_records > 1").select(*key, "n_records", *[F.sort_array(f, asc=False).alias(f) for f in fields])
    groups = cut(groups)

    def elect(weights: dict[int, float]) -> DataFrame:
        table = F.array(*[F.lit(float(weights[i])) for i in range(len(known))])

        def votes(f: str) -> Column:
            return F.transform(F.col(f), lambda c, i: F.get(table, c["sid"]) * F.pow(F.lit(discount), i))

        def support(f: str) -> Column:
            def of(c: Column) -> Column:
                mine = F.zip_with(F.col(f), F.col(f"__w_{f}"), lambda d, w: F.when(d["v"] == c["v"], w).otherwise(F.lit(0.0)))
                return F.aggregate(mine, F.lit(0.0), lambda a, x: a + x)

            # the largest support, and among equals the earliest place
            return F.sort_array(F.transform(F.col(f), lambda c, i: F.struct(F.round(of(c), 9).alias("even"), (-i).alias("place"), of(c).alias("s"))), asc=False)

        out = groups.select("*", *[votes(f).alias(f"__w_{f}") for f in fields])
        out = out.select(*groups.columns, *[F.get(support(f), F.lit(0)).alias(f"__best_{f}") for f in fields], *[F.aggregate(f"__w_{f}", F.lit(0.0), lambda a, x: a + x).alias(f"__all_{f}") for f in fields])
        return out.select(*groups.columns, *[f"__all_{f}" for f in fields], *[F.col(f"__best_{f}")["s"].alias(f"__sum_{f}") for f in fields], *[F.get(F.col(f), -F.col(f"__best_{f}")["place"]).alias(f"__won_{f}") for f in fields])

    def judged_claims(f: str) -> Column:
        return F.transform(F.col(f), lambda c: F.struct(c["sid"].alias("sid"), (c["v"] == F.col(f"__won_{f}")["v"]).cast("int").alias("ok")))

    weights = {i: 1.0 for i in range(len(known))}
    rounds, converged, moved = 0, False, math.inf
    while rounds < max_rounds:
        rounds += 1
        claims = F.concat(*[judged_claims(f) for f in fields])
        judged = elect(weights).select(F.explode(claims).alias("c")).groupBy(F.col("c.sid").alias("sid")).agg(F.sum("c.ok").alias("ok"), F.count(F.lit(1)).alias("n"))
        seen: dict[int, Row] = {r.sid: r for r in judged.collect()}  # one row a source, at most max_sources
        new = {i: max(floor, (seen[i].ok + 10) / (seen[i].n + 10)) if i in seen else weights[i] for i in weights}
        moved = max(abs(new[i] - weights[i]) for i in new)
        weights = new
        converged = moved <= tolerance
        if converged:
            break
    if not converged:
        warnings.warn(f"reliabilities still moved by {moved} after {rounds} rounds", stacklevel=2)
    final = elect(weights)
    chosen = final.select(*key, "n_records", *[
        c
        for f in fields
        for c in (F.col(f"__won_{f}")["v"].alias(f), F.col(f"__won_{f}")["id"].alias(f"{f}_id"), (F.col(f"__sum_{f}") / F.nullif(F.col(f"__all_{f}"), F.lit(0.0))).alias(f"{f}_support"))
    ])
    return Fused(chosen, weights, known, rounds, converged)
