"""Consolidating pairwise matches into groups by low-diameter decomposition and contraction."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scantable.common import BROADCAST_ROWS, cut, small_or_not

#: Rate of the exponential shifts, and where their distribution is cut off: clusters have a radius below LONGEST, which so is the most
#: steps of a growth; about a share RATE of the edges is cut, and exp(-RATE * LONGEST) more where very many vertices are near.
RATE, LONGEST = 0.4, 10
#: Once so few edges are left (1.6 MB), the recursion goes on inside one task: the same shifts, the same growth, the same result.
BASE_EDGES = 100_000

_MASK = (1 << 52) - 1
_SHARE = 1 - math.exp(-RATE * LONGEST)
# fixed values: primes of the published 64-bit hash that Spark's xxhash64 is
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _shift(v: Column, level: Column) -> Column:
    """Exponentially distributed head start of a vertex, up to LONGEST, from its hash: the same in every task and on every run.

    level is a column, not a literal: so all levels run the same generated code. Starts are rounded to 2**-20 of a step, so that sums
    of steps are exact and equal in both forms of the recursion.
    """
    unit = (F.xxhash64(level, v).bitwiseAND(F.lit(_MASK)).cast("double") + 0.5) / float(1 << 52)
    return F.round(-F.log(1.0 - unit * _SHARE) / RATE * float(1 << 20)) / float(1 << 20)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash64(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxhash64 of one BIGINT a row, as Spark computes it."""
    h = seed + _P5 + np.uint64(8)
    h = _rotated(h ^ (_rotated(values.astype(np.int64).view(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def shifts(values: np.ndarray, level: int) -> np.ndarray:
    """_shift() of many vertices in memory."""
    seed = hash64(np.array([level]), np.array([42], dtype=np.uint64))
    unit = ((hash64(values, seed) & np.uint64(_MASK)).astype(np.float64) + 0.5) / float(1 << 52)
    return np.floor(-np.log(1.0 - unit * _SHARE) / RATE * float(1 << 20) + 0.5) / float(1 << 20)


def _decompose(a: np.ndarray, b: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, roots) of a small graph: the same recursion in memory."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while True:
        # arrival time and centre of each vertex; the smaller centre on a tie
        time, centre = -shifts(ids, level), np.arange(len(ids))
        to, frm = np.concatenate([x, y]), np.concatenate([y, x])
        while True:
            told, whose = time[frm] + 1, centre[frm]
            order = np.lexsort((whose, told, to))
            first = order[np.append(True, to[order][1:] != to[order][:-1])] if len(order) else order
            at = to[first]
            better = (told[first] < time[at]) | ((told[first] == time[at]) & (whose[first] < centre[at]))
            if not better.any():
                break
            time[at[better]], centre[at[better]] = told[first[better]], whose[first[better]]
        label = centre[label]
        x, y = centre[x], centre[y]
        keep = x != y
        if not keep.any():
            return ids, ids[label]
        x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)])[:, keep], axis=1)
        level += 1


def _grown(both: DataFrame, state: DataFrame) -> DataFrame:
    """(v, c): every vertex with the centre that reaches it first, from state (v, m: time and centre) after the first step.

    In a step only vertices that changed tell their neighbours (both: v, u). As they get few, they are broadcast and what
    they change is kept beside the state, which is rewritten only after steps that change much.
    """
    late: DataFrame | None = None  # changes since the state was written, one row a vertex
    n_late, limit = 0, BROADCAST_ROWS // 2
    front = state.where("m.c <> v")
    while True:
        tells = small_or_not(front.select(F.col("v").alias("u"), F.struct((F.col("m.t") + 1.0).alias("t"), F.col("m.c").alias("c")).alias("told")))
        told = small_or_not(cut(both.join(tells, "u").groupBy("v").agg(F.min("told").alias("told"))))
        now = state if late is None else state.join(F.broadcast(late), "v", "left").select("v", F.least("m", "later").alias("m"))
        front = cut(now.join(told, "v").where("told < m").select("v", F.col("told").alias("m")))
        n = front.limit(limit + 1).count()
        if not n:
            break
        if n_late + n <= limit:
            new = front.select("v", F.col("m").alias("later"))
            late = cut(new if late is None else late.union(new).groupBy("v").agg(F.min("later").alias("later")))
            n_late += n
        else:
            state, late, n_late = cut(now.union(front).groupBy("v").agg(F.min("m").alias("m"))), None, 0
    return cut(now.select("v", F.col("m.c").alias("c")))


def component_roots(edges: DataFrame, src: str = "src", dst: str = "dst", base_edges: int | None = None) -> DataFrame:
    """(v, root): vertices have the same root if and only if they are linked over undirected edges. Vertices are BIGINT.

    Each level: every vertex starts growing a cluster at an exponentially shifted time; a vertex joins the cluster that
    reaches it first (the smaller centre on a tie). Clusters grow until no vertex is reached any earlier; after the first step,
    whose times are hashes of the vertices, only vertices that changed tell their neighbours. So clusters have a radius
    below LONGEST and about a share RATE of the edges is cut. Clusters are contracted to super-vertices, edges inside a
    cluster vanish, the others are de-duplicated and the next level decomposes them. When no edge is left, assignments are composed from the
    last level back to the first. base_edges (BASE_EDGES): with so few edges left, the levels to come run in one task, with the same shifts and so the
    same result. Each level is written to the shared checkpoint folder: nothing is collected, and
    messages to a vertex are combined before they are shuffled, so hubs don't gather in one task.

    An edge with a null end is no edge. A loop only says that its vertex exists. Repeated edges change nothing.
    No edges give no rows.
    """
    base_edges = BASE_EDGES if base_edges is None else base_edges
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
    live = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).cast("long").alias("level")).distinct())
    maps: list[DataFrame] = []
    while True:
        left = live.count()
        if left == 0 and maps:
            break
        if left <= base_edges:
            maps.append(cut(live.coalesce(1).mapInArrow(_rest, "v long, c long")))
            break
        both = live.select(F.col("a").alias("v"), F.col("b").alias("u"), "level").union(live.select(F.col("b").alias("v"), F.col("a").alias("u"), "level"))
        # step 1: each vertex hears its neighbours' start times, and its own
        own, theirs = F.struct((-_shift(F.col("v"), F.col("level"))).alias("t"), F.col("v").alias("c")), F.struct((1.0 - _shift(F.col("u"), F.col("level"))).alias("t"), F.col("u").alias("c"))
        mapped = _grown(both, cut(both.groupBy("v").agg(F.min(F.least(own, theirs)).alias("m"))))
        maps.append(mapped)
        ends = mapped.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        next_live = live.where("a <> b").join(mapped.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(ends, "b")
        # a cluster may bear the name of a vertex that itself went elsewhere: the name is a super-vertex only
        next_live = next_live.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), (F.col("level") + 1).alias("level")).distinct()
        live = cut(next_live)
    # compose: names of the last level are roots; walk back, a super-vertex without an edge of its own is a root too
    roots: DataFrame | None = None
    for mapped in reversed(maps):
        if roots is None:
            roots = mapped.select("v", F.col("c").alias("root"))
            continue
        above = roots.select(F.col("v").alias("c"), "root")
        roots = cut(mapped.join(small_or_not(above), "c", "left").select("v", F.coalesce("root", "c").alias("root")))
    return roots


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [tuple(x.column(c).to_numpy() for c in ("a", "b", "level")) for x in batches if x.num_rows]
    if parts:
        a, b, level = (np.concatenate([p[i] for p in parts]) for i in range(3))
        v, root = _decompose(a, b, int(level[0]))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["v", "c"])


def connected_groups(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, group): the smallest vertex linked to each vertex, see component_roots."""
    roots = cut(component_roots(edges, src, dst))
    least = roots.groupBy("root").agg(F.min("v").alias("group"))
    return roots.join(least, "root").select(F.col("v").alias("vertex"), "group")


def observation_groups(trace: DataFrame, members: str, candidate: str, links: Column) -> DataFrame:
    """(observation_id, group_id) from rows that list members; rows with the same candidate belong together.

    links: condition of the rows that link (a null condition doesn't). Every such row gives a star around its smallest member,
    and an edge from there to the smallest member of all rows with its candidate: linear in the members, never all pairs. Null and
    negative members are dropped.
    """
    clean = F.array_distinct(F.filter(F.col(members), lambda x: x.isNotNull() & (x >= 0)))
    rows = trace.where(F.coalesce(links, F.lit(False))).select(clean.alias("m"), F.col(candidate).alias("c")).where(F.size("m") > 0)
    rows = cut(rows.select(F.array_min("m").alias("src"), "m", "c"))
    least = rows.where("c is not null").groupBy("c").agg(F.min("src").alias("dst"))
    ties = rows.where("c is not null").select("c", "src").distinct().join(least, "c").select("src", "dst")
    stars = rows.select("src", F.explode("m").alias("dst"))
    roots = cut(component_roots(stars.union(ties)))
    least = roots.groupBy("root").agg(F.min("v").alias("low"))
    return roots.join(least, "root").select(F.col("v").alias("observation_id"), F.col("low").alias("group_id"))
