"""Operators whose result depends on the order of steps: one key a task, narrow columns in, decisions out.

The keys are scenes or classes within them; what a kernel gets is sets, pairs or counts, never the points of many scenes. Where
a step can be stated declaratively it is (erosion, crops, depth agreement): no kernel then.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scantable.operators.greedy import grouped_kernel


def _types(df: DataFrame, names: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _head(pdf: pd.DataFrame, key: list[str], n: int) -> dict:
    return {k: [pdf[k].iloc[0]] * n for k in key}


def absorb(df: DataFrame, key: list[str], id_col: str, order: str, label: str, values: str, threshold: float) -> DataFrame:
    """(key, id, proposal): rows arrive in order and join the proposal of their label with the largest IoU of at least threshold.

    The first of equally good proposals wins; a proposal grows by the union and is named after its first row. A row that fits none starts one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, id_col])
        open_: list[tuple] = []
        out = []
        for i, c, v in zip(pdf[id_col], pdf[label], pdf[values]):
            items = set(v) if v is not None else set()
            best, at = 0.0, -1
            for n, (_, other, held) in enumerate(open_):
                both = len(items & held) if other == c else 0
                iou = both / (len(items) + len(held) - both) if both else 0.0
                if iou > best:
                    best, at = iou, n
            if at >= 0 and best >= threshold:
                open_[at][2].update(items)
            else:
                open_.append((i, c, items))
                at = len(open_) - 1
            out.append(open_[at][0])
        return pd.DataFrame(_head(pdf, key, len(out)) | {id_col: pdf[id_col].to_numpy(), "proposal": out})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return grouped_kernel(df.select(*key, id_col, order, label, values), key, f"{_types(df, [*key, id_col])}, proposal {kinds[id_col]}", run)


def merge_best_pairs(df: DataFrame, key: list[str], id_col: str, values: str, threshold: float, least: int) -> DataFrame:
    """(key, id, members, n_items): the pair of largest IoU of at least threshold is merged, again and again.

    Of equal pairs the later one counts; a merged set goes to the end of the list, and only if it has at least so many items, which is asked of
    the input too. The name is the smallest member.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # sets are numbered in the order of the list; pairs with a common item wait in a heap, the best and then the latest on top
        rows = sorted(((i, v) for i, v in zip(pdf[id_col], pdf[values]) if v is not None and len(v) >= least), key=lambda r: r[0])
        sets = {n: ([i], set(v)) for n, (i, v) in enumerate(rows)}
        holders: dict = {}
        heap: list[tuple] = []

        def enter(n: int) -> None:
            shared: dict[int, int] = {}
            for x in sets[n][1]:
                for m in holders.setdefault(x, set()):
                    shared[m] = shared.get(m, 0) + 1
                holders[x].add(n)
            for m, both in shared.items():
                if (iou := both / (len(sets[n][1]) + len(sets[m][1]) - both)) >= threshold:
                    heapq.heappush(heap, (-iou, -m, -n))

        for n in list(sets):
            enter(n)
        count = len(sets)
        while heap:
            _, a, b = heapq.heappop(heap)
            if -a not in sets or -b not in sets:
                continue
            old = [sets.pop(-a), sets.pop(-b)]
            for n, (_, items) in zip((-a, -b), old):
                for x in items:
                    holders[x].discard(n)
            if len(union := old[0][1] | old[1][1]) >= least:
                sets[count] = (old[0][0] + old[1][0], union)
                enter(count)
                count += 1
        left = list(sets.values())
        return pd.DataFrame(_head(pdf, key, len(left)) | {id_col: [min(m) for m, _ in left], "members": [sorted(m) for m, _ in left], "n_items": [len(s) for _, s in left]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return grouped_kernel(df.select(*key, id_col, values), key, f"{_types(df, [*key, id_col])}, members array<{kinds[id_col]}>, n_items int", run)


def resolve_containment(df: DataFrame, key: list[str], id_col: str, score: str, values: str, action: str, threshold: float, area_ratio: float = 2.0, score_ratio: float = 0.5, factor: float = 0.5, least: int = 1) -> DataFrame:
    """(key, id, score, n_items, outcome): what becomes of sets that hold smaller ones, from the largest down.

    A smaller set counts if the larger has area_ratio times its size, it lies in it by threshold and its score is score_ratio of the larger one's. action:
    remove_large, downweight (score x factor) or carve (the smaller ones' items are taken out; under least items it is removed).
    """
    if action not in ("remove_large", "downweight", "carve"):
        raise ValueError(action)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {i: [s, set(v if v is not None else ()), "kept"] for i, s, v in zip(pdf[id_col], pdf[score], pdf[values])}
        for i in sorted(rows, key=lambda i: (-len(rows[i][1]), i)):
            s, items, _ = rows[i]
            inner = [
                o[1] for j, o in rows.items()
                if j != i and o[2] != "removed" and o[1] and len(items) >= len(o[1]) * area_ratio and len(items & o[1]) >= threshold * len(o[1]) and o[0] >= s * score_ratio
            ]
            if not inner:
                continue
            if action == "remove_large":
                rows[i][2] = "removed"
            elif action == "downweight":
                rows[i][0], rows[i][2] = s * factor, "downweighted"
            else:
                rows[i][1] = items.difference(*inner)
                rows[i][2] = "carved" if len(rows[i][1]) >= least else "removed"
        ids = sorted(rows)
        return pd.DataFrame(_head(pdf, key, len(ids)) | {id_col: ids, score: [float(rows[i][0]) for i in ids], "n_items": [len(rows[i][1]) for i in ids], "outcome": [rows[i][2] for i in ids]})

    return grouped_kernel(df.select(*key, id_col, score, values), key, f"{_types(df, [*key, id_col])}, `{score}` double, n_items int, outcome string", run)


def accept_frames(df: DataFrame, key: list[str], frame: str, segment: str, value: str) -> DataFrame:
    """(key, frame, accepted): frames in order propose segments; a frame is accepted if the new ones are worth more than nothing together.

    value: what a segment adds to the objective (points inside less outside, over all frames). As the objective is a sum over
    segments, only what a frame adds has to be looked at.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: set = set()
        out = []
        rows = sorted(zip(pdf[frame], pdf[segment], pdf[value]), key=lambda r: r[:2])
        for f, proposed in groupby(rows, key=lambda r: r[0]):
            new = {s: v for _, s, v in proposed if s not in chosen}
            ok = sum(new.values()) > 0
            if ok:
                chosen |= set(new)
            out.append((f, ok))
        return pd.DataFrame(_head(pdf, key, len(out)) | {frame: [f for f, _ in out], "accepted": [bool(a) for _, a in out]})

    return grouped_kernel(df.select(*key, frame, segment, value), key, f"{_types(df, [*key, frame])}, accepted boolean", run)


def constrained_clusters(nodes: DataFrame, edges: DataFrame, key: list[str], id_col: str, quality: str, seed_share: float = 0.3, support: int = 1) -> DataFrame:
    """(key, id, cluster): nodes in order of quality join the one cluster that supports them and doesn't conflict with them.

    nodes: ids not repeated in a key. edges: key, a, b, conflict. Only the best seed_share of the nodes start clusters. A node that several clusters would take is deferred: it is asked
    again at the end and goes to the cluster of most support, to none if two have equally much. Nodes without a cluster get NULL. A node asks
    only its own neighbours for their clusters, so a key takes time in proportion to its edges, however many clusters it has (support below 1: to nodes times clusters).
    """
    e = edges.where("a is not null and b is not null").select(*key, F.col("a").alias(id_col), "b", F.lit(None).cast("double").alias("q"), F.when(F.col("conflict"), 2).otherwise(1).alias("kind"))
    n = nodes.select(*key, id_col, F.col(id_col).alias("b"), F.col(quality).cast("double").alias("q"), F.lit(0).alias("kind"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, kind = pdf[id_col].to_numpy(), pdf["b"].to_numpy(), pdf["kind"].to_numpy()
        own = np.flatnonzero(kind == 0)
        own = own[np.lexsort((left[own], -pdf["q"].to_numpy()[own]))]
        ids, size = left[own], len(own)
        if not size:
            return pd.DataFrame(columns=[*key, id_col, "cluster"])
        # nodes are named by their place in the order; links lie in both directions, each once, by their first end
        by_id = np.argsort(ids)
        links = np.flatnonzero(kind > 0)
        ends = []
        for x in (left[links], right[links]):
            at = by_id[np.minimum(np.searchsorted(ids, x, sorter=by_id), size - 1)]
            ends.append(np.where(ids[at] == x, at, -1))
        known = (ends[0] >= 0) & (ends[1] >= 0)
        (x, y), bad = (end[known] for end in ends), kind[links][known] == 2
        both = np.unique(np.concatenate([(x * size + y) * 2 + bad, (y * size + x) * 2 + bad]))
        start = np.searchsorted(both, np.arange(size + 1) * size * 2).tolist()
        near, hard = (both // 2 % size).tolist(), (both % 2).tolist()
        home = [-1] * size  # the first node of a node's cluster
        heads: list[int] = []

        def fits(i: int) -> dict[int, int]:
            found = dict.fromkeys(heads, 0) if support < 1 else {}
            barred = set()
            for k in range(start[i], start[i + 1]):
                if (c := home[near[k]]) < 0:
                    continue
                if hard[k]:
                    barred.add(c)
                else:
                    found[c] = found.get(c, 0) + 1
            return {c: m for c, m in found.items() if m >= support and c not in barred}

        seeds = max(1, int(np.ceil(size * seed_share)))
        late, rest = [], []
        for i in range(size):
            found = fits(i)
            if len(found) == 1:
                home[i] = next(iter(found))
            elif found:
                late.append(i)
            elif i < seeds:
                home[i] = i
                heads.append(i)
            else:
                rest.append(i)
        for i in late + rest:
            found = sorted(fits(i).items(), key=lambda x: -x[1])
            if found and (len(found) == 1 or found[0][1] > found[1][1]):
                home[i] = found[0][0]
        at = np.array(home)
        return pd.DataFrame(_head(pdf, key, size) | {id_col: ids, "cluster": pd.arrays.IntegerArray(ids[at].astype(np.int64), at < 0)})

    return grouped_kernel(n.unionByName(e), key, f"{_types(nodes, [*key, id_col])}, cluster long", run)


def expand_boundary(df: DataFrame, key: list[str], segment: str, contact: str, size: str, other: str, budget: str) -> DataFrame:
    """(key, segment, taken, reason): neighbours by contact, strongest first, are taken while they fit the budget.

    A neighbour with more contact to another instance (other) is a bridge; one that doesn't fit is skipped and smaller ones are still tried.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([contact, segment], ascending=[False, True])
        left = float(pdf[budget].iloc[0])
        out = []
        for c, n, o in zip(pdf[contact], pdf[size], pdf[other]):
            if o > c:
                out.append((False, "bridge"))
            elif n > left:
                out.append((False, "over_budget"))
            else:
                left -= n
                out.append((True, "taken"))
        return pd.DataFrame(_head(pdf, key, len(out)) | {segment: pdf[segment].to_numpy(), "taken": [t for t, _ in out], "reason": [r for _, r in out]})

    return grouped_kernel(df.select(*key, segment, contact, size, other, budget), key, f"{_types(df, [*key, segment])}, taken boolean, reason string", run)


def stratified_folds(df: DataFrame, group: str, label: str, folds: int, max_groups: int = 1_000_000) -> DataFrame:
    """(group, fold): whole groups over folds so that every label is spread as evenly as a greedy choice makes it.

    Groups that lean most to some labels are dealt first (deviation of their counts, then name). A group goes to the fold after
    which the labels' relative spreads over the folds are least on average; the first such fold. Spreads follow from two sums a
    label, of the folds' counts and of their squares: what a choice would change is known for all folds and labels at
    once. The kernel gets one row per group and label; over max_groups groups raise ValueError. Null groups and labels are left out.
    """
    counts = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    if counts.select(group).distinct().limit(max_groups + 1).count() > max_groups:
        raise ValueError(f"more than {max_groups} groups")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, row = np.unique(pdf[group].to_numpy(), return_inverse=True)
        labels, col = np.unique(pdf[label].to_numpy(), return_inverse=True)
        need = np.zeros((len(names), len(labels)))
        np.add.at(need, (row, col), pdf["n"].to_numpy())
        scale = 1 / (need.sum(axis=0) * folds)
        lean = (need**2).mean(axis=1) - need.mean(axis=1) ** 2
        load = np.zeros((folds, len(labels)))
        first, second = np.zeros(len(labels)), np.zeros(len(labels))
        fold = np.zeros(len(names), dtype=np.int32)
        for i in np.argsort(-lean, kind="stable"):
            first = first + need[i]
            squares = second + (2 * load + need[i]) * need[i]  # per fold that the group may go to
            spread = np.sqrt(np.maximum(folds * squares - first**2, 0)) @ scale
            fold[i] = np.flatnonzero(spread <= spread.min() * (1 + 1e-9) + 1e-12)[0]
            second = squares[fold[i]]
            load[fold[i]] += need[i]
        return pd.DataFrame({group: names, "fold": fold})

    return grouped_kernel(counts.withColumn("__one", F.lit(1)), ["__one"], f"{_types(df, [group])}, fold int", run)


def erode(pixels: DataFrame, mask: list[str], radius: int, least_share: float = 0.15) -> DataFrame:
    """The pixels (mask, px, py) of each mask whose whole neighbourhood of the radius is in it; all of them where too few would be left."""
    step = F.sequence(F.lit(-radius), F.lit(radius))
    own = pixels.select(*mask, "px", "py").distinct()
    around = own.select(*mask, F.explode(step).alias("dx"), "px", "py").select(*mask, (F.col("px") + F.col("dx")).alias("px"), F.explode(step).alias("dy"), "py").select(*mask, "px", (F.col("py") + F.col("dy")).alias("py"))
    inner = around.groupBy(*mask, "px", "py").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == (2 * radius + 1) ** 2)
    marked = own.join(inner, [*mask, "px", "py"], "left")
    share = marked.groupBy(*mask).agg((F.count("k") / F.count(F.lit(1))).alias("share"))
    kept = (F.col("share") == 0) | (F.col("share") < least_share) | F.col("k").isNotNull()
    return marked.join(share, mask).where(kept).select(*mask, "px", "py")


def random_crop(points: DataFrame, key: list[str], id_col: str, axes: list[str], size: float, least: int, tries: int = 5, seed: int = 1) -> DataFrame:
    """(key, id, attempt): the points in a box of the size around a random point; the first of several tries with enough points.

    Centres are points of least hash, so the crop is the same on every run. A key where no try has enough points gives no row.
    """
    centres = None
    for t in range(tries):
        one = points.groupBy(*key).agg(F.min_by(F.struct(*axes), F.md5(F.concat(F.lit(f"{seed}/{t}/"), F.col(id_col).cast("string")))).alias("c")).withColumn("attempt", F.lit(t))
        centres = one if centres is None else centres.union(one)
    near = None
    for a in axes:
        cond = F.abs(F.col(a) - F.col(f"c.{a}")) <= size / 2
        near = cond if near is None else near & cond
    inside = points.select(*key, id_col, *axes).join(centres, key).where(near)
    good = inside.groupBy(*key, "attempt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).groupBy(*key).agg(F.min("attempt").alias("attempt"))
    return inside.join(good, [*key, "attempt"]).select(*key, id_col, "attempt")


def scaled_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, size: tuple[int, int], target: tuple[int, int]) -> list[Column]:
    """Intrinsics of an image of size (width, height) for its copy of the target size."""
    sx, sy = target[0] / size[0], target[1] / size[1]
    return [fx * sx, fy * sy, cx * sx, cy * sy]


def depth_agreement(rows: DataFrame, key: list[str], expected: str, measured: str) -> DataFrame:
    """(key, n, agreeing, in_front, behind, median_gap, p90_gap): depths within min(0.10, max(0.04, 0.03 d)) agree."""
    gap = F.col(measured) - F.col(expected)
    near = F.least(F.lit(0.10), F.greatest(F.lit(0.04), 0.03 * F.col(expected)))
    known = rows.where(F.col(expected).isNotNull() & F.col(measured).isNotNull() & (F.col(measured) > 0))
    return known.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(gap) <= near).alias("agreeing"), F.count_if(gap < -near).alias("in_front"), F.count_if(gap > near).alias("behind"), F.median(F.abs(gap)).alias("median_gap"), F.percentile(F.abs(gap), 0.9).alias("p90_gap")
    )


def unpack_masks(df: DataFrame, id_col: str, packed: str, height: str, width: str) -> DataFrame:
    """(id, px, py): set pixels of masks packed to bits by rows, most significant bit first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (raw, h, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in (packed, height, width)))):
                if raw is None:
                    continue
                at = np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=h * w))
                ids = batch.column(id_col).take(pa.array(np.full(len(at), row)))
                yield pa.RecordBatch.from_arrays([ids, pa.array((at % w).astype(np.int32)), pa.array((at // w).astype(np.int32))], names=[id_col, "px", "py"])

    return df.select(id_col, packed, height, width).mapInArrow(run, f"{_types(df, [id_col])}, px int, py int")
