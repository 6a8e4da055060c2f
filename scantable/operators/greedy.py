"""Order-dependent selection: suppression, caps, merging, diverse and farthest picks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scantable.common import cut, running_totals


#: Once so few conflicts are left, they are decided in one task (24 bytes each).
LAST_PAIRS = 200_000


def suppress(rows: DataFrame, key: list[str], conflicts: DataFrame, better: str, worse: str) -> DataFrame:
    """Greedy suppression: rows in order, each dropped if it conflicts with a kept better one. Returns the kept rows.

    conflicts: key, better, worse - ids of conflicting rows of the same key, directed from the earlier to the later row of the
    order. rows: key and the id under the name of worse, ids not repeated. The scan of a sorted list is replaced by rounds over the conflict pairs:
    a row without an undecided better neighbour is kept, rows under a kept one are dropped, until all are decided. No
    group is brought into one task, and pairs that are decided drop out of later rounds. The last LAST_PAIRS pairs are decided
    in one task by the same rule, so that a long chain of conflicts doesn't take a round for each two of its links.
    """
    ids = rows.select(*key, F.col(worse).alias("id"))
    live = cut(conflicts.select(*key, F.col(better).alias("b"), F.col(worse).alias("w")).distinct())
    dropped: DataFrame | None = None
    while True:
        left = live.limit(LAST_PAIRS + 1).count()
        if left <= LAST_PAIRS:
            break
        under = live.select(*key, F.col("w").alias("b")).distinct()
        heads = live.select(*key, "b").distinct().join(under, [*key, "b"], "left_anti")  # undecided, nothing better left
        lost = cut(live.join(heads, [*key, "b"], "left_semi").select(*key, F.col("w").alias("id")).distinct())
        dropped = lost if dropped is None else dropped.union(lost)
        gone = lost.select(*key, F.col("id").alias("w"))
        live = live.join(heads, [*key, "b"], "left_anti").join(gone, [*key, "w"], "left_anti")
        live = cut(live.join(lost.select(*key, F.col("id").alias("b")), [*key, "b"], "left_anti"))
    if left:
        fields = {f.name: f.dataType.simpleString() for f in live.schema}
        schema = ", ".join(f"`{k}` {fields[k]}" for k in key) + f", id {fields['w']}"
        lost = grouped_kernel(live.coalesce(1), key, schema, lambda pdf: _scan(pdf, key), one_task=True)
        dropped = lost if dropped is None else dropped.union(lost)
    kept = ids if dropped is None else ids.join(dropped, [*key, "id"], "left_anti")
    return rows.join(kept.withColumnRenamed("id", worse), [*key, worse], "left_semi")


def _scan(pdf: pd.DataFrame, key: list[str]) -> pd.DataFrame:
    """The dropped ids of one key: a row is decided once all its better neighbours are."""
    below: dict = {}
    waits: dict = {}
    for b, w in zip(pdf["b"], pdf["w"]):
        below.setdefault(b, []).append(w)
        waits[w] = waits.get(w, 0) + 1
    ready = [b for b in below if b not in waits]
    dropped: set = set()
    while ready:
        one = ready.pop()
        for w in below.get(one, ()):
            if one not in dropped:
                dropped.add(w)
            waits[w] -= 1
            if not waits[w]:
                ready.append(w)
    return pd.DataFrame({k: [pdf[k].iloc[0]] * len(dropped) for k in key} | {"id": list(dropped)})


def directed(pairs: DataFrame, key: list[str], a: str, b: str, rank_a: Column, rank_b: Column) -> DataFrame:
    """Undirected pairs as better -> worse: the smaller rank (a struct ended by the id) is better."""
    first = rank_a < rank_b
    return pairs.select(*key, F.when(first, F.col(a)).otherwise(F.col(b)).alias("better"), F.when(first, F.col(b)).otherwise(F.col(a)).alias("worse"))


def drop_included(pairs: DataFrame, rows: DataFrame, key: list[str], id_col: str, size: str, share: float) -> DataFrame:
    """Rows that aren't a smaller (or equal and later) set lying to at least share inside another one.

    pairs: key, a, b, inter, size_a, size_b with a < b, see overlap_pairs.
    """
    small_a = F.col("size_a") < F.col("size_b")
    inside = pairs.where(F.col("inter") >= F.least("size_a", "size_b") * share).select(*key, F.when(small_a, F.col("a")).otherwise(F.col("b")).alias(id_col)).distinct()
    return rows.join(inside, [*key, id_col], "left_anti")


def grouped_kernel(df: DataFrame, key: list[str], schema: str, f: Callable[[pd.DataFrame], pd.DataFrame], one_task: bool = False) -> DataFrame:
    """f over each group of key, null keys being a group: groups stream through a task in sorted order, many to a batch.

    A task holds one group and one batch at a time; the batches of a group are put together once, at its end. This costs a fraction of
    what a batch per group does where groups are small. one_task: df is in one partition and stays there.
    """

    def differs(pdf: pd.DataFrame, before: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), dtype=bool)
        for k in key:
            a, b = pdf[k].reset_index(drop=True), before[k].reset_index(drop=True)
            new |= (a.ne(b) & ~(a.isna() & b.isna())).to_numpy(dtype=bool, na_value=True)
        return new

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the batches of the group that may go on

        def done(groups: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = [x for g in groups if len(x := f(g))]
            if out:
                yield pd.concat(out, ignore_index=True)

        for pdf in batches:
            if not len(pdf):
                continue
            at = np.flatnonzero(np.append(False, differs(pdf.iloc[1:], pdf.iloc[:-1])))
            if held and not differs(pdf.iloc[:1], held[-1].iloc[-1:])[0]:
                if not len(at):
                    held.append(pdf)
                    continue
                yield from done([pd.concat([*held, pdf.iloc[: at[0]]], ignore_index=True)])
            else:
                if held:
                    yield from done([pd.concat(held, ignore_index=True)])
                at = np.append(0, at)
            yield from done([pdf.iloc[a:b].reset_index(drop=True) for a, b in zip(at[:-1], at[1:])])
            held = [pdf.iloc[at[-1] :]]
        if held:
            yield from done([pd.concat(held, ignore_index=True)])

    spread = df if one_task else df.repartition(*[F.col(k) for k in key])
    return spread.sortWithinPartitions(*key).mapInPandas(run, schema)


def admit(df: DataFrame, key: list[str], id_col: str, order: str, source: str, label: str, passes: str, source_cap: int, class_cap: int) -> DataFrame:
    """(key, id, decision): scan in order; caps count accepted rows only and are tested before anything else.

    decision: source_limit, class_limit, rejected (passes is false or null) or accepted; rows without a source, or a class, are of one. Rows that can't pass never use up a cap, so of those
    that pass, ranks within (key, source) and (key, class) tell all that the scan does only if one cap is in force; with both, the
    scan is sequential per key and runs as a grouped kernel over narrow columns.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in [*key, id_col]) + ", decision string"

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, id_col], ascending=[False, True], na_position="last")
        sources: dict = {}
        classes: dict = {}
        out = []
        known = lambda name: (None if pd.isna(x) else x for x in pdf[name])
        for s, c, ok in zip(known(source), known(label), pdf[passes].fillna(False)):
            if sources.get(s, 0) >= source_cap:
                out.append("source_limit")
            elif classes.get(c, 0) >= class_cap:
                out.append("class_limit")
            elif not ok:
                out.append("rejected")
            else:
                sources[s], classes[c] = sources.get(s, 0) + 1, classes.get(c, 0) + 1
                out.append("accepted")
        return pdf[[*key, id_col]].assign(decision=out)

    return grouped_kernel(df.select(*key, id_col, order, source, label, passes), key, schema, scan)


def linked_sets(items: DataFrame, block: list[str], id_col: str, item: str = "item") -> DataFrame:
    """(block, id, part): sets of a block that are linked over common items, directly or over others, have the same part.

    Sets without a common item never merge, so a part is all that a kernel of merges has to see. Links are a star per
    item, to its smallest set: linear in the items. items: block, id_col, item; distinct.
    """
    from scantable.operators.graph import components

    node = items.withColumn("node", F.struct(*block, id_col))
    first = node.groupBy(*block, item).agg(F.min("node").alias("first"))
    ends = node.join(first, [*block, item]).select("first", "node")
    found = components(ends, "first", "node")
    return found.select(*[F.col(f"node.{c}").alias(c) for c in (*block, id_col)], F.col(f"component.{id_col}").alias("part"))


def merge_sets(df: DataFrame, key: list[str], id_col: str, score: str, values: str, threshold: float) -> DataFrame:
    """(key, id, members): sets are merged to a fixpoint, the first pair of at least threshold IoU into the higher score.

    The scan starts anew after every merge, in order of score (descending) and id. As only the merged set has changed, only its
    pairs are looked at again. A key's sets are held in one task, as each merge changes what follows; see linked_sets() for small keys.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in [*key, id_col]) + f", members array<{fields[id_col]}>, n_items int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, id_col], ascending=[False, True], na_position="last")
        sets = [(i, frozenset(v), [i]) for i, v in zip(pdf[id_col], pdf[values])]

        def fit(a: int, b: int) -> bool:
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            return both > 0 and both >= threshold * (len(x) + len(y) - both)

        def join(a: int, b: int) -> None:
            sets[a] = (sets[a][0], sets[a][1] | sets[b][1], sets[a][2] + sets[b][2])
            del sets[b]

        a = 0
        while a < len(sets):
            b = next((b for b in range(a + 1, len(sets)) if fit(a, b)), None)
            if b is None:
                a += 1
                continue
            join(a, b)
            # the grown set may now fit one before it, the first of which takes it
            while (low := next((x for x in range(a) if fit(x, a)), None)) is not None:
                join(low, a)
                a = low
        head = {k: [pdf[k].iloc[0]] * len(sets) for k in key}
        return pd.DataFrame(head | {id_col: [s[0] for s in sets], "members": [sorted(s[2]) for s in sets], "n_items": [len(s[1]) for s in sets]})

    return grouped_kernel(df.select(*key, id_col, score, values), key, schema, run)


def farthest_points(df: DataFrame, key: list[str], id_col: str, axes: list[str], k: int) -> DataFrame:
    """(key, id, step): farthest point sampling from the smallest id; ties go to the smallest id."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*key, id_col]) + ", step int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=axes).sort_values(id_col)
        xyz = pdf[axes].to_numpy(dtype=float)
        if not len(xyz):
            return pdf[[*key, id_col]].assign(step=pd.Series(dtype="int32"))
        picked, far = [0], ((xyz - xyz[0]) ** 2).sum(axis=1)
        while len(picked) < min(k, len(xyz)):
            nxt = int(np.argmax(far))
            picked.append(nxt)
            far = np.minimum(far, ((xyz - xyz[nxt]) ** 2).sum(axis=1))
        return pdf.iloc[picked][[*key, id_col]].assign(step=np.arange(len(picked), dtype=np.int32))

    return grouped_kernel(df.select(*key, id_col, *axes), key, schema, run)


def diverse_views(df: DataFrame, key: list[str], id_col: str, quality: str, values: str, k: int, new_weight: float = 0.5, overlap_weight: float = 0.5) -> DataFrame:
    """(key, id, step): pick views one by one by quality + new_weight x new share - overlap_weight x largest overlap with a picked view."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*key, id_col]) + ", step int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col).reset_index(drop=True)
        sets = [set(v) for v in pdf[values]]
        seen: set = set()
        picked: list[int] = []
        while len(picked) < min(k, len(sets)):
            best, at = -np.inf, -1
            for i, s in enumerate(sets):
                if i in picked:
                    continue
                new = len(s - seen) / len(s) if s else 0.0
                overlap = max((len(s & sets[j]) / max(1, min(len(s), len(sets[j]))) for j in picked), default=0.0)
                gain = (pdf[quality][i] or 0.0) + new_weight * new - overlap_weight * overlap
                if gain > best:
                    best, at = gain, i
            picked.append(at)
            seen |= sets[at]
        return pdf.iloc[picked][[*key, id_col]].assign(step=np.arange(len(picked), dtype=np.int32))

    return grouped_kernel(df.select(*key, id_col, quality, values), key, schema, run)


def segment_graph(edges: DataFrame, key: list[str], left: str, right: str, weight: str, k: float, least: int) -> DataFrame:
    """(key, node, segment): graph segmentation - edges by weight; two parts merge if the edge is at most both inner limits.

    A part's limit is its largest inner edge + k / size. Then edges in the same order merge parts under least nodes. Segments are
    named after their smallest node. Strictly sequential in the order of edges, so a key is one task.
    """
    fields = {f.name: f.dataType.simpleString() for f in edges.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in key) + f", node {fields[left]}, segment {fields[left]}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([weight, left, right], kind="stable")
        root = {n: n for n in pd.concat([pdf[left], pdf[right]]).unique()}
        size, inner = dict.fromkeys(root, 1), dict.fromkeys(root, 0.0)

        def top(n):
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        def join(a, b, w):
            low, high = (a, b) if a < b else (b, a)
            root[high] = low
            size[low] += size[high]
            inner[low] = max(inner[a], inner[b], w)

        for a, b, w in zip(pdf[left], pdf[right], pdf[weight]):
            x, y = top(a), top(b)
            if x != y and w <= min(inner[x] + k / size[x], inner[y] + k / size[y]):
                join(x, y, w)
        for a, b, w in zip(pdf[left], pdf[right], pdf[weight]):
            x, y = top(a), top(b)
            if x != y and min(size[x], size[y]) < least:
                join(x, y, w)
        nodes = sorted(root)
        head = {c: [pdf[c].iloc[0]] * len(nodes) for c in key}
        return pd.DataFrame(head | {"node": nodes, "segment": [top(n) for n in nodes]})

    return grouped_kernel(edges.select(*key, left, right, weight), key, schema, run)


def overlap_filter(pairs: DataFrame, rows: DataFrame, key: list[str], id_col: str, threshold: float) -> DataFrame:
    """Rows that aren't the later one of any pair whose overlap, over the earlier set's size, is above threshold.

    pairs: key, a < b, inter, size_a. A dropped row still blocks later ones: no iteration.
    """
    hit = pairs.where(F.col("inter") / F.col("size_a") > threshold).select(*key, F.col("b").alias(id_col)).distinct()
    return rows.join(hit, [*key, id_col], "left_anti")


def running_budget(df: DataFrame, group: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows of each group, in order, while the running sum of cost stays within the budget; a hot group isn't brought into one task."""
    return running_totals(df, group, order, {"__sum": ("sum", cost)}).where(F.col("__sum") <= budget).drop("__sum")
