"""Top N items within every group by merging sorted runs (loser tree, seek to the next group after N)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of one group a merging task holds before it merges what it has into one run; n more come on top.
HELD = 1 << 16


class LoserTree:
    """k-way merge of sorted sequences: each inner node holds the loser of its match, so a step costs log2(k) compares.

    Only the heads are read from the sequences: an item is looked at once, when it becomes the head of its run.
    """

    def __init__(self, runs: list[Sequence]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.heads = [run[0] if len(run) else None for run in runs]
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.nodes = [-1] * self.size
        self.winner = self._play(1)

    def _beats(self, a: int, b: int) -> bool:
        x = self.heads[a] if 0 <= a < len(self.heads) else None
        y = self.heads[b] if 0 <= b < len(self.heads) else None
        return x is not None and (y is None or x < y or (x == y and a < b))

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._play(2 * node), self._play(2 * node + 1)
        if self._beats(left, right):
            self.nodes[node] = right
            return left
        self.nodes[node] = left
        return right

    def pop(self):
        """The smallest head over all runs, or None at the end."""
        run = self.winner
        head = self.heads[run] if run < len(self.heads) else None
        if head is None:
            return None
        self.at[run] += 1
        self.heads[run] = self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None
        node = (run + self.size) // 2
        while node >= 1:
            if self._beats(self.nodes[node], run):
                self.nodes[node], run = run, self.nodes[node]
            node //= 2
        self.winner = run
        return head


class _Run(Sequence):
    """Rows start to end of a table as (key, row), made when they are asked for."""

    def __init__(self, columns: list[list], start: int, end: int):
        self.columns, self.start, self.end = columns, start, end

    def __len__(self) -> int:
        return self.end - self.start

    def __getitem__(self, i: int) -> tuple:
        row = self.start + i
        return tuple(c[row] for c in self.columns), row


class _Reversed:
    """Turns the order of a value round."""

    __slots__ = ("v",)

    def __init__(self, v):
        self.v = v

    def __lt__(self, other: _Reversed) -> bool:
        return other.v < self.v

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Reversed) and other.v == self.v


def order_keys(column: pa.ChunkedArray | pa.Array, down: bool) -> list[list]:
    """Two columns that compare as Spark orders the values: nulls last, NaN above all numbers, -0.0 as 0.0, texts by bytes."""
    kind, empty = column.type, column.is_null().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.is_null().to_numpy()
    if pa.types.is_floating(kind):
        x = np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64()).to_numpy(), dtype=np.float64) + 0.0
        bits = np.where(np.isnan(x), np.float64(np.nan), x).view(np.int64)
        bits = np.where(np.isnan(x), np.iinfo(np.int64).max, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))
        values = (~bits if down else bits).tolist()
    elif pa.types.is_integer(kind) or pa.types.is_boolean(kind) or pa.types.is_temporal(kind):
        whole = column.cast(pa.int32() if pa.types.is_date32(kind) else pa.int64()) if not pa.types.is_boolean(kind) else column.cast(pa.int8())
        x = pc.fill_null(whole, 0).to_numpy(zero_copy_only=False) if isinstance(whole, pa.Array) else pc.fill_null(whole, 0).to_numpy()
        values = (~x if down else x).tolist()
    else:
        texts = pa.types.is_string(kind) or pa.types.is_large_string(kind)
        values = column.cast(pa.binary()).to_pylist() if texts else column.to_pylist()
        if down:
            values = [_Reversed(v) for v in values]
    return [empty.tolist(), [None if e else v for e, v in zip(empty, values)] if empty.any() else values]


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Row numbers at which a new group starts (0 included)."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for name in names:
        col = batch.column(name)
        a, b = col.slice(0, n - 1), col.slice(1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(col.type):
            nan = pc.fill_null(pc.is_nan(col), False).to_numpy(zero_copy_only=False)
            same = same | (nan[1:] & nan[:-1])
        nulls = col.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | (nulls[1:] & nulls[:-1]))
    return np.flatnonzero(new)


def _key(batch: pa.RecordBatch, names: list[str], row: int) -> tuple:
    """The group of a row; NaN is itself here."""
    return tuple("NaN" if isinstance(v, float) and v != v else v for v in (batch.column(n)[row].as_py() for n in names))


def seek(batch: pa.RecordBatch, names: list[str], key: tuple) -> int:
    """The first row of a sorted batch behind the rows of a group it begins with, by bisection."""
    if _key(batch, names, batch.num_rows - 1) == key:
        return batch.num_rows
    low, high = 0, batch.num_rows - 1  # row high is of another group
    while low < high:
        mid = (low + high) // 2
        if _key(batch, names, mid) == key:
            low = mid + 1
        else:
            high = mid
    return low


def top_n(df: DataFrame, group: list[str], order: list[tuple[str, bool]], n: int) -> DataFrame:
    """The first n rows of every group, by order: (column, descending) pairs, ended by a unique id.

    1. Run building: every map task sorts its rows by (group, order) - one run - and writes at most n rows of a
       group; then it seeks to the next group, by whole batches and bisection. A group holding a third of all rows so gives at most n
       rows a task.
    2. Runs are bucketed by the hash of the group; in a bucket, the runs of a group are merged with a loser tree,
       which stops after n outputs and seeks to the next group. As the runs of a group arrive one behind the other, they are
       merged into one of n rows whenever HELD or 2 n rows are there: a task holds so much of one group, however many runs it has.

    Nulls: a null group is a group of its own, so is NaN; a null order value sorts last, ascending or descending, NaN above all
    numbers. Rows equal in all order columns are the same row to this operator: each copy counts. Extra columns are kept.
    Empty in, empty out. n < 1 gives no row.
    """
    if n < 1:
        return df.limit(0)
    cols = df.columns
    sort = [F.col(g).asc_nulls_first() for g in group]
    sort += [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    run_schema = T.StructType([*df.schema.fields, T.StructField("__run", T.LongType()), T.StructField("__at", T.LongType())])
    out_schema = df.schema

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        last, used = None, 0
        for batch in batches:
            if batch.num_rows and last is not None and used >= n and _key(batch, group, 0) == last:
                batch = batch.slice(seek(batch, group, last))
            if not batch.num_rows:
                continue
            starts = _changes(batch, group)
            carried = used if last is not None and _key(batch, group, 0) == last else 0
            ends = np.append(starts[1:], batch.num_rows)
            pos = np.arange(batch.num_rows) - np.repeat(starts, ends - starts)
            pos[: ends[0]] += carried
            last, used = _key(batch, group, batch.num_rows - 1), int(pos[-1]) + 1
            keep = np.flatnonzero(pos < n)
            if not len(keep):
                continue
            part = batch.take(pa.array(keep)) if len(keep) < batch.num_rows else batch
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.full(len(keep), run, dtype=np.int64)), pa.array(pos[keep].astype(np.int64))],
                names=[*cols, "__run", "__at"],
            )

    def merged(tab: pa.Table) -> pa.Table:
        """The first n rows of a group whose runs lie behind one another."""
        run = tab.column("__run").to_numpy()
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        if len(starts) <= 1:
            return tab.slice(0, n)
        columns = [k for c, down in order for k in order_keys(tab.column(c).combine_chunks(), down)]
        tree = LoserTree([_Run(columns, s, e) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), tab.num_rows])])
        picked = []
        while len(picked) < n and (head := tree.pop()) is not None:
            picked.append(head[1])
        return tab.take(pa.array(picked))

    def one_run(tab: pa.Table) -> pa.Table:
        """What is held of a group as one run, numbered so that it is none of those to come."""
        out = merged(tab)
        return out.set_column(out.column_names.index("__run"), "__run", pa.array(np.full(out.num_rows, -1, dtype=np.int64)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of the group that may go on
        rows, last = 0, None

        def out(tabs: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            if tabs:
                yield from pa.concat_tables(tabs).select(cols).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            tab = pa.Table.from_batches([batch])
            starts = _changes(batch, group)
            ends = np.append(starts[1:], batch.num_rows)
            done: list[pa.Table] = []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if s or (held and _key(batch, group, 0) != last):
                    if held:
                        done.append(merged(pa.concat_tables(held)))
                    held, rows = [], 0
                held.append(tab.slice(s, e - s))
                rows += e - s
            last = _key(batch, group, batch.num_rows - 1)
            if rows > max(HELD, 2 * n):
                held = [one_run(pa.concat_tables(held))]
                rows = held[0].num_rows
            yield from out(done)
        if held:
            yield from out([merged(pa.concat_tables(held))])

    runs = df.sortWithinPartitions(*sort).mapInArrow(build, run_schema)
    bucket = [F.col(g) for g in group]
    bucketed = runs.repartition(*bucket).sortWithinPartitions(*[b.asc_nulls_first() for b in bucket], "__run", "__at")
    return bucketed.mapInArrow(merge, out_schema)


def best_records(df: DataFrame, score: Column, n: int = 10) -> DataFrame:
    """(scene_name, record_id) of the first n records with a usable score per scene, by score, candidate and record."""
    rows = df.select("scene_name", "candidate_id", "record_id", score.alias("score")).where("score is not null and scene_name is not null")
    return top_n(rows, ["scene_name"], [("score", True), ("candidate_id", False), ("record_id", False)], n).select("scene_name", "record_id")
