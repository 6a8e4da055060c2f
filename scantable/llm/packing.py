"""Filling fixed-capacity containers: sum-of-squares online packing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items one packing stream gets on average. A fixed number: the share of room lost in the last, partly filled
#: containers of a stream is the same at every size of the input.
STREAM_ITEMS = 20_000


class SumOfSquares:
    """Online packing that keeps the sum over fill levels of (partly filled containers at that level)**2 as small as it can.

    count[h] is the number of open containers filled to h. Placing an item of size s into one at level h (0: a
    new one) moves it to h + s, and full ones leave the sum. The level with the least resulting sum is taken, the
    fuller one on a tie.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, offset) of an item of 1 to capacity units."""
        c, n = self.capacity, self.count
        top = c - size
        # change of the sum: -2 n[h] + 1 for leaving h, 2 n[h + size] + 1 for arriving, nothing at level 0 or c
        leave = 1 - 2 * n[: top + 1]
        leave[0] = 0
        arrive = 2 * n[size : c + 1] + 1
        arrive[top] = 0
        cost = leave + arrive
        usable = n[: top + 1] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        h = top - int(np.argmin(cost[::-1]))
        if h:
            box, _ = self.open[h].pop()
            n[h] -= 1
        else:
            box, self.made = self.made, self.made + 1
        if h + size < c:
            n[h + size] += 1
            self.open[h + size].append((box, h + size))
        return box, h


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = 2048, stream_items: int = STREAM_ITEMS, seed: int = 11) -> DataFrame:
    """(id, piece, container_id, at, size): where each item goes; at is the offset in the container.

    An item longer than the capacity is cut into full containers and a rest, pieces 0, 1, ...; no other item is cut.
    Items are dealt to streams by the hash of (id, size) and packed there in hash order, so the result is the same on
    every run and after a lost executor; a stream is one task, and only ids and sizes are shuffled. Ids are unique; were one repeated, each of its
    rows would be packed, in the same stream. The number of streams follows the number of items.
    An item of size 0, negative or null needs no room: one row with a null container. Empty in, empty out.
    """
    total = items.count()
    streams = max(1, math.ceil(total / stream_items))
    at_hash = F.xxhash64(F.lit(seed), F.col(id_col), F.col(size_col))
    dealt = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"), at_hash.alias("h"))
    # equal rows have equal hashes; they differ by nothing that could tell them apart, so any order of them is the same
    dealt = dealt.withColumn("stream", F.pmod("h", F.lit(streams)).cast("int")).repartitionById(streams, "stream").sortWithinPartitions("stream", "h", "id", "size")
    id_type = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes, stream = SumOfSquares(capacity), -1
        for batch in batches:
            ids, pieces, where, offsets, sizes = [], [], [], [], []
            for row, (size, own) in enumerate(zip(batch.column("size").to_pylist(), batch.column("stream").to_pylist())):
                if own != stream:  # each stream has containers of its own, wherever it is packed
                    boxes, stream = SumOfSquares(capacity), own
                if size <= 0:
                    rest = [(0, None, None, 0)]
                else:
                    rest, piece = [], 0
                    while size > 0:
                        part = min(size, capacity)
                        box, at = boxes.place(part)
                        rest.append((piece, (stream << 40) + box, at, part))
                        size, piece = size - part, piece + 1
                for piece, box, at, part in rest:
                    ids.append(row)
                    pieces.append(piece)
                    where.append(box)
                    offsets.append(at)
                    sizes.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(ids, pa.int64())), pa.array(pieces, pa.int32()), pa.array(where, pa.int64()), pa.array(offsets, pa.int32()), pa.array(sizes, pa.int64())],
                names=["id", "piece", "container_id", "at", "size"],
            )

    return dealt.mapInArrow(run, f"id {id_type}, piece int, container_id long, at int, size long")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, units, full, mean_fill): how well the containers are filled."""
    each = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("size").alias("fill"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("units"), F.count_if(F.col("fill") == capacity).alias("full"), F.avg(F.col("fill") / capacity).alias("mean_fill"))
