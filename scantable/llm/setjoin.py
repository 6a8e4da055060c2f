"""All pairs of set-valued records above a Jaccard threshold: one-bit minhash codes, multi-index join, exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scantable.common import cut, small_or_not


@dataclass(frozen=True)
class Plan:
    """Shape of the index: so many segments of so many bits, and the Hamming radius over the whole code."""

    bits: int
    segments: int
    radius: int


def bits_for(block: int) -> int:
    """Bits of a segment in a block of so many sets: unlike sets then meet a sixteenth of a time per segment and set."""
    return min(31, max(8, math.ceil(math.log2(max(1, block))) + 4))


def calibrate(threshold: float, recall: float, block: int | None = None) -> Plan:
    """The least number of segments and the least radius that keep a pair exactly at the threshold with the given recall.

    A one-bit minhash of two sets of Jaccard J agrees with probability (1 + J) / 2. The miss allowance is shared equally
    between: no segment agreeing in full (the pigeonhole step), and a Hamming distance beyond the radius. More
    similar pairs are missed less often, equal sets never. Segments have 16 bits, or as many as suit the size of the block
    (bits_for): few sets need few bits, and so few segments. At 0.8 and 0.9999: 18 segments of 8 bits, 49 of 16, 120 of 24.
    Recall is the same for all.
    """
    agree, miss = (1 + threshold) / 2, (1 - recall) / 2
    bits = 16 if block is None else bits_for(block)
    if agree >= 1:
        return Plan(bits, 2, 0)
    segments = max(1, math.ceil(math.log(miss) / math.log1p(-(agree**bits))))
    n = bits * segments
    tail, radius = 1.0, -1
    while tail > miss:
        radius += 1
        log = math.lgamma(n + 1) - math.lgamma(radius + 1) - math.lgamma(n - radius + 1)
        tail -= math.exp(log + radius * math.log(1 - agree) + (n - radius) * math.log(agree))
    return Plan(bits, segments, radius)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def codes(values: np.ndarray, offsets: np.ndarray, plan: Plan, seed: int = 7) -> np.ndarray:
    """int32 [sets, segments]: the one-bit minhashes of each set (values[offsets[i]:offsets[i+1]], none empty)."""
    n = plan.bits * plan.segments
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, n, dtype=np.uint32)
    base = (_mix(values) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(offsets) - 1, plan.segments), dtype=np.int32)
    starts = offsets[:-1]
    for k in range(n):
        least = np.minimum.reduceat(base * mult[k] + add[k], starts)
        # a minimum is small, and its low bits follow the multiplier: mix it, then take one bit
        bit = (_mix(least ^ add[k]) & np.uint64(1)).astype(np.int32)
        out[:, k // plan.bits] |= bit << np.int32(k % plan.bits)
    return out


@dataclass(frozen=True)
class SimilarSets:
    """classes: set_id, block, set; members: set_id, id; links: set_a < set_b, jaccard, of different sets."""

    classes: DataFrame
    members: DataFrame
    links: DataFrame


def similar_sets(df: DataFrame, id_col: str, block: list[str], values: Column, threshold: float = 0.8, recall: float = 0.9999) -> SimilarSets:
    """All pairs of different sets in the same block with a Jaccard of at least threshold, and who has which set.

    values: ARRAY<BIGINT>; nulls and repetitions are dropped, empty and null sets pair with nothing. A row with a null id
    or block is left out. Exact copies become one class first: however large a group of copies, it is one row in the join.
    Two sets of one id are two sets. Codes are cut into segments; sets meet where block and segment are equal - an
    equi-join, no block is compared with itself as a whole - and their sizes allow the threshold. Pairs within the
    calibrated Hamming radius are then held against the true sets: no false pair comes out, and a pair at the threshold is
    missed with probability 1 - recall.
    """
    has = F.col(id_col).isNotNull()
    for b in block:
        has = has & F.col(b).isNotNull()
    clean = F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))
    rows = df.where(has).select(F.col(id_col).alias("id"), *block, clean.alias("set")).where(F.size("set") > 0)
    # 128 bits stand for the set and its block
    name = (F.xxhash64(F.lit(1), "set", *block).alias("name1"), F.xxhash64(F.lit(2), *block, "set").alias("name2"))
    named = cut(rows.select(*name, *block, "set").groupBy("name1", "name2", *block).agg(F.first("set").alias("set")))
    # numbered over the written copy, so numbers are the same wherever they are used
    classes = named.withColumn("set_id", F.monotonically_increasing_id())
    members = rows.select(*name, "id").distinct().join(classes.select("name1", "name2", "set_id"), ["name1", "name2"]).select("set_id", "id")

    sizes = cut(classes.groupBy(*block).agg(F.count(F.lit(1)).alias("in_block")))
    blocked = classes.join(small_or_not(sizes), block) if block else classes.crossJoin(F.broadcast(sizes))
    bits = F.least(F.lit(31), F.greatest(F.lit(8), F.ceil(F.log2(F.col("in_block").cast("double"))) + 4)).cast("int")
    plans = {p.bits: p for p in (calibrate(threshold, recall, 1 << n) for n in range(28))}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                wide = part.column("bits").to_numpy()
                for width in np.unique(wide):
                    plan, some = plans[int(width)], part.filter(pa.array(wide == width))
                    sets = some.column("set")
                    flat, offsets = sets.flatten().to_numpy(), sets.offsets.to_numpy().astype(np.int64)
                    code = codes(flat, offsets - offsets[0], plan)
                    ends = np.arange(0, code.size + 1, plan.segments, dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(code.ravel()))
                    yield pa.RecordBatch.from_arrays([some.column("set_id"), pa.array(np.diff(offsets).astype(np.int32)), some.column("block"), some.column("bits"), lists], names=["set_id", "n", "block", "bits", "code"])

    blocked = blocked.select("set_id", F.xxhash64(*block).alias("block") if block else F.lit(0).cast("long").alias("block"), bits.alias("bits"), "set")
    coded = cut(blocked.mapInArrow(encode, "set_id long, n int, block long, bits int, code array<int>"))
    probes = coded.select("set_id", "n", "block", F.posexplode("code").alias("at", "segment"))
    keyed = probes.select(F.xxhash64("block", "at", "segment").alias("key"), "set_id", "n")
    left = keyed.toDF("key", "set_a", "na")
    right = keyed.toDF("key", "set_b", "nb")
    fit = (F.col("set_a") < F.col("set_b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * (threshold - 1e-9))
    pairs = left.join(right, "key").where(fit).select("set_a", "set_b").distinct()
    apart = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    radius = F.create_map(*[F.lit(x) for p in plans.values() for x in (p.bits, p.radius)])[F.col("bits")]
    code_a = coded.select(F.col("set_id").alias("set_a"), F.col("code").alias("ca"), F.col("block").alias("ba"), "bits")
    code_b = coded.select(F.col("set_id").alias("set_b"), F.col("code").alias("cb"), F.col("block").alias("bb"))
    close = pairs.join(code_a, "set_a").join(code_b, "set_b").where((F.col("ba") == F.col("bb")) & (apart <= radius)).select("set_a", "set_b")
    set_a = classes.select(F.col("set_id").alias("set_a"), F.struct(*block, F.lit(0)).alias("ka"), F.col("set").alias("sa"))
    set_b = classes.select(F.col("set_id").alias("set_b"), F.struct(*block, F.lit(0)).alias("kb"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    checked = close.join(set_a, "set_a").join(set_b, "set_b").where("ka = kb").select("set_a", "set_b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    # both / (sum - both) >= threshold in whole numbers: exactly the threshold counts
    limit = Fraction(str(threshold))
    fair = F.col("both").cast("long") * limit.denominator >= (F.col("sum") - F.col("both")).cast("long") * limit.numerator
    links = cut(checked.where(fair).select("set_a", "set_b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("jaccard")))
    return SimilarSets(classes.drop("name1", "name2"), members, links)


def similar_pairs(found: SimilarSets) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids that the classes and links stand for, those of copies among them."""
    a = found.members.select(F.col("set_id").alias("set_a"), F.col("id").alias("x"))
    b = found.members.select(F.col("set_id").alias("set_b"), F.col("id").alias("y"))
    between = found.links.join(a, "set_a").join(b, "set_b").select("x", "y")
    copies = a.join(b.withColumnRenamed("set_b", "set_a"), "set_a").where("x < y").select("x", "y")
    return between.union(copies).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def set_links(found: SimilarSets) -> DataFrame:
    """(id, set_id, n_copies, n_links): one row per id and set, with the ids of an equal set and the linked sets."""
    ends = found.links.select(F.col("set_a").alias("set_id")).union(found.links.select(F.col("set_b").alias("set_id")))
    degree = ends.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_links"))
    copies = found.members.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_copies"))
    out = found.members.join(copies, "set_id").join(degree, "set_id", "left")
    return out.select("id", "set_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
