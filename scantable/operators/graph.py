"""Connected components and what is asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantable.common import cut


def components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node linked to each node over undirected edges, by alternating star contraction.

    Large-star links every neighbour above a node to its smallest neighbour, small-star those below; edges shrink to stars
    around the components' minima in O(log^2 n) rounds. Both steps are one aggregation and one join; each is cut. nodes: one column
    with further nodes, those without an edge being alone. Edges with a null end are left out.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    ends = e.select("u").union(e.select("v")).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        # the edges are the same set if their number and two independent sums over their hashes are
        name = lambda seed: F.xxhash64(F.lit(seed), "u", "v")
        before, state = state, e.agg(F.count(F.lit(1)), F.bit_xor(name(1)), F.sum(F.shiftright(name(2), 24))).first()
        if state == before:
            break
    else:
        raise RuntimeError(f"not done after {max_rounds} rounds")
    if nodes is not None:
        ends = ends.union(nodes.select(F.col(nodes.columns[0]).alias("u"))).distinct().where("u is not null")
    return ends.join(e, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def keep_components(found: DataFrame, least: int, most: int) -> DataFrame:
    """The nodes of the largest components: up to most of those with at least so many nodes, or else the largest alone."""
    sizes = cut(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    big = sizes.where(F.col("size") >= least).orderBy(F.col("size").desc(), "component").limit(most)
    if big.isEmpty():
        big = sizes.orderBy(F.col("size").desc(), "component").limit(1)
    return found.join(big, "component")


def cluster_stats(edges: DataFrame, a: str, b: str, weight: str, found: DataFrame) -> DataFrame:
    """(component, n_nodes, n_edges, mean_weight, min_weight): statistics of the edges inside each component."""
    inside = edges.join(found.select(F.col("node").alias(a), "component"), a).groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"), F.avg(weight).alias("mean_weight"), F.min(weight).alias("min_weight"))
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes")).join(inside, "component", "left").select("component", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "mean_weight", "min_weight")
