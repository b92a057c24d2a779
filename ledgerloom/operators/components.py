"""Connected components over shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import lookup_weighted


def star_edges(keys: DataFrame, node: str, key_cols: list[str]) -> DataFrame:
    """Edges (u, v) from every record to the smallest record sharing a key: linear, not quadratic."""
    hubs = keys.groupBy(*key_cols).agg(
        F.min(node).alias("_hub"), F.count(F.lit(1)).alias("_weight")
    )
    shared = hubs.where("_weight > 1")
    joined = lookup_weighted(keys.select(node, *key_cols), shared, key_cols, "_weight")
    return (
        joined.where(F.col(node) != F.col("_hub"))
        .select(F.col(node).alias("u"), F.col("_hub").alias("v"))
        .distinct()
    )


#: up to this many edges no key can be hot enough to matter, and a plain join is cheaper
PLAIN_EDGES = 2_000_000


def _with_min(edges: DataFrame, mins: DataFrame, plain: bool) -> DataFrame:
    if plain:
        return edges.join(mins.select("u", "m"), "u")
    return lookup_weighted(edges, mins, ["u"], "w")


def _large_star(edges: DataFrame, plain: bool) -> DataFrame:
    """Connect every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = both.groupBy("u").agg(
        F.least(F.min("v"), F.first("u")).alias("m"),
        F.sum((F.col("v") > F.col("u")).cast("bigint")).alias("w"),
    )
    larger = both.where("v > u")
    return (
        _with_min(larger, mins.where("w > 0"), plain)
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame, plain: bool) -> DataFrame:
    """Connect a node and all its smaller neighbours to the smallest of them."""
    down = edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    mins = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w"))
    moved = (
        _with_min(down, mins.where("w > 1"), plain)
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
    )
    return moved.unionByName(mins.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component = smallest node.

    Alternating large-star / small-star rounds (Kiveris et al., "Connected Components in MapReduce
    and Beyond", 2014): a logarithmic number of rounds, edge count never grows. Each round is
    written to the checkpoint folder; only a count and a hash sum reach the driver.
    """
    current = cut_lineage(edges)
    seen = _fingerprint(current)
    while seen[0]:
        plain = seen[0] <= PLAIN_EDGES
        grown = cut_lineage(_large_star(current, plain))
        current = cut_lineage(_small_star(grown, plain))
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def label_records(records: DataFrame, keys: DataFrame, node: str, key_cols: list[str]) -> DataFrame:
    """``records`` plus ``component``; a record that shares nothing is its own component.

    The keys are read several times, so they should come from a written table.
    """
    found = components(star_edges(keys, node, key_cols)).withColumnRenamed("node", node)
    return records.join(found, node, "left").withColumn(
        "component", F.coalesce("component", F.col(node))
    )
