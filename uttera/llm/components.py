"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, are tied to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(low.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    ``links`` has two bigint columns, in any order and with repeats; nulls and loops are ignored. The
    number of rounds grows with the logarithm of the longest chain. A node with very many links is
    combined before the shuffle (the minima) and split by adaptive skew joins (the edges). Every round
    ends in a reliable checkpoint, so a lost executor costs one round.
    """
    a, b = links.columns
    edges = (
        links.filter(f"`{a}` <> `{b}`")
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges = cut_lineage(edges)
    before = None
    while (now := _signature(edges)) != before:
        before = now
        edges = cut_lineage(_small_star(_large_star(edges).distinct()).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
