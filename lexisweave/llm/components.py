"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't the least of its component; root is that least node.

    Each step replaces links by links to the least neighbour, through a minimum per node (summed before the shuffle)
    and an equi-join with one row per node on that side; no list of neighbours is gathered, so a node with very many
    links is no hot spot. Every round is written to the shared folder. Rounds grow with the logarithm of the
    longest chain. Loops and repeated links are allowed; no links give an empty result.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    links = materialize(links, "components")
    before = None
    for _ in range(max_rounds):
        links = materialize(_small_star(_large_star(links)), "components")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
    raise RuntimeError(f"no end after {max_rounds} rounds")


def _large_star(links: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node, and the node, to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and the node, to the least of them. Links are (larger u, smaller v)."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
