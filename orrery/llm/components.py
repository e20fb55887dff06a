"""Connected components of a graph that is spread over the cluster.

Alternates large-star and small-star steps until nothing changes; each step's edges
are written to the shared folder. The tables that hold each node's least neighbour
are written too, so that a node with very many neighbours can be split among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.llm.store import discard, settled


def _least(edges: DataFrame) -> DataFrame:
    """The least node among each node and its neighbours."""
    return settled(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours go to the least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    out = settled(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, go to the least one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = settled(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    discard(least)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of its component) of every node with an edge.

    edges: u, v (long). Loops and repeated edges do no harm.
    """
    now = settled(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        large = _large_star(now)
        small = _small_star(large)
        discard(now, large)
        now = small
        before, state = state, _state(now)
        if state == before:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
