"""Connected components by alternating large-star and small-star rounds, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, joined_hot, kept

#: From so many edges on, a round looks for nodes with much of all edges and spreads those: below, no task is heavy.
HUB_EDGES = 5_000_000


def _star(edges: DataFrame, large: bool, hubs: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of them and itself: the larger ones, or the others."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # a < b always: only the larger end looks at its smaller neighbours
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    if hubs:
        least = cut(least)
        joined = joined_hot(both, least, "n", {"u": "u"}, ["m"], F.xxhash64("v"))
    else:
        joined = both.join(least.drop("n"), "u")
    if large:
        out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a < b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) of every node of ``edges`` (a < b, longs).

    Each round keeps the components and shortens the paths; it ends when a round changes no edge. Edges stay
    distributed, in a folder per round, of which only the last is left; a row count and a checksum reach the driver.
    """
    told = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
    edges, folder = kept(edges.select("a", "b"), "edges")
    seen = told(edges)
    for _ in range(max_rounds):
        hubs = seen[0] >= HUB_EDGES
        edges, new = kept(_star(_star(edges, True, hubs), False, hubs), "edges")
        drop(folder)
        folder, now = new, told(edges)
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
