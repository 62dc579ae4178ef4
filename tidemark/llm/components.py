"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _hooked(pairs: DataFrame) -> DataFrame:
    """Add m, the least neighbour of u. The minima are a table of their own, so that the join can split a hub's rows."""
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u").withColumn("m", F.least("m", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hooked(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # here each edge has u > v
    hooked = _hooked(edges)
    moved = hooked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(hooked.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(0xFFFFF))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge list; root is the component's least node.

    Edges are undirected; repeated ones, self-loops and rows with a null end change nothing (a node that has only
    self-loops isn't returned). No edges: an empty table. Each round is two joins on tables in the shared folder; what
    reaches the driver is a count and two checksums. RuntimeError if it has not settled after max_rounds.
    """
    u, v = F.col(src), F.col(dst)
    now = stored(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    before = _mark(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        now = stored(_small_star(stored(_large_star(now), "large")), "small")
        after = _mark(now)
        if after == before:
            # settled: every edge leads from a node to its root
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = after
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
