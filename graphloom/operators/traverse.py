"""Reachability: variable-length walks, breadth-first levels, and a base graph with changes on top.

A frontier is a DataFrame of (root, v) rows, deduplicated after each hop, so its size is bounded by roots x vertices and
not by the number of walks. Every few hops it is written out, so plans stay small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

MOST_HOPS = 16
CUT_EVERY = 4


def check_hops(low: int, high: int) -> None:
    if not 0 <= low <= high <= MOST_HOPS:
        raise ValueError(f"hops must satisfy 0 <= low <= high <= {MOST_HOPS}")


def adjacency(edges: DataFrame, edge_types: str | list[str], direction: str = "outgoing") -> DataFrame:
    """a, b, edge_type, src, dst (and further edge columns): steps that may be taken from a to b."""
    types = [edge_types] if isinstance(edge_types, str) else list(edge_types)
    kept = edges.where(F.col("edge_type").isin(types))
    out = kept.select(F.col("src").alias("a"), F.col("dst").alias("b"), "*")
    back = kept.select(F.col("dst").alias("a"), F.col("src").alias("b"), "*")
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return back
    if direction == "both":
        return out.unionByName(back)
    raise ValueError("direction is outgoing, incoming or both")


def _step(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    return frontier.join(steps, frontier["v"] == steps["a"]).select("root", F.col("b").alias("v")).distinct()


def walks_from(roots: DataFrame, edges: DataFrame, edge_type: str, low: int = 1, high: int = 1, by_hop: bool = False) -> DataFrame:
    """root, v (, hop): vertices at the end of walks of low to high edges from each root; cycles are followed.

    low = 0 includes the root itself, whether or not it has edges. Null roots are left out, repeated ones count once.
    """
    check_hops(low, high)
    steps = adjacency(edges, edge_type).select("a", "b").distinct()
    frontier = roots.where("root is not null").select("root", F.col("root").alias("v")).distinct()
    levels = [frontier.withColumn("hop", F.lit(0))] if low == 0 else []
    for hop in range(1, high + 1):
        frontier = _step(frontier, steps)
        if hop % CUT_EVERY == 0 and hop < high:
            frontier = cut(frontier)
        if hop >= low:
            levels.append(frontier.withColumn("hop", F.lit(hop)))
    found = reduce(DataFrame.unionByName, levels)
    return found if by_hop else found.select("root", "v").distinct()


def bfs(starts: DataFrame, edges: DataFrame, edge_types: str | list[str], hops: int, direction: str = "outgoing") -> DataFrame:
    """v, hop: vertices first met at each hop from a set of starts (column v), the starts themselves left out."""
    check_hops(0, hops)
    steps = adjacency(edges, edge_types, direction).select("a", "b").distinct()
    frontier = starts.select("v").where("v is not null").distinct()
    seen = frontier
    found: list[DataFrame] = []
    for hop in range(1, hops + 1):
        fresh = frontier.join(steps, frontier["v"] == steps["a"]).select(F.col("b").alias("v")).distinct().join(seen, "v", "left_anti")
        frontier = cut(fresh) if hop < hops else fresh
        found.append(frontier.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, found) if found else starts.select("v", F.lit(0).alias("hop")).limit(0)


def edge_visits(roots: DataFrame, edges: DataFrame, edge_type: str, hops: int) -> DataFrame:
    """hop, visits: edges looked at in each hop, the sum of the frontier's out-degrees."""
    levels = walks_from(roots, edges, edge_type, 0, max(0, hops - 1), by_hop=True)
    out = adjacency(edges, edge_type).select("a", "b").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    return levels.join(out, levels["v"] == out["a"]).groupBy((F.col("hop") + 1).alias("hop")).agg(F.sum("degree").alias("visits"))


def neighbours_within(edges: DataFrame, edge_type: str, allowed: DataFrame) -> DataFrame:
    """src, dst of edges whose far end is in `allowed` (column v)."""
    return edges.where(F.col("edge_type") == edge_type).join(allowed.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def latest_changes(delta: DataFrame) -> DataFrame:
    """edge_type, src, dst, exists: the newest state of each changed edge in a change log with `seq`."""
    return delta.groupBy("edge_type", "src", "dst").agg(F.max(F.struct("seq", "exists"))["exists"].alias("exists"))


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """edge_type, src, dst of the current edges: the base without changed edges, and the changed ones that exist."""
    on = ["edge_type", "src", "dst"]
    changed = latest_changes(delta)
    kept = base.select(*on).join(changed, on, "left_anti")
    return kept.unionByName(changed.where("exists").select(*on)).distinct()
