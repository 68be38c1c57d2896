"""Simple paths between vertices, ranked by weight, cost and length.

Paths grow hop by hop as rows (source, nodes, relationships, weight, cost). Before the search, vertices from which no
target can be reached in the hops that are left are pruned by a backward breadth-first pass, so only paths that can still
arrive are extended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from graphloom.operators.traverse import adjacency, check_hops
from graphloom.session import cut


def simple_paths(
    edges: DataFrame,
    edge_types: str | list[str],
    sources: DataFrame,
    targets: DataFrame | None = None,
    max_len: int = 4,
    direction: str = "outgoing",
    weight: str | None = None,
    cost: str | None = None,
    max_cost: float | None = None,
    pairwise: bool = False,
) -> DataFrame:
    """source, target, nodes, rels, length, weight, cost of every path without repeated vertices.

    sources and targets: DataFrames with column v. Without targets a path may end anywhere. Missing weights count as 1,
    missing costs as 0, and sums of whole numbers stay whole; paths over max_cost are left out. pairwise keeps pairs with source < target. Parallel edge rows
    give a path each; `rels` holds relationship_id where the edges have one, else (edge_type, src, dst).
    """
    check_hops(1, max_len)
    steps = adjacency(edges, edge_types, direction)
    rel = F.struct(*[F.col(c) for c in ("edge_type", "src", "dst", "relationship_id") if c in steps.columns])
    number = lambda name, default: F.coalesce(F.col(name).cast(_number_type(steps, name)), F.lit(default)) if name else F.lit(default)
    steps = steps.select("a", "b", rel.alias("rel"), number(weight, 1).alias("w"), number(cost, 0).alias("c"))
    kinds = {c: steps.schema[c].dataType.simpleString().replace("int", "bigint").replace("bigbigint", "bigint") for c in ("w", "c")}
    # A path over the limit may only be dropped early by what the hops that are left can't bring back.
    least = min(0.0, float(steps.agg(F.min("c")).first()[0] or 0)) if max_cost is not None else 0.0
    ends = targets.select(F.col("v").alias("target")).distinct() if targets is not None else None
    near = _distance_to(steps, ends, max_len) if ends is not None else None
    paths = sources.select("v").where("v is not null").distinct().select(
        F.col("v").alias("source"), F.col("v").alias("last"), F.array("v").alias("nodes"), F.array().cast(f"array<{steps.schema['rel'].dataType.simpleString()}>").alias("rels"),
        F.lit(0).cast(kinds["w"]).alias("weight"), F.lit(0).cast(kinds["c"]).alias("cost"),
    )
    found = []
    for hop in range(1, max_len + 1):
        grown = paths.join(steps, paths["last"] == steps["a"]).where(~F.array_contains("nodes", F.col("b")))
        paths = grown.select(
            "source", F.col("b").alias("last"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"),
            (F.col("weight") + F.col("w")).alias("weight"), (F.col("cost") + F.col("c")).alias("cost"),
        )
        if max_cost is not None:
            paths = paths.where(F.col("cost") + (max_len - hop) * least <= max_cost)
        if near is not None:
            left = near.where(F.col("hops") <= max_len - hop).select(F.col("v").alias("last"))
            paths = paths.join(left, "last", "left_semi")
        if hop % 3 == 0 and hop < max_len:
            paths = cut(paths)
        found.append(paths.withColumn("length", F.lit(hop)))
    whole = reduce(DataFrame.unionByName, found).withColumnRenamed("last", "target")
    if ends is not None:
        whole = whole.join(ends, "target", "left_semi")
    if max_cost is not None:
        whole = whole.where(F.col("cost") <= max_cost)
    if pairwise:
        whole = whole.where("source < target")
    return whole.select("source", "target", "nodes", "rels", "length", "weight", "cost")


def _number_type(df: DataFrame, name: str) -> str:
    return "bigint" if isinstance(df.schema[name].dataType, IntegralType) else "double"


def _distance_to(steps: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """v, hops: least number of steps from v to any target, up to `most`."""
    seen = ends.select(F.col("target").alias("v"), F.lit(0).alias("hops"))
    frontier = seen
    plain = steps.select("a", "b").distinct()
    for hop in range(1, most + 1):
        fresh = frontier.join(plain, frontier["v"] == plain["b"]).select(F.col("a").alias("v")).distinct()
        frontier = cut(fresh.join(seen, "v", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def ranked(paths: DataFrame, count: int = 1, per_target: bool = True) -> DataFrame:
    """The first `count` paths of each source and target (or of each source) by weight, cost, length, nodes and
    relationships, as `rank`; count = 0 keeps all that tie at the least weight."""
    by = ["source", "target"] if per_target else ["source"]
    w = Window.partitionBy(*by)
    order = w.orderBy("weight", "cost", "length", "nodes", "rels")
    if count == 0:
        least = paths.withColumn("_least", F.min("weight").over(w)).where(F.col("weight") == F.col("_least")).drop("_least")
        return least.withColumn("rank", F.row_number().over(order))
    return paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def fair_variants(paths: DataFrame, limit: int) -> DataFrame:
    """At most `limit` paths of each source and target, taken in turns from each node sequence, shorter lists giving way."""
    inner = Window.partitionBy("source", "target", "nodes").orderBy("weight", "cost", "rels")
    turns = paths.withColumn("turn", F.row_number().over(inner))
    outer = Window.partitionBy("source", "target").orderBy("turn", "length", "nodes")
    return turns.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= limit)


def load_relationships(paths: DataFrame, relationships: DataFrame, properties: list[str]) -> DataFrame:
    """Paths with `path_rels`: an array of struct(edge_type, src, dst, relationship_id, properties...) in order; nulls for
    records without a row. `rels` of the paths must carry relationship_id."""
    keyed = paths.withColumn("_path", F.xxhash64("source", "target", "nodes", F.to_json("rels")))
    each = keyed.select("_path", "source", F.posexplode("rels").alias("pos", "rel")).select("_path", "source", "pos", "rel.*")
    joined = each.join(relationships.select("relationship_id", *properties), "relationship_id", "left")
    fields = ["edge_type", "src", "dst", "relationship_id", *properties]
    lists = joined.groupBy("source", "_path").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("_rels"))
    lists = lists.withColumn("path_rels", F.transform("_rels", lambda r: F.struct(*[r[f].alias(f) for f in fields])))
    return keyed.join(lists.drop("_rels"), ["source", "_path"]).drop("_path")


def load_paths(paths: DataFrame, vertices: DataFrame, properties: list[str]) -> DataFrame:
    """Paths with `path_nodes`: an array of struct(id, properties...) in order; nulls for vertices without a row."""
    keyed = paths.withColumn("_path", F.xxhash64("source", "target", "nodes", F.to_json("rels")))
    each = keyed.select("_path", "source", F.posexplode("nodes").alias("pos", "id"))
    joined = each.join(vertices.select("id", *properties), "id", "left")
    lists = joined.groupBy("source", "_path").agg(F.array_sort(F.collect_list(F.struct("pos", "id", *properties))).alias("_nodes"))
    lists = lists.withColumn("path_nodes", F.transform("_nodes", lambda n: F.struct(n["id"].alias("id"), *[n[p].alias(p) for p in properties])))
    return keyed.join(lists.drop("_nodes"), ["source", "_path"]).drop("_path")
