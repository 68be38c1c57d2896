"""Consolidating pairwise matches into groups by random graph contraction.

Each round every vertex hooks to the member of its closed neighbourhood that a fresh hash orders first, edges are relabelled
to the hooked vertices and deduplicated, and loops fall away. A constant share of the vertices vanishes in each round
whatever the shape of the graph, so long chains take logarithmically many rounds. The rounds' mappings, which shrink
geometrically, are then expanded backwards to the first vertices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, discard

#: A vertex with more edges than this, and than a thousandth of all, is relabelled by a broadcast of at most 2,000 rows.
HEAVY_EDGES = 50_000
HEAVY_SHARE = 1_000
MAX_ROUNDS = 200


def connected_groups(pairs: DataFrame, src: str, dst: str, by: Sequence[str] = ()) -> DataFrame:
    """by + vertex_id, group_id: the smallest vertex id tied to each vertex directly or over others, per `by`.

    Direction and repeats don't matter; a vertex paired only with itself is its own group; rows with a null end don't
    count; null `by` values are one value. Extra columns are ignored. Empty input gives no rows.
    """
    by = list(by)
    edges = pairs.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        *by, F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")
    ).distinct()
    edges = cut(edges)
    hooks: list[DataFrame] = []
    for number in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        hook = cut(_hook(edges, by, number))
        hooks.append(hook)
        former, edges = edges, cut(_relabel(edges, hook, by))
        discard(former)
    else:
        raise RuntimeError("edges are left after the last round")
    if not hooks:
        return edges.select(*by, F.col("u").alias("vertex_id"), F.col("v").alias("group_id"))
    mapping = hooks[-1].select(*by, "x", "r")
    for hook in reversed(hooks[:-1]):
        upper = mapping.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("x").alias("_x"), F.col("r").alias("_r"))
        mapping = hook.join(upper, _same(by, hook) & (hook["r"] == F.col("_x")), "left").select(
            *by, "x", F.coalesce("_r", "r").alias("r")
        )
    mapping = cut(mapping)
    smallest = mapping.groupBy(*by, "r").agg(F.min("x").alias("group_id"), F.count(F.lit(1)).alias("edges"))
    smallest = smallest.select(*by, F.col("r").alias("x"), F.col("group_id").alias("r"), "edges")
    # A giant group is named by a broadcast row, its vertices spread by their own id; the others meet by their root.
    limit = max(HEAVY_EDGES, mapping.count() // HEAVY_SHARE)
    ends = mapping.select(*by, F.col("r").alias("u"), F.col("x").alias("v"))
    return _replace(ends, smallest, by, "u", limit).select(*by, F.col("v").alias("vertex_id"), F.col("u").alias("group_id"))


def _same(by: list[str], df: DataFrame) -> Column:
    on = F.lit(True)
    for b in by:
        on = on & df[b].eqNullSafe(F.col(f"_{b}"))
    return on


def _hook(edges: DataFrame, by: list[str], number: int) -> DataFrame:
    """by, x, r, edges: the vertex that each vertex hooks to, itself included, and its number of edges."""
    order = lambda c: F.xxhash64(F.lit(number * 7919 + 17), F.col(c))
    both = edges.select(*by, F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("w")), F.struct(F.col("v").alias("x"), F.col("u").alias("w")))).alias("e"))
    both = both.select(*by, "e.x", "e.w")
    best = both.groupBy(*by, "x").agg(F.min(F.struct(order("w").alias("h"), F.col("w"))).alias("best"), F.count(F.lit(1)).alias("edges"))
    own = F.struct(order("x").alias("h"), F.col("x").alias("w"))
    return best.select(*by, "x", F.least(own, F.col("best"))["w"].alias("r"), "edges")


def _relabel(edges: DataFrame, hook: DataFrame, by: list[str]) -> DataFrame:
    ends = edges.where("u <> v")
    total = hook.agg(F.coalesce(F.sum("edges"), F.lit(0))).first()[0]
    limit = max(HEAVY_EDGES, total // HEAVY_SHARE)
    for end in ("u", "v"):
        ends = _replace(ends, hook, by, end, limit)
    return ends.where("u <> v").select(*by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _replace(edges: DataFrame, hook: DataFrame, by: list[str], end: str, limit: int) -> DataFrame:
    """Relabel one end. Edges of heavy vertices keep their place and take the label from a broadcast of bounded size."""
    named = hook.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("x").alias("_x"), F.col("r").alias("_r"), "edges")
    heavy = named.where(F.col("edges") > limit).drop("edges").withColumnsRenamed({"_x": "_hx", "_r": "_hr", **{f"_{b}": f"_h{b}" for b in by}})
    light = named.where(F.col("edges") <= limit).drop("edges")
    on_heavy = F.lit(True)
    for b in by:
        on_heavy = on_heavy & edges[b].eqNullSafe(F.col(f"_h{b}"))
    marked = edges.join(F.broadcast(heavy), on_heavy & (edges[end] == F.col("_hx")), "left")
    marked = marked.select(*by, "u", "v", "_hr")
    # A heavy vertex has no light row; its rows are spread over partitions by their other end.
    other = "v" if end == "u" else "u"
    key = F.when(F.col("_hr").isNull(), F.col(end)).otherwise(-1 - F.abs(F.xxhash64(other)) % 1_000_003)
    marked = marked.withColumn("_key", key)
    out = marked.join(light, _same(by, marked) & (F.col("_key") == F.col("_x")) & F.col("_hr").isNull(), "left")
    return out.select(*by, F.coalesce("_hr", "_r").alias(end), other).select(*by, "u", "v")
