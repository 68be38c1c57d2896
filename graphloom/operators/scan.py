"""Lookups in a property graph: by id, label, property and prefix, neighbours, existence and degrees.

All are plain filters and equi-joins, so column pruning and pushed filters reach the scan. Requests come as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import equal, starts_with


def seek(ids: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row for each requested id with its vertex columns, null where there is no such vertex: an id alone is not
    checked for existence. Null ids are left out; repeats stay."""
    return ids.where("id is not null").join(vertices, "id", "left")


def with_labels(vertices: DataFrame, *labels: str) -> DataFrame:
    """Vertices that have all of the labels; a null label set has none."""
    for label in labels:
        vertices = vertices.where(F.array_contains("labels", label))
    return vertices


def with_property(vertices: DataFrame, name: str, value: object) -> DataFrame:
    return vertices.where(equal(F.col(name), F.lit(value), vertices))


def with_prefix(vertices: DataFrame, name: str, prefix: str) -> DataFrame:
    return vertices.where(starts_with(F.col(name), prefix))


def first_by_text(vertices: DataFrame, name: str, prefix: str, n: int) -> DataFrame:
    """The first n vertices by a text property within a prefix, ties by id; a top-k, no global sort."""
    return with_prefix(vertices, name, prefix).orderBy(F.col(name).asc_nulls_last(), "id").limit(n)


def edges_of(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.where(F.col("edge_type") == edge_type)


def neighbours(edges: DataFrame, edge_type: str, vertex: int, incoming: bool = False) -> DataFrame:
    """Distinct neighbours of one vertex in order of id."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    return edges_of(edges, edge_type).where(F.col(here) == vertex).select(there).distinct().orderBy(there)


def neighbour_batch(requests: DataFrame, edges: DataFrame, edge_type: str, incoming: bool = False) -> DataFrame:
    """position, vertex, neighbours (sorted, distinct) for each request row (position, vertex); repeats kept, an empty
    array where there is none. Only requested vertices' edges are aggregated."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    wanted = requests.select(F.col("vertex").alias(here)).distinct()
    lists = edges_of(edges, edge_type).join(wanted, here, "left_semi").groupBy(F.col(here).alias("vertex")).agg(F.array_sort(F.collect_set(there)).alias("neighbours"))
    return requests.join(lists, "vertex", "left").select("position", "vertex", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def exists_batch(requests: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    """position, src, dst, exists for each request row (position, src, dst); a null end gives false."""
    live = edges_of(edges, edge_type).select("src", "dst").distinct().withColumn("_hit", F.lit(True))
    return requests.join(live, ["src", "dst"], "left").select("position", "src", "dst", F.coalesce("_hit", F.lit(False)).alias("exists"))


def degrees(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """edge_type, vertex, degree over distinct neighbours."""
    here = "dst" if incoming else "src"
    return edges.select("edge_type", "src", "dst").distinct().groupBy("edge_type", F.col(here).alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))


def to_segments(edges: DataFrame, seq: Column) -> DataFrame:
    """Adjacency segments edge_type, src, seq, destinations; bounded by splitting a vertex's list by dst hash."""
    part = F.pmod(F.xxhash64("dst"), F.lit(64))
    return edges.groupBy("edge_type", "src", part.alias("part"), seq.alias("seq")).agg(F.array_sort(F.collect_set("dst")).alias("destinations"))


def from_segments(segments: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Live edges of segments: an edge falls to a tombstone(edge_type, src, dst, seq) that is not older than its segment."""
    edges = segments.select("edge_type", "src", "seq", F.explode("destinations").alias("dst"))
    dead = tombstones.groupBy("edge_type", "src", "dst").agg(F.max("seq").alias("dead_seq"))
    on = ["edge_type", "src", "dst"]
    kept = edges.join(dead, on, "left").where("dead_seq is null or dead_seq < seq")
    return kept.select(*on).distinct()
