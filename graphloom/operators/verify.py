"""Statistics, digests and self-checks of a graph's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.scan import degrees
from graphloom.operators.traverse import bfs, walks_from


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram_summary(df: DataFrame, column: str) -> DataFrame:
    """rows, distinct_values, most_common of a column's present values."""
    return histogram(df, column).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_values"), F.coalesce(F.max("n"), F.lit(0)).alias("most_common")
    )


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def label_counts(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def property_counts(rows: DataFrame, *properties: str) -> DataFrame:
    """property, value (as text), n: how many rows have each present value; one pass over the rows for all properties."""
    pairs = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties])
    return rows.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("property", "value").agg(F.count(F.lit(1)).alias("n"))


def digest(edges: DataFrame) -> DataFrame:
    """edge_type, edges, edge_digest, out_digest, in_digest: order-free checksums of the edge set and its degree maps, the
    sums of 32 bits of SHA-256 of each entry as decimal text."""
    total = lambda *of: F.sum(F.conv(F.substring(F.sha2(F.concat_ws(",", *of), 256), 1, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    pairs = edges.select("edge_type", "src", "dst").distinct()
    base = pairs.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), total("src", "dst").alias("edge_digest"))
    side = lambda incoming, name: degrees(pairs, incoming).groupBy("edge_type").agg(total("vertex", "degree").alias(name))
    return base.join(side(False, "out_digest"), "edge_type").join(side(True, "in_digest"), "edge_type")


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, with their multiplicity: side, the columns."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("extra")))


def degree_repairs(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """edge_type, vertex, stored, actual where a stored degree(edge_type, vertex, degree) is wrong or missing."""
    actual = degrees(edges).select("edge_type", "vertex", F.col("degree").alias("actual"))
    both = stored.select("edge_type", "vertex", F.col("degree").alias("stored")).join(actual, ["edge_type", "vertex"], "full")
    return both.where("coalesce(stored, 0) <> coalesce(actual, 0)").select("edge_type", "vertex", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("actual", F.lit(0)).alias("actual"))


def dangling_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edge_type, end, n: distinct ends of edges that have no vertex row."""
    ends = edges.select("edge_type", F.explode(F.array(F.struct(F.lit("src").alias("end"), F.col("src").alias("id")), F.struct(F.lit("dst").alias("end"), F.col("dst").alias("id")))).alias("e"))
    return ends.select("edge_type", "e.end", "e.id").distinct().join(vertices.select("id"), "id", "left_anti").groupBy("edge_type", "end").agg(F.count(F.lit(1)).alias("n"))


def traversals(edges: DataFrame, edge_type: str, starts: DataFrame, hops: int) -> DataFrame:
    """v, by_levels, by_walks: the hop of each vertex by breadth-first search and its shortest walk, the starts left out."""
    levels = bfs(starts, edges, edge_type, hops)
    levels = levels.select("v", F.col("hop").alias("by_levels"))
    roots = starts.select(F.col("v").alias("root"))
    walks = [walks_from(roots, edges, edge_type, h, h).select("v", F.lit(h).alias("hop")).distinct() for h in range(1, hops + 1)]
    shortest = reduce(DataFrame.unionByName, walks).groupBy("v").agg(F.min("hop").alias("by_walks")).join(starts.select("v"), "v", "left_anti")
    return levels.join(shortest, "v", "full")


def traversal_check(edges: DataFrame, edge_type: str, starts: DataFrame, hops: int) -> DataFrame:
    """The rows of traversals() that disagree; none for a sound pair."""
    return traversals(edges, edge_type, starts, hops).where(~F.col("by_levels").eqNullSafe(F.col("by_walks")))
