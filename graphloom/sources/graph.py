"""Property graphs as three DataFrames, and the graphs that the given tables hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import table


@dataclass
class Graph:
    """vertices(id, labels, properties...), edges(edge_type, src, dst, properties...; unique on the three), and
    relationships(edge_type, src, dst, relationship_id, properties...), the parallel records, where there are any."""

    vertices: DataFrame
    edges: DataFrame
    relationships: DataFrame | None = None


def memory_graph(spark: SparkSession, directory: str) -> Graph:
    """The conversation memory's graph from `vertices` and `edge_mutations`; rows with a missing end are no edges."""
    whole = table(spark, directory, "edge_mutations").where("src is not null and dst is not null and edge_type is not null")
    edges = whole.select("edge_type", "src", "dst").distinct()
    records = whole.select("edge_type", "src", "dst", F.col("mutation_id").alias("relationship_id"), "cell_id", "committed_at")
    return Graph(table(spark, directory, "vertices"), edges, records)


#: The code of each label in the ids of the order graph; id = code * 10^12 + key.
LABEL_CODES = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "Event": 8, "Document": 9, "Vec": 13}


def vertex_id(label: str, key) -> F.Column:
    return F.lit(LABEL_CODES[label] * 10**12).cast("bigint") + key.cast("bigint")


def order_graph(spark: SparkSession, directory: str) -> Graph:
    """Customers, orders, parts and places of the star schema as one graph.

    Edges: IN_REGION, IN_NATION, PLACED (customer to order), CONTAINS (order to part, with quantity and price) and
    SUPPLIED_BY (order to supplier). CONTAINS has parallel relationships.
    """
    t = lambda name: table(spark, directory, name)
    node = lambda df, label, key, name, amount: df.select(
        vertex_id(label, F.col(key)).alias("id"), F.array(F.lit(label)).alias("labels"), F.col(name).cast("string").alias("name"), amount.cast("double").alias("amount")
    )
    none = F.lit(None)
    parts = [
        node(t("region"), "Region", "r_regionkey", "r_name", none),
        node(t("nation"), "Nation", "n_nationkey", "n_name", none),
        node(t("customer"), "Customer", "c_custkey", "c_mktsegment", F.col("c_acctbal")),
        node(t("supplier"), "Supplier", "s_suppkey", "s_name", F.col("s_acctbal")),
        node(t("part"), "Part", "p_partkey", "p_brand", F.col("p_retailprice")),
        node(t("orders"), "Order", "o_orderkey", "o_orderstatus", F.col("o_totalprice")),
    ]
    vertices = parts[0]
    for more in parts[1:]:
        vertices = vertices.unionByName(more)
    edge = lambda df, kind, a, ka, b, kb: df.select(F.lit(kind).alias("edge_type"), vertex_id(a, F.col(ka)).alias("src"), vertex_id(b, F.col(kb)).alias("dst"))
    items = t("lineitem")
    edges = (
        edge(t("nation"), "IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey")
        .unionByName(edge(t("customer"), "IN_NATION", "Customer", "c_custkey", "Nation", "c_nationkey"))
        .unionByName(edge(t("supplier"), "IN_NATION", "Supplier", "s_suppkey", "Nation", "s_nationkey"))
        .unionByName(edge(t("orders"), "PLACED", "Customer", "o_custkey", "Order", "o_orderkey"))
        .unionByName(edge(items, "CONTAINS", "Order", "l_orderkey", "Part", "l_partkey").distinct())
        .unionByName(edge(items, "SUPPLIED_BY", "Order", "l_orderkey", "Supplier", "l_suppkey").distinct())
    )
    rows = items.select(
        F.lit("CONTAINS").alias("edge_type"),
        vertex_id("Order", F.col("l_orderkey")).alias("src"),
        vertex_id("Part", F.col("l_partkey")).alias("dst"),
        F.xxhash64(*items.columns).alias("relationship_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )
    return Graph(vertices, edges, rows)


def purchase_graph(spark: SparkSession, directory: str) -> DataFrame:
    """edges(edge_type, src, dst, weight, cost): from the user of a purchase to the user of the next one, a cyclic graph.

    The next purchase is looked up by day and by the first purchase of the following day that has one, so the order over
    all purchases is never sorted in one task.
    """
    from pyspark.sql import Window

    events = table(spark, directory, "events").where("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    inside = events.select("day", "user_id", "ts", "value", F.lead(F.struct("user_id", "ts")).over(w).alias("next"))
    first = events.groupBy("day").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("f"))
    days = first.select("day", F.lead("f").over(Window.orderBy("day")).alias("nf"))  # one row a day: bounded by the calendar
    steps = inside.join(days, "day", "left").select(
        F.col("user_id").alias("src"),
        F.coalesce("next.user_id", "nf.user_id").alias("dst"),
        F.coalesce("next.ts", "nf.ts").alias("to_ts"),
        "ts",
        "value",
    )
    steps = steps.where("dst is not null and src <> dst").withColumn("weight", (F.unix_micros("to_ts") - F.unix_micros("ts")) / 1e6)
    return steps.groupBy("src", "dst").agg(F.min("weight").alias("weight"), F.min("value").alias("cost")).select(
        F.lit("NEXT_USER").alias("edge_type"), "src", "dst", "weight", "cost"
    )
