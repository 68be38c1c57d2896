"""Registered queries of the subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.groups import connected_groups
from graphloom.llm.leaks import leaked_items, reparameterised
from graphloom.llm.names import same_name_pairs
from graphloom.llm.sentences import sentence_units
from graphloom.llm.tokenizer import encode_texts, round_trip
from graphloom.llm.vectors import similar_pairs
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return similar_pairs(table(spark, directory, "fact_embeddings"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return same_name_pairs(table(spark, directory, "extracted_entities"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    edges = table(spark, directory, "edge_mutations").where(F.col("edge_type").isin("MERGED_INTO", "SUPERSEDES"))
    return connected_groups(edges, "src", "dst", by=["edge_type"])


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode_texts(table(spark, directory, "documents"))


def p6_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    return round_trip(table(spark, directory, "documents"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return leaked_items(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


def p7_reparameterised(spark: SparkSession, directory: str) -> DataFrame:
    return reparameterised(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return sentence_units(table(spark, directory, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_found": p7_found, "p7_reparameterised": p7_reparameterised, "p8_found": p8_found}

SQL = {
    "p1_found": """with raw as (
  select fact_id, any_value(embedding) as e from fact_embeddings
  where is_active and len(embedding) = 96 and fact_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
  group by fact_id),
v as (select fact_id, list_transform(e, lambda x: x::double) as e from raw),
u as (select fact_id, e, sqrt(list_inner_product(e, e)) as n from v),
s as (select a.fact_id as a, b.fact_id as b, round(list_inner_product(a.e, b.e) / (a.n * b.n), 9) as c from u a join u b on a.fact_id <> b.fact_id),
r as (select a, b from s qualify row_number() over (partition by a order by c desc, b) <= 10)
select distinct least(a, b) as fact_id_a, greatest(a, b) as fact_id_b from r""",
    "p3_found": """with recursive e as (
  select distinct edge_type, src as a, dst as b from edge_mutations
  where edge_type in ('MERGED_INTO', 'SUPERSEDES') and src is not null and dst is not null),
ends as (select * from e union select edge_type, b, a from e),
reach as (
  select distinct edge_type, a as vertex_id, a as other from ends
  union
  select r.edge_type, r.vertex_id, ends.b from reach r join ends on ends.edge_type = r.edge_type and ends.a = r.other)
select edge_type, vertex_id, min(other) as group_id from reach group by edge_type, vertex_id""",
}
