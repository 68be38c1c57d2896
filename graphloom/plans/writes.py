"""Queries: mutations, statistics, verification, streaming (inventory M, A08-A12, X, R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import mutate, verify
from graphloom.operators.scan import degrees
from graphloom.plans.lookups import EDGES
from graphloom.session import cut, scratch_folder
from graphloom.sources.graph import memory_graph
from graphloom.sources.tables import table
from graphloom.streaming import feeds

RAW = "src is not null and dst is not null and edge_type is not null"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, d, "edge_mutations").where(RAW)
    return raw.where("cell_id = 'cell-00'"), raw.where("cell_id <> 'cell-00' or cell_id is null")


def m01_create(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    records = old.select("edge_type", "src", "dst", F.col("mutation_id").alias("relationship_id"))
    out = mutate.create_relationships(records, new.select("edge_type", "src", "dst", "mutation_id"), ["mutation_id"])
    # New ids are any numbers above the old ones, so a new record shows the mutation that it comes from.
    top = records.agg(F.max("relationship_id").alias("top"))
    marked = out.crossJoin(F.broadcast(top))  # one row
    return marked.select("edge_type", "src", "dst", F.coalesce("mutation_id", "relationship_id").alias("record"), (F.col("relationship_id") > F.col("top")).alias("created"))


def m02_merge(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    edges = old.groupBy("edge_type", "src", "dst").agg(F.min("mutation_id").alias("weight"))
    return mutate.merge_edges(edges, new.select("edge_type", "src", "dst", F.col("mutation_id").alias("weight")))


def m03_set(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices")
    return mutate.set_properties(v, v.where("context_id = 'ctx-04040404'"), "id", active=False).select("id", "active")


def m04_labels(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices")
    out = mutate.set_labels(v, v.where("not active"), add=["Hidden"], remove=["Archived"])
    return out.select("id", F.array_join(F.array_sort("labels"), ",").alias("labels"))


def m05_delete_edges(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    return mutate.delete_edges(e, e.where("edge_type = 'ABOUT' and dst % 3 = 0"))


def m06_detach_delete(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    _, e, r = mutate.delete_vertices(g.vertices, g.edges, g.vertices.where("not active").select("id"), detach=True, relationships=g.relationships)
    none = F.lit(None).cast("bigint").alias("relationship_id")
    return e.select("edge_type", "src", "dst", none).unionByName(r.select("edge_type", "src", "dst", "relationship_id"))


def m07_records(spark: SparkSession, d: str) -> DataFrame:
    """Deleting edges takes their records along."""
    g = memory_graph(spark, d)
    _, r = mutate.delete_edges_with_records(g.edges, g.relationships, g.edges.where("edge_type = 'SUPERSEDES' and dst % 3 = 0"))
    return r.select("relationship_id", "edge_type")


def m10_merge_set(spark: SparkSession, d: str) -> DataFrame:
    """MERGE of records by id with SET: known ones take the new cell where it is given, others are inserted."""
    rows = table(spark, d, "edge_mutations").where(RAW).select(F.col("mutation_id").alias("relationship_id"), "edge_type", "src", "dst", "cell_id")
    batch = rows.where("relationship_id % 3 = 0").withColumn("cell_id", F.when(F.col("relationship_id") % 2 == 0, F.concat(F.lit("moved-"), "cell_id")))
    return mutate.merge_relationships(rows.where("relationship_id % 5 <> 0"), batch)


def m09_upsert(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices")
    drafts = table(spark, d, "extracted_drafts").where("subject_id is not null")
    batch = mutate.coalesced(drafts.select(F.col("subject_id").alias("id"), F.array(F.lit("Subject")).alias("labels"), "context_id").distinct())
    out = mutate.upsert_vertices(v.select("id", "labels", "context_id", "active"), batch)
    return out.select("id", F.array_join(F.array_sort(F.coalesce("labels", F.array().cast("array<string>"))), ",").alias("labels"), "context_id", "active")


def m11_guarded(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "fact_embeddings").where("observed_at is not null").select("fact_id", "observed_at", "context_id", "source_chunk_id")
    old = facts.groupBy("fact_id").agg(F.min("observed_at").alias("observed_at"), F.min("context_id").alias("context_id"), F.min("source_chunk_id").alias("source_chunk_id"))
    later = table(spark, d, "scored_facts").where("observed_at is not null").select("fact_id", (F.col("observed_at") + F.col("question_id") % 3 - 1).alias("observed_at"), "context_id", F.col("speaker").alias("source_chunk_id"))
    return mutate.guarded_upsert(old, later, "fact_id", "observed_at", create_only=["context_id"]).select("fact_id", "observed_at", "context_id")


def m14_idempotent(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "edge_mutations").where(RAW)
    ledger = raw.where("cell_id = 'cell-04'").where("idempotency_key is not null").select("idempotency_key", F.sha2(F.to_json(F.struct("edge_type", "src", "dst")), 256).alias("digest")).distinct()
    fresh = mutate.idempotent(raw.select("idempotency_key", "edge_type", "src", "dst"), ledger, "idempotency_key", ["edge_type", "src", "dst"])
    return fresh


def m18_outcome(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices").select("id", "active")
    after = mutate.set_properties(v.where("id % 7 <> 0"), v.where("id % 2 = 0"), "id", active=True)
    return mutate.outcome(v, after, ["id"])


def n18_labelled_ends(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    return mutate.between_labels(g.edges.where("edge_type = 'ABOUT'"), g.vertices, "Fact", "Entity").select("edge_type", "src", "dst")


def a09_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices")
    return verify.histogram_summary(v, "context_id").withColumn("property", F.lit("context_id")).unionByName(verify.histogram_summary(v, "active").withColumn("property", F.lit("active")))


def a10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return verify.label_counts(table(spark, d, "vertices"))


def a10_property_values(spark: SparkSession, d: str) -> DataFrame:
    """Cardinality of property = value for vertices and edge records."""
    g = memory_graph(spark, d)
    of = lambda kind, df: df.withColumn("kind", F.lit(kind))
    records = g.relationships.withColumn("cell", F.concat_ws("/", "edge_type", "cell_id")).where("cell_id is not null")
    return of("vertex", verify.property_counts(g.vertices, "context_id", "active")).unionByName(of("edge", verify.property_counts(records, "cell")))


def a11_digest(spark: SparkSession, d: str) -> DataFrame:
    return verify.digest(memory_graph(spark, d).edges)


def a12_edge_types(spark: SparkSession, d: str) -> DataFrame:
    return verify.edge_type_counts(table(spark, d, "edge_mutations").where(RAW))


def x06_dangling(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    return verify.dangling_ends(g.edges, g.vertices)


def x06_traversals(spark: SparkSession, d: str) -> DataFrame:
    """Levels of breadth-first search and least lengths of walks side by side; they must be equal."""
    e = memory_graph(spark, d).edges
    starts = e.where("edge_type = 'SUPERSEDES' and src % 20 = 0").select(F.col("src").alias("v")).distinct()
    return verify.traversals(e, "SUPERSEDES", starts, 3)


def x07_repairs(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    stored = degrees(old.select("edge_type", "src", "dst"))
    return verify.degree_repairs(old.unionByName(new).select("edge_type", "src", "dst"), stored)


def u05_difference(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return verify.difference(old.select("edge_type", "src", "dst"), new.select("edge_type", "src", "dst")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def r02_latest(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.operators.traverse import latest_changes

    raw = table(spark, d, "edge_mutations").where(RAW)
    return latest_changes(raw.select("edge_type", "src", "dst", F.col("mutation_id").alias("seq"), (F.col("mutation_id") % 3 != 0).alias("exists")))


def r03_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The edges that a stream of changes has kept; equal to a full build."""
    import uuid

    place = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = feeds.table_stream(spark, d, "edge_mutations").where(RAW)
    changes = stream.select("edge_type", "src", "dst", F.col("mutation_id").alias("seq"), (F.col("mutation_id") % 3 != 0).alias("exists"))
    feeds.maintain_edges(changes, f"{place}/edges", f"{place}/progress")
    return feeds.current_edges(spark, f"{place}/edges")


def r01_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of the event table, as the streaming plan computes them over all rows."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = feeds.windowed_counts(events, "ts", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def r08_events(spark: SparkSession, d: str) -> DataFrame:
    return feeds.as_events(memory_graph(spark, d).edges.where("edge_type = 'HAS_ALIAS'"), "edge")


NAMES = "m01_create m02_merge m03_set m04_labels m05_delete_edges m06_detach_delete m07_records m09_upsert m10_merge_set m11_guarded m14_idempotent m18_outcome n18_labelled_ends a09_histogram a10_statistics a10_property_values a11_digest a12_edge_types x06_dangling x06_traversals x07_repairs u05_difference r01_daily_counts r02_latest r03_incremental r08_events"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_LIVE = f"select edge_type, src, dst, arg_max(mutation_id % 3 <> 0, mutation_id) as exists from edge_mutations where {RAW} group by all"
_DEG = "select edge_type, src as vertex, count(distinct dst) as degree from edge_mutations where {} group by all"
_SUM = "sum(('0x' || substr(sha256({0}), 1, 8))::bigint)::varchar"
SQL = {
    "m01_create": f"select edge_type, src, dst, mutation_id as record, (cell_id <> 'cell-00' or cell_id is null) as created from edge_mutations where {RAW}",
    "m07_records": f"select mutation_id as relationship_id, edge_type from edge_mutations where {RAW} and not (edge_type = 'SUPERSEDES' and dst % 3 = 0)",
    "m10_merge_set": f"""select mutation_id as relationship_id, edge_type, src, dst, case when mutation_id % 3 = 0 and mutation_id % 2 = 0 then coalesce('moved-' || cell_id, case when mutation_id % 5 <> 0 then cell_id end)
when mutation_id % 5 <> 0 then cell_id end as cell_id from edge_mutations where {RAW} and (mutation_id % 5 <> 0 or mutation_id % 3 = 0)""",
    "m02_merge": f"""with o as (select edge_type, src, dst, min(mutation_id) as w from edge_mutations where {RAW} and cell_id = 'cell-00' group by all),
n as (select edge_type, src, dst, max(mutation_id) as w from edge_mutations where {RAW} and (cell_id <> 'cell-00' or cell_id is null) group by all)
select edge_type, src, dst, coalesce(n.w, o.w) as weight from o full join n using (edge_type, src, dst)""",
    "m03_set": "select id, case when context_id = 'ctx-04040404' then false else active end as active from vertices",
    "m04_labels": "select id, array_to_string(list_sort(case when not active then list_distinct(list_append(list_filter(coalesce(labels, []), lambda x: x <> 'Archived'), 'Hidden')) else labels end), ',') as labels from vertices",
    "m05_delete_edges": f"with {EDGES} select * from edges where not (edge_type = 'ABOUT' and dst % 3 = 0)",
    "m06_detach_delete": f"with {EDGES}, g as (select id from vertices where not active) select *, null::bigint as relationship_id from edges where src not in (select id from g) and dst not in (select id from g) union all select edge_type, src, dst, mutation_id from edge_mutations where {RAW} and src not in (select id from g) and dst not in (select id from g)",
    "m09_upsert": """with s as (select subject_id as id, max(context_id) as context_id from extracted_drafts where subject_id is not null group by 1)
select coalesce(v.id, s.id) as id, array_to_string(list_sort(list_distinct(list_concat(coalesce(v.labels, []), case when s.id is null then [] else ['Subject'] end))), ',') as labels,
coalesce(s.context_id, v.context_id) as context_id, v.active from vertices v full join s on s.id = v.id""",
    "m11_guarded": """with o as (select fact_id, min(observed_at) as t, min(context_id) as c from fact_embeddings where observed_at is not null group by 1),
n as (select fact_id, max(observed_at + question_id % 3 - 1) as t, arg_max(context_id, observed_at + question_id % 3 - 1) as c from scored_facts where observed_at is not null group by 1)
select coalesce(o.fact_id, n.fact_id) as fact_id, case when o.fact_id is null then n.t else greatest(o.t, coalesce(n.t, o.t)) end as observed_at, case when o.fact_id is null then n.c else o.c end as context_id from o full join n on n.fact_id = o.fact_id""",
    "m14_idempotent": f"""with led as (select distinct idempotency_key as k from edge_mutations where {RAW} and cell_id = 'cell-04' and idempotency_key is not null),
f as (select distinct idempotency_key, edge_type, src, dst from edge_mutations where {RAW} and idempotency_key is not null and idempotency_key not in (select k from led))
select * from f union all select idempotency_key, edge_type, src, dst from edge_mutations where {RAW} and idempotency_key is null""",
    "m18_outcome": "select 0::bigint as created, count(*) filter (id % 7 = 0) as deleted, count(*) filter (id % 7 <> 0 and id % 2 = 0 and active is distinct from true) as updated, count(*) filter (id % 7 <> 0 and not (id % 2 = 0 and active is distinct from true)) as unchanged from vertices",
    "n18_labelled_ends": f"with {EDGES} select * from edges where edge_type = 'ABOUT' and src in (select id from vertices where list_contains(labels, 'Fact')) and dst in (select id from vertices where list_contains(labels, 'Entity'))",
    "a09_histogram": """with h as (select 'context_id' as property, context_id as v, count(*) as n from vertices where context_id is not null group by all union all select 'active', active::varchar, count(*) from vertices where active is not null group by all)
select property, sum(n)::bigint as rows, count(*) as distinct_values, max(n) as most_common from h group by property""",
    "a10_statistics": "select label, count(*) as n from (select unnest(labels) as label from vertices) group by label",
    "a10_property_values": f"""select 'vertex' as kind, 'context_id' as property, context_id as value, count(*) as n from vertices where context_id is not null group by all
union all select 'vertex', 'active', active::varchar, count(*) from vertices where active is not null group by all
union all select 'edge', 'cell', edge_type || '/' || cell_id, count(*) from edge_mutations where {RAW} and cell_id is not null group by all""",
    "a11_digest": f"""with {EDGES}, o as (select edge_type, src as v, count(*) as n from edges group by all), i as (select edge_type, dst as v, count(*) as n from edges group by all),
e as (select edge_type, count(*) as edges, {_SUM.format("src || ',' || dst")} as edge_digest from edges group by 1) select e.*, a.out_digest, b.in_digest from e
join (select edge_type, {_SUM.format("v || ',' || n")} as out_digest from o group by 1) a using (edge_type) join (select edge_type, {_SUM.format("v || ',' || n")} as in_digest from i group by 1) b using (edge_type)""",
    "a12_edge_types": f"select edge_type, count(*) as n from edge_mutations where {RAW} group by edge_type",
    "x06_dangling": f"""with {EDGES}, e as (select distinct edge_type, 'src' as "end", src as id from edges union all select distinct edge_type, 'dst', dst from edges)
select edge_type, "end", count(*) as n from e where id not in (select id from vertices) group by all""",
    "x06_traversals": f"""with recursive {EDGES}, e as (select src, dst from edges where edge_type = 'SUPERSEDES'), w(v, hop) as (select distinct src, 0 from e where src % 20 = 0 union select e.dst, w.hop + 1 from w join e on e.src = w.v where w.hop < 3)
select v, min(hop)::int as by_levels, min(hop)::int as by_walks from w where v not in (select src from e where src % 20 = 0) group by v""",
    "x07_repairs": f"""with s as ({_DEG.format(RAW + " and cell_id = 'cell-00'")}), a as ({_DEG.format(RAW)})
select a.edge_type, a.vertex, coalesce(s.degree, 0) as stored, a.degree as actual from a left join s using (edge_type, vertex) where coalesce(s.degree, 0) <> a.degree""",
    "u05_difference": f"""with a as (select edge_type, src, dst from edge_mutations where {RAW} and cell_id = 'cell-00'), b as (select edge_type, src, dst from edge_mutations where {RAW} and (cell_id <> 'cell-00' or cell_id is null))
select 'missing' as side, count(*) as n from (select * from a except all select * from b) having count(*) > 0 union all select 'extra', count(*) from (select * from b except all select * from a) having count(*) > 0""",
    "r01_daily_counts": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all",
    "r02_latest": _LIVE,
    "r03_incremental": f"select edge_type, src, dst from ({_LIVE}) where exists",
    "r08_events": f"""with {EDGES} select '{{"event":"edge","data":{{"edge_type":"' || edge_type || '","src":' || src || ',"dst":' || dst || '}}}}' as value from edges where edge_type = 'HAS_ALIAS'""",
}
