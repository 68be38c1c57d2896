"""Queries: further rows of the inventory that are compositions of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import entity_terms
from graphloom.operators import memory, mutate, paths, resolution, retrieval, scan
from graphloom.operators.changes import draft_changes
from graphloom.operators.match import Match, parallel_edges, union, window
from graphloom.operators.traverse import bfs, latest_changes, overlay, walks_from
from graphloom.plans.feeds import _CHANGES
from graphloom.plans.lookups import EDGES
from graphloom.plans.recall import _SCORED, _scored
from graphloom.plans.writes import RAW, _halves
from graphloom.session import cut, scratch_folder
from graphloom.sources.graph import memory_graph
from graphloom.sources.tables import table
from graphloom.streaming import feeds
from graphloom.streaming.versions import read_version, write_version


def s14_exists(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    facts = table(spark, d, "vertices").where("array_contains(labels, 'Fact')")
    return facts.join(scan.edges_of(e, "ABOUT").select(F.col("src").alias("id")), "id", "left_semi").select("id")


def s17_export(spark: SparkSession, d: str) -> DataFrame:
    return scan.edges_of(memory_graph(spark, d).edges, "HAS_ALIAS").orderBy("src", "dst")


def s19_unwind(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "edge_mutations").where("edge_type = 'STATED_BY' and src is not null").select(F.col("src").alias("root")).distinct()
    return walks_from(asked, memory_graph(spark, d).edges, "ABOUT", 1, 1)


def s20_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A pinned version stays what it was while newer ones are written."""
    place = f"{scratch_folder(spark)}/versions-{uuid.uuid4().hex}"
    old, new = _halves(spark, d)
    first = write_version(old.select("edge_type", "src", "dst").distinct(), place)
    write_version(mutate.merge_edges(read_version(spark, place), new.select("edge_type", "src", "dst")), place)
    return read_version(spark, place, first).withColumn("version", F.lit(first)).unionByName(read_version(spark, place, at_least=1).withColumn("version", F.lit(1)))


def n15_fixed_pair(spark: SparkSession, d: str) -> DataFrame:
    """The records of one pair of vertices: the pair that has most."""
    rows = parallel_edges(memory_graph(spark, d)).where("edge_type = 'HAS_TURN'")
    most = rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "src", "dst").limit(1)
    return rows.join(F.broadcast(most.select("src", "dst")), ["src", "dst"]).select("src", "dst", "relationship_id", "cell_id")  # one row


def n16_source_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = parallel_edges(memory_graph(spark, d)).where((F.col("edge_type") == "STATED_BY") & (F.col("src") % 20 == 0))
    return rows.select("src", "dst")


def n19_siblings(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "fact_embeddings").where("is_active and source_chunk_id is not null").select("context_id", "source_chunk_id", "fact_id").distinct()
    anchors = facts.where("fact_id % 20 = 0").withColumnRenamed("fact_id", "anchor_id")
    near = facts.join(anchors, ["context_id", "source_chunk_id"])
    return near.join(anchors.select(F.col("anchor_id").alias("fact_id")), "fact_id", "left_anti").select("anchor_id", "fact_id")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """fact_id, context_id, source_chunk_id, vector, seen_at of the facts with a usable vector, one row each."""
    usable = table(spark, d, "fact_embeddings").where("is_active and fact_id is not null and size(embedding) = 96 and source_chunk_id is not null")
    usable = usable.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    return usable.groupBy("fact_id").agg(F.min("context_id").alias("context_id"), F.min("source_chunk_id").alias("source_chunk_id"), F.min("embedding").alias("vector"), F.min("observed_at").alias("seen_at"))


def _composite(spark: SparkSession, d: str) -> DataFrame:
    """The four channels over the retrieval log: a fact's entity is its source chunk, a question names its probe's chunk."""
    facts = _facts(spark, d)
    log = table(spark, d, "scored_facts").where("question_id is not null").groupBy("question_id").agg(F.min("probe_fact_id").alias("probe"))
    probes = log.join(facts.select(F.col("fact_id").alias("probe"), F.col("source_chunk_id").alias("chunk"), F.col("seen_at").alias("asked_at")), "probe", "left")
    none = F.lit(None).cast("bigint")
    seeded = _scored(spark, d).join(facts.select("fact_id", F.col("seen_at").alias("observed_at")), "fact_id", "left")
    seeded = seeded.withColumn("superseded_at", none).withColumn("valid_from", none).withColumn("valid_to", none)
    about = facts.select("fact_id", F.col("source_chunk_id").alias("entity_id"))
    rows = retrieval.expanded(seeded, about, probes.select("question_id", "asked_at"))
    terms = about.select("entity_id").distinct().withColumn("terms", entity_terms(F.col("entity_id")))
    asked = probes.select("question_id", F.filter(entity_terms(F.col("chunk")), lambda x: x != "chunk").alias("asked"))
    return retrieval.composite(rows, terms.withColumn("terms", F.filter("terms", lambda x: x != "chunk")), asked, semantic_least=0.95, keyword_least=0.4)


def g19_composite(spark: SparkSession, d: str) -> DataFrame:
    ranked = _composite(spark, d).where("position <= 5")
    return ranked.select("question_id", "fact_id", "position", F.round("composite_score", 9).alias("composite_score"), "structural_rank", "entity_rank", "abstains")


def a14_best_sibling(spark: SparkSession, d: str) -> DataFrame:
    """Facts from around a question's three best facts of the log, at their best score over these anchors.

    The probe's vector is the question's; the context stands for the source chunk, as few chunks here have two facts.
    """
    facts = cut(_facts(spark, d).select("fact_id", "vector", "context_id", F.lit("all").alias("source_chunk_id")))
    log = table(spark, d, "scored_facts").where("question_id is not null").groupBy("question_id").agg(F.min("probe_fact_id").alias("probe"))
    asked = log.join(facts.select(F.col("fact_id").alias("probe"), F.col("vector").alias("asked")), "probe")
    best = retrieval.channel_ranks(_scored(spark, d), "semantic_score", "rank", most=3).select("question_id", "fact_id")
    out = retrieval.siblings_by_vector(best.join(facts, "fact_id").join(asked, "question_id"), facts)
    return out.select("question_id", "fact_id", F.round("score", 6).alias("score"))


def w03_keyword_ranks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.channel_ranks(_scored(spark, d), "keyword_score", "rank", most=10).select("question_id", "fact_id", "rank")


def w04_structural(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    seeded = e.where("edge_type = 'ABOUT'").select((F.col("src") % 500).alias("question_id"), F.col("src").alias("fact_id")).distinct()
    s = retrieval.bridges(seeded, e).withColumn("score", retrieval.structural_score(F.col("hops"), F.col("paths")))
    return retrieval.channel_ranks(s, "score", "rank").select("question_id", "fact_id", "rank", F.round("score", 6).alias("score"))


def f03_coerced(spark: SparkSession, d: str) -> DataFrame:
    p = resolution.property_kind(F.col("props"), "$.k")
    return table(spark, d, "events").select("event_id", p["kind"].alias("kind"), p["text"].alias("text"))


def f16_boost(spark: SparkSession, d: str) -> DataFrame:
    return _composite(spark, d).select("question_id", "fact_id", F.round("entity_boost", 6).alias("boost"))


def m08_unwind_create(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    old, new = _halves(spark, d)
    rows = mutate.between_labels(new.where("edge_type = 'SUPERSEDES'").select("edge_type", "src", "dst"), g.vertices, "Fact", "Fact")
    return mutate.merge_edges(old.select("edge_type", "src", "dst").distinct(), rows)


def m10_relationship_merge(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    stored = old.select(F.col("mutation_id").alias("relationship_id"), "edge_type", "src", "dst", "cell_id")
    later = new.select((F.col("mutation_id") - 1).alias("relationship_id"), "edge_type", "src", "dst", "cell_id")
    return mutate.replace_rows(stored, later, ["relationship_id"])


def m12_delete_by_property(spark: SparkSession, d: str) -> DataFrame:
    r = memory_graph(spark, d).relationships
    gone = r.where("edge_type = 'ABOUT' and relationship_id % 5 = 0").select("cell_id", "relationship_id")
    return mutate.delete_relationships(r, "relationship_id", gone).select("relationship_id", "edge_type")


def m15_bulk_import(spark: SparkSession, d: str) -> DataFrame:
    """Checked import: edges that are there already are no change, new ones are marked."""
    old, new = _halves(spark, d)
    key = F.concat_ws("/", "edge_type", F.col("src").cast("string"), F.col("dst").cast("string")).alias("edge_key")
    rows = lambda df: df.select(key, "edge_type", "src", "dst").distinct()
    stored = rows(old)
    after = mutate.import_new(stored, rows(new), "edge_key")
    known = stored.select("edge_key", F.lit(False).alias("inserted"))
    return after.join(known, "edge_key", "left").select("edge_type", "src", "dst", F.coalesce("inserted", F.lit(True)).alias("inserted"))


def m16_compaction(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "edge_mutations").where(RAW)
    segments = scan.to_segments(raw, F.pmod(F.col("mutation_id"), F.lit(3)))
    dead = raw.where("mutation_id % 11 = 0").select("edge_type", "src", "dst", F.lit(1).alias("seq"))
    return scan.from_segments(segments, dead)


def m23_replace(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices").select("id", "logical_key", "active")
    return mutate.replace_rows(v, v.where("id % 2 = 0").select("id", F.lit("replaced").alias("logical_key"), "active"), ["id"])


def m24_edge_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata is set on edges that exist; rows for others change nothing."""
    old, new = _halves(spark, d)
    stored = old.groupBy("edge_type", "src", "dst").agg(F.min("mutation_id").alias("weight"))
    batch = new.groupBy("edge_type", "src", "dst").agg(F.max("mutation_id").alias("weight")).join(stored.select("edge_type", "src", "dst"), ["edge_type", "src", "dst"], "left_semi")
    return mutate.merge_edges(stored, batch)


def g05_resolution(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "extracted_entities").select("mention_id", "context_id", F.lower(F.trim("surface")).alias("surface"))
    entities = m.where("mention_id % 3 = 0").select("context_id", "surface", F.col("mention_id").alias("entity_id"))
    aliases = m.where("mention_id % 3 = 1").select("context_id", "surface", (F.col("mention_id") + 1_000_000_000).alias("entity_id"))
    out = resolution.resolve(m, entities, aliases)
    return out.select("mention_id", "how", F.when(F.col("how") != "new", F.col("entity_id")).alias("entity_id"))


def g06_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    out = resolution.similar_within(e, e.where("id % 20 = 0").withColumnRenamed("id", "probe_id"), "label", least=0.1, most=5)
    return out.select("probe_id", "id", F.round("cos", 6).alias("cos"), "rank")


def g10_existing(spark: SparkSession, d: str) -> DataFrame:
    changes = draft_changes(table(spark, d, "extracted_drafts"))
    from graphloom.operators.changes import apply_changes

    current = apply_changes(changes, ["subject_id", "predicate_key"], ["observed_at", "turn_index", "draft_id"], values=["draft_id", "object_value"])
    return current.where("predicate_key = 'hobby'").select("subject_id", "draft_id", "object_value")


def g11_manifest(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices").select("id", "logical_key", "active")
    batch = v.where("id % 2 = 0").withColumn("active", F.when(F.col("id") % 4 == 0, F.lit(False)))
    return resolution.guarded_manifest(v, batch, ["id"], ["active"])


def g14_search_index(spark: SparkSession, d: str) -> DataFrame:
    drafts = table(spark, d, "extracted_drafts").where("draft_id is not null and memory_text is not null")
    one = drafts.groupBy("draft_id").agg(F.max("memory_text").alias("text"))
    return mutate.replace_rows(one.where("text like 'h%'"), one.where("length(text) > 20"), ["draft_id"])


def g16_seeds(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    a = s.where("semantic_score > 0").select("question_id", "fact_id", "semantic_score")
    b = s.where("keyword_score > 0").select("question_id", "fact_id", "keyword_score")
    return retrieval.seeds(a, b)


def g19_answers(spark: SparkSession, d: str) -> DataFrame:
    return _composite(spark, d).where("position = 1").select("question_id", "abstains")


def g20_active(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vertices").where("active and (array_contains(labels, 'Fact') or array_contains(labels, 'Entity'))").select("context_id", "id")


def o11_over_fetch(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.channel_ranks(_scored(spark, d), "semantic_score", "rank", most=retrieval.over_fetch(5)).select("question_id", "fact_id", "rank")


def u04_legs(spark: SparkSession, d: str) -> DataFrame:
    """One leg a cell, every cell."""
    records = memory_graph(spark, d).relationships
    cells = [r[0] for r in records.select("cell_id").where("cell_id is not null").distinct().orderBy("cell_id").limit(1_000).collect()]
    legs = [records.where(F.col("cell_id") == c).select(F.lit(c).alias("leg"), "edge_type", "src", "dst") for c in cells]
    return union(*legs, records.where("cell_id is null").select(F.lit("none").alias("leg"), "edge_type", "src", "dst"), all=True)


def t12_selectors(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    pick = lambda prefix: g.vertices.where("array_contains(labels, 'Entity')").where(F.col("logical_key").startswith(prefix)).select(F.col("id").alias("v"))
    found = paths.simple_paths(g.edges, "MERGED_INTO", pick("entity:1"), pick("entity:2"), max_len=3)
    return paths.ranked(found, 1).select("source", "target", "length", F.array_join("nodes", ",").alias("nodes"))


def t14_incoming(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    starts = e.where("edge_type = 'ABOUT' and dst % 20 = 0").select(F.col("dst").alias("v")).distinct()
    return bfs(starts, e, ["ABOUT", "EXTRACTED_FROM"], 2, direction="incoming")


def t23_path_page(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    roots = e.where("edge_type = 'SUPERSEDES' and src % 20 = 0").select(F.col("src").alias("v")).distinct()
    found = paths.simple_paths(e, "SUPERSEDES", roots, max_len=2)
    return window(found.select("source", F.array_join("nodes", ",").alias("nodes")), [F.col("source").asc(), F.col("nodes").asc()], skip=25, limit=50)


def r04_collected_log(spark: SparkSession, d: str) -> DataFrame:
    """A log folded into a base up to its low-water mark and cut there still gives the current edges."""
    raw = table(spark, d, "edge_mutations").where(RAW)
    log = raw.select("edge_type", "src", "dst", F.col("mutation_id").alias("seq"), (F.col("mutation_id") % 3 != 0).alias("exists"))
    low = log.agg(F.percentile_approx("seq", 0.5, 10_000).alias("m")).first()["m"] or 0
    base = latest_changes(log.where(F.col("seq") <= low)).where("exists")
    return overlay(base, feeds.changes_since(log, low))


def r09_newest(spark: SparkSession, d: str) -> DataFrame:
    """Newer-wins state kept by a stream: the vector time and chunk of each fact."""
    place = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = feeds.table_stream(spark, d, "fact_embeddings").where("fact_id is not null and observed_at is not null").select("fact_id", "observed_at", "context_id")
    feeds.maintain_newest(stream, f"{place}/facts", f"{place}/progress", "fact_id", "observed_at")
    return feeds.current_newest(spark, f"{place}/facts", "fact_id", "observed_at").select("fact_id", "observed_at")


NAMES = (
    "s14_exists s17_export s19_unwind s20_snapshot n15_fixed_pair n16_source_rows n19_siblings a14_best_sibling w03_keyword_ranks w04_structural f03_coerced f16_boost m08_unwind_create "
    "m10_relationship_merge m12_delete_by_property m15_bulk_import m16_compaction m23_replace m24_edge_metadata g05_resolution g06_candidates g10_existing g11_manifest g14_search_index g16_seeds "
    "g19_answers g19_composite g20_active o11_over_fetch u04_legs t12_selectors t14_incoming t23_path_page r04_collected_log r09_newest"
)
QUERIES = {n: globals()[n] for n in NAMES.split()}

_H = f"o as (select edge_type, src, dst, mutation_id, cell_id from edge_mutations where {RAW} and cell_id = 'cell-00'), n as (select edge_type, src, dst, mutation_id, cell_id from edge_mutations where {RAW} and (cell_id <> 'cell-00' or cell_id is null))"
_BRIDGES = f"""{EDGES}, a as (select src % 500 as question_id, src as fact_id, dst as entity_id from edges where edge_type = 'ABOUT'),
b as (select a.question_id, a.fact_id, count(*) as paths from a join a b on b.question_id = a.question_id and b.entity_id = a.entity_id and b.fact_id <> a.fact_id group by a.question_id, a.fact_id)"""
_FACTS = """f as (select fact_id, min(context_id) as context_id, min(source_chunk_id) as chunk, min(embedding)::double[] as v, min(observed_at) as seen_at from fact_embeddings
where is_active and fact_id is not null and len(embedding) = 96 and source_chunk_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1)"""
_WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 2 and x <> 'chunk')"
_COMPOSITE = f"""{_FACTS}, {_SCORED}, l as (select question_id, min(probe_fact_id) as probe from scored_facts where question_id is not null group by 1),
p as (select l.question_id, f.chunk, f.seen_at as asked_at from l left join f on f.fact_id = l.probe),
k as (select s.*, f.chunk, p.chunk as asked from s join p using (question_id) left join f using (fact_id) where p.asked_at is null or f.seen_at is null or f.seen_at <= p.asked_at + 172800),
z0 as (select question_id, fact_id, semantic_score, keyword_score, chunk, asked, case when chunk is null then 0 else count(*) over (partition by question_id, chunk) end as facts from k),
z1 as (select *, case when facts > 1 then 0.5 * least(facts - 1, 3) / 3.0 else 0 end as structural, case when chunk is not null and list_has_any({_WORDS.format('chunk')}, {_WORDS.format('asked')}) then least(0.5 / facts, 0.5) else 0 end as boost from z0),
r1 as (select question_id, fact_id, row_number() over (partition by question_id order by semantic_score desc, fact_id) as r from z1 where semantic_score > 0),
r2 as (select question_id, fact_id, row_number() over (partition by question_id order by keyword_score desc, fact_id) as r from z1 where keyword_score > 0),
r3 as (select question_id, fact_id, row_number() over (partition by question_id order by structural desc, fact_id) as r from z1 where structural > 0),
r4 as (select question_id, fact_id, row_number() over (partition by question_id order by boost desc, fact_id) as r from z1 where boost > 0),
z2 as (select z1.*, r3.r as rs, r4.r as re, coalesce(1 / (60 + r1.r), 0) + coalesce(1 / (60 + r2.r), 0) + coalesce(1 / (60 + r3.r), 0) + coalesce(1 / (60 + r4.r), 0) as c,
coalesce(semantic_score, 0) < 0.95 and coalesce(keyword_score, 0) < 0.4 and structural = 0 as weak
from z1 left join r1 using (question_id, fact_id) left join r2 using (question_id, fact_id) left join r3 using (question_id, fact_id) left join r4 using (question_id, fact_id)),
z as (select *, row_number() over (partition by question_id order by round(c, 12) desc, fact_id) as position from z2)"""
SQL = {
    "s14_exists": f"with {EDGES} select id from vertices where list_contains(labels, 'Fact') and id in (select src from edges where edge_type = 'ABOUT')",
    "s17_export": f"with {EDGES} select * from edges where edge_type = 'HAS_ALIAS' order by src, dst",
    "s19_unwind": f"with {EDGES} select distinct m.src as root, e.dst as v from edge_mutations m join edges e on e.edge_type = 'ABOUT' and e.src = m.src where m.edge_type = 'STATED_BY'",
    "s20_snapshot": f"with {EDGES}, {_H} select distinct edge_type, src, dst, 0 as version from o union all select edge_type, src, dst, 1 from edges",
    "n15_fixed_pair": """with r as (select src, dst, mutation_id as relationship_id, cell_id from edge_mutations where edge_type = 'HAS_TURN' and src is not null and dst is not null),
m as (select src, dst from r group by all order by count(*) desc, src, dst limit 1) select r.* from r join m using (src, dst)""",
    "n16_source_rows": "select src, dst from edge_mutations where edge_type = 'STATED_BY' and src % 20 = 0 and dst is not null",
    "n19_siblings": """with f as (select distinct context_id, source_chunk_id, fact_id from fact_embeddings where is_active and source_chunk_id is not null), a as (select * from f where fact_id % 20 = 0)
select a.fact_id as anchor_id, f.fact_id from f join a using (context_id, source_chunk_id) where f.fact_id not in (select fact_id from a)""",
    "a14_best_sibling": f"""with {_FACTS}, {_SCORED}, l as (select question_id, min(probe_fact_id) as probe from scored_facts where question_id is not null group by 1),
q as (select l.question_id, l.probe, f.v as q from l join f on f.fact_id = l.probe), t as (select question_id, fact_id from s where semantic_score > 0 qualify row_number() over (partition by question_id order by semantic_score desc, fact_id) <= 3),
a as (select t.question_id, f.*, round(list_cosine_similarity(f.v, q.q), 9) as qc, q.q, q.probe from t join f using (fact_id) join q using (question_id)),
n as (select a.question_id, f.fact_id, round(list_cosine_similarity(f.v, a.q), 9) - 0.1 * (1 - round(list_cosine_similarity(f.v, a.v), 9)) as score, a.qc from a join f on f.context_id = a.context_id where f.fact_id <> a.probe),
b as (select question_id, fact_id, max(score) as score from n where score > 0.8 * qc and (question_id, fact_id) not in (select (question_id, fact_id) from a) group by all),
r as (select *, row_number() over (partition by question_id order by score desc, fact_id) as rn from b) select question_id, fact_id, round(score, 6) as score from r where rn <= 20""",
    "w03_keyword_ranks": f"with {_SCORED}, r as (select question_id, fact_id, row_number() over (partition by question_id order by keyword_score desc, fact_id) as rank from s where keyword_score > 0) select question_id, fact_id, rank::int as rank from r where rank <= 10",
    "w04_structural": f"with {_BRIDGES} select question_id, fact_id, (row_number() over (partition by question_id order by least(paths, 3) desc, fact_id))::int as rank, round(0.5 * least(paths, 3) / 3.0, 6)::double as score from b",
    "f03_coerced": "select event_id, case json_type(props, '$.k') when 'UBIGINT' then 'int' when 'BIGINT' then 'int' when 'DOUBLE' then 'float' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'bool' end as kind, json_extract_string(props, '$.k') as text from events",
    "f16_boost": f"with {_COMPOSITE} select question_id, fact_id, round(boost, 6) as boost from z",
    "m08_unwind_create": f"""with {_H}, f as (select id from vertices where list_contains(labels, 'Fact')) select distinct edge_type, src, dst from o union
select edge_type, src, dst from n where edge_type = 'SUPERSEDES' and src in (select id from f) and dst in (select id from f)""",
    "m10_relationship_merge": f"with {_H} select mutation_id as relationship_id, edge_type, src, dst, cell_id from o where mutation_id not in (select mutation_id - 1 from n) union all select mutation_id - 1, edge_type, src, dst, cell_id from n",
    "m12_delete_by_property": f"select mutation_id as relationship_id, edge_type from edge_mutations where {RAW} and not (edge_type = 'ABOUT' and mutation_id % 5 = 0)",
    "m15_bulk_import": f"with {_H}, p as (select distinct edge_type, src, dst from o), q as (select distinct edge_type, src, dst from n) select *, false as inserted from p union all select *, true from (select * from q except select * from p)",
    "m16_compaction": f"""select distinct edge_type, src, dst from edge_mutations a where {RAW} and (mutation_id % 3 = 2 or not exists (select 1 from edge_mutations b where b.edge_type = a.edge_type and b.src = a.src and b.dst = a.dst and b.mutation_id % 11 = 0))""",
    "m23_replace": "select id, case when id % 2 = 0 then 'replaced' else logical_key end as logical_key, active from vertices",
    "m24_edge_metadata": f"with {_H}, p as (select edge_type, src, dst, min(mutation_id) as w from o group by all), q as (select edge_type, src, dst, max(mutation_id) as w from n group by all) select edge_type, src, dst, coalesce(q.w, p.w) as weight from p left join q using (edge_type, src, dst)",
    "g05_resolution": """with m as (select mention_id, context_id, lower(trim(surface)) as s from extracted_entities), e as (select context_id, s, min(mention_id) as id from m where mention_id % 3 = 0 group by all),
a as (select context_id, s, min(mention_id) + 1000000000 as id from m where mention_id % 3 = 1 group by all)
select mention_id, case when e.id is not null then 'exact' when a.id is not null then 'alias' when m.s is not null then 'new' end as how, coalesce(e.id, a.id) as entity_id from m left join e using (context_id, s) left join a using (context_id, s)""",
    "g06_candidates": """with e as (select vec_id, label, embedding::double[] as v from embeddings), s as (select p.vec_id as probe_id, e.vec_id as id, round(list_cosine_similarity(e.v, p.v), 9) as cos from e join e p using (label) where p.vec_id % 20 = 0 and e.vec_id <> p.vec_id),
r as (select *, row_number() over (partition by probe_id order by cos desc, id) as rank from s where cos >= 0.1) select probe_id, id, round(cos, 6) as cos, rank::int as rank from r where rank <= 5""",
    "g10_existing": f"with {_CHANGES}, r as (select *, row_number() over (partition by subject_id, predicate_key order by observed_at desc, turn_index desc, draft_id desc) as rn from changes) select subject_id, draft_id, object_value from r where rn = 1 and action <> 'DELETE' and predicate_key = 'hobby'",
    "g11_manifest": "select id, logical_key, case when id % 4 = 0 then false else active end as active from vertices",
    "g14_search_index": "with t as (select draft_id, max(memory_text) as text from extracted_drafts where draft_id is not null and memory_text is not null group by draft_id) select draft_id, text from t where text like 'h%' or length(text) > 20",
    "g16_seeds": f"with {_SCORED} select question_id, fact_id, case when semantic_score > 0 then semantic_score end as semantic_score, case when keyword_score > 0 then keyword_score end as keyword_score from s where semantic_score > 0 or keyword_score > 0",
    "g19_answers": f"with {_COMPOSITE} select question_id, weak as abstains from z where position = 1",
    "g19_composite": f"""with {_COMPOSITE} select z.question_id, z.fact_id, z.position::int as position, round(z.c, 9) as composite_score, z.rs::int as structural_rank, z.re::int as entity_rank, y.weak as abstains
from z join z y on y.question_id = z.question_id and y.position = 1 where z.position <= 5""",
    "g20_active": "select context_id, id from vertices where active and (list_contains(labels, 'Fact') or list_contains(labels, 'Entity'))",
    "o11_over_fetch": f"with {_SCORED}, r as (select question_id, fact_id, row_number() over (partition by question_id order by semantic_score desc, fact_id) as rank from s where semantic_score > 0) select question_id, fact_id, rank::int as rank from r where rank <= 60",
    "u04_legs": f"select coalesce(cell_id, 'none') as leg, edge_type, src, dst from edge_mutations where {RAW}",
    "t12_selectors": f"""with {EDGES}, s as (select src, dst from edges where edge_type = 'MERGED_INTO' and src <> dst), x as (select id from vertices where list_contains(labels, 'Entity') and starts_with(logical_key, 'entity:1')), y as (select id from vertices where list_contains(labels, 'Entity') and starts_with(logical_key, 'entity:2')),
p as (select src as source, dst as target, [src, dst] as nodes, 1 as length from s union all select a.src, b.dst, [a.src, a.dst, b.dst], 2 from s a join s b on b.src = a.dst and b.dst <> a.src
  union all select a.src, c.dst, [a.src, a.dst, b.dst, c.dst], 3 from s a join s b on b.src = a.dst and b.dst <> a.src join s c on c.src = b.dst and c.dst <> a.src and c.dst <> a.dst),
q as (select *, row_number() over (partition by source, target order by length, nodes) as rank from p where source in (select id from x) and target in (select id from y)) select source, target, length, array_to_string(nodes, ',') as nodes from q where rank = 1""",
    "t14_incoming": f"""with recursive {EDGES}, e as (select dst as a, src as b from edges where edge_type in ('ABOUT', 'EXTRACTED_FROM')), starts as (select distinct dst as v from edges where edge_type = 'ABOUT' and dst % 20 = 0),
w(v, hop) as (select v, 0 from starts union select e.b, w.hop + 1 from w join e on e.a = w.v where w.hop < 2) select v, min(hop)::int as hop from w where v not in (select v from starts) group by v""",
    "t23_path_page": f"""with {EDGES}, s as (select src, dst from edges where edge_type = 'SUPERSEDES' and src <> dst), p as (select src as source, src || ',' || dst as nodes from s where src % 20 = 0
union all select a.src, a.src || ',' || a.dst || ',' || b.dst from s a join s b on b.src = a.dst and b.dst <> a.src where a.src % 20 = 0) select source, nodes from p order by source, nodes limit 50 offset 25""",
    "r04_collected_log": f"select edge_type, src, dst from (select edge_type, src, dst, arg_max(mutation_id % 3 <> 0, mutation_id) as live from edge_mutations where {RAW} group by all) where live",
    "r09_newest": "select fact_id, max(observed_at) as observed_at from fact_embeddings where fact_id is not null and observed_at is not null group by fact_id",
}
