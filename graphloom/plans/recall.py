"""Queries: the memory pipeline and retrieval (inventory F, G, W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import memory, retrieval
from graphloom.operators.changes import draft_changes
from graphloom.plans.feeds import _CHANGES
from graphloom.plans.lookups import EDGES
from graphloom.session import cut
from graphloom.sources.graph import memory_graph
from graphloom.sources.tables import table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """One row for each question and fact of the retrieval log: the best of its repeats, scores in [0, 1] only."""
    ok = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(0, 1), F.col(c))
    rows = table(spark, d, "scored_facts").where("question_id is not null and fact_id is not null")
    return rows.groupBy("question_id", "fact_id").agg(F.max(ok("semantic_score")).alias("semantic_score"), F.max(ok("keyword_score")).alias("keyword_score"))


def f05_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    probe = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("p"), "label")
    near = e.join(probe, "label").where("vec_id <> probe")
    cos = X.cosine(F.col("embedding"), F.col("p"))
    return near.select("probe", "vec_id", F.round(cos, 6).alias("cos"), F.round(X.semantic_score(cos), 6).alias("score"))


def f07_keyword(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "eval_items").select(F.col("item_id").alias("question_id"), F.col("question").alias("text"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), "text")
    hits = retrieval.keyword_matches(questions, texts)
    return hits.select("question_id", "fact_id", F.round("rank", 6).alias("rank"), F.round("keyword_score", 6).alias("keyword_score"))


def f08_plain_surface(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entities")
    return rows.select("mention_id", X.plain_surface(F.col("surface")).alias("surface"))


def f08_canonical_surface(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_entities").select("mention_id", X.canonical_surface(F.col("surface")).alias("surface"))


def f09_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_drafts")
    return rows.select("delivery_id", F.array_join(F.array_sort(X.entity_terms(F.col("memory_text"))), ",").alias("terms"))


def f10_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "context_records").where("context_id is not null and record_id is not null")
    return rows.select("record_id", X.content_hash(F.col("content")).alias("hash"), X.path_uuid(F.concat_ws("/", "context_id", "record_id")).alias("uuid")).distinct()


def f12_times(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "context_records")
    return rows.select("record_id", "occurred_at", F.unix_timestamp(X.parse_time(F.col("occurred_at"))).alias("seconds")).distinct()


def f13_visible(spark: SparkSession, d: str) -> DataFrame:
    """Facts known and valid at one instant; a later change of the same attribute ends what was known."""
    facts = memory.with_defaults(table(spark, d, "extracted_drafts"))
    seen = table(spark, d, "extracted_drafts").select("delivery_id", "observed_at")
    closed = memory.superseded(draft_changes(table(spark, d, "extracted_drafts"))).select("draft_id", "superseded_at")
    rows = facts.join(seen, "delivery_id").join(closed, "draft_id", "left")
    return retrieval.visible(rows, F.lit(1_735_689_600)).select("delivery_id")


def f18_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_drafts")
    span = X.source_span(F.col("memory_text"), F.col("object_value"))
    return rows.select("delivery_id", span["start"].alias("start"), span["end"].alias("end"))


def f19_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_drafts").where("memory_text is not null").select("memory_text").distinct()
    e = X.deterministic_embedding(F.col("memory_text"))
    return rows.select("memory_text", F.round(e[0], 6).alias("x0"), F.round(e[7], 6).alias("x7"))


def g01_chunks(spark: SparkSession, d: str) -> DataFrame:
    return memory.chunks(table(spark, d, "context_records")).select("chunk_id", "context_id", "record_id", "content_hash")


def g01_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return memory.chunk_conflicts(table(spark, d, "context_records"))


def g02_judged(spark: SparkSession, d: str) -> DataFrame:
    return memory.judged(table(spark, d, "extracted_drafts")).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def g03_defaults(spark: SparkSession, d: str) -> DataFrame:
    return memory.with_defaults(table(spark, d, "extracted_drafts"))


def g07_registry(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices").where("logical_key is not null")
    keys = v.select(F.split("logical_key", ":")[0].alias("node_kind"), "context_id", "logical_key")
    old = v.where("id % 2 = 0").select(F.col("id").alias("graph_id"), F.split("logical_key", ":")[0].alias("node_kind"), "context_id", "logical_key")
    out = memory.register(keys.where("context_id is not null"), old.where("context_id is not null"))
    # New ids are any numbers above the old ones.
    top = old.agg(F.max("graph_id").alias("top"))
    marked = out.crossJoin(F.broadcast(top))  # one row
    return marked.select("node_kind", "context_id", "logical_key", F.when(F.col("graph_id") <= F.col("top"), F.col("graph_id")).alias("graph_id"))


def g08_plan_edges(spark: SparkSession, d: str) -> DataFrame:
    return memory.plan_edges(memory.chunks(table(spark, d, "context_records")), table(spark, d, "extracted_drafts").where("draft_id is not null"))


def g08_plan_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = memory.plan_nodes(memory.chunks(table(spark, d, "context_records")), table(spark, d, "extracted_drafts").where("draft_id is not null"))
    return nodes.select("label", "context_id", "logical_key")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with the smallest mention of their plain surface as entity and that mention's spelling as canonical name."""
    m = table(spark, d, "extracted_entities").where("context_id is not null and surface is not null").select("mention_id", "context_id", "surface", X.plain_surface(F.col("surface")).alias("plain"))
    first = m.where("plain <> ''").groupBy("context_id", "plain").agg(F.min(F.struct("mention_id", "surface")).alias("f"))
    return m.join(first, ["context_id", "plain"]).select("context_id", "surface", F.col("f.mention_id").alias("entity_id"), F.col("f.surface").alias("canonical"))


def g08_plan_entities(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = memory.plan_entities(_resolved(spark, d), table(spark, d, "extracted_drafts"))
    none = F.lit(None).cast("string").alias("dst_key")
    return nodes.select(F.col("label").alias("kind"), "context_id", F.col("logical_key").alias("key"), none).unionByName(edges.select(F.col("edge_type").alias("kind"), "context_id", F.col("src_key").alias("key"), "dst_key"))


def g09_superseded(spark: SparkSession, d: str) -> DataFrame:
    return memory.superseded(draft_changes(table(spark, d, "extracted_drafts")))


def g13_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The greatest vector of a fact and model upserted over the least one of any state: where they differ, it is replaced."""
    rows = table(spark, d, "fact_embeddings").where("fact_id is not null and model_version is not null and size(embedding) = 96")
    rows = rows.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    pick = lambda best: rows.groupBy("fact_id", "model_version").agg(best("embedding").alias("embedding"))
    store = pick(F.min).where("fact_id % 2 = 0").withColumn("is_active", F.lit(True))
    out = memory.upsert_embeddings(store, pick(F.max))
    return out.select("fact_id", "model_version", "is_active", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.col("embedding")[95].cast("double"), 6).alias("last"))


def g17_expansion(spark: SparkSession, d: str) -> DataFrame:
    facts = _scored(spark, d).select("question_id", "fact_id")
    return retrieval.about_entities(facts, memory_graph(spark, d).edges)


def g18_bridges(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    facts = e.where("edge_type = 'ABOUT'").select((F.col("src") % 500).alias("question_id"), F.col("src").alias("fact_id")).distinct()
    return retrieval.bridges(facts, e)


def w02_ranks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.channel_ranks(_scored(spark, d), "semantic_score", "rank").select("question_id", "fact_id", "rank")


def w05_fusion(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    semantic = retrieval.channel_ranks(s, "semantic_score", "semantic_rank").select("question_id", "fact_id", "semantic_rank")
    keyword = retrieval.channel_ranks(s, "keyword_score", "keyword_rank").select("question_id", "fact_id", "keyword_rank")
    out = retrieval.top_facts(retrieval.fused(retrieval.seeds(semantic, keyword), ["semantic_rank", "keyword_rank"]), 5)
    return out.select("question_id", "fact_id", "position", F.round("composite_score", 9).alias("composite_score"))


def a13_facts_per_entity(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.facts_per_entity(memory_graph(spark, d).edges)


NAMES = "f05_cosine f07_keyword f08_plain_surface f08_canonical_surface f09_terms f10_hashes f12_times f13_visible f18_spans f19_embedding g01_chunks g01_conflicts g02_judged g03_defaults g07_registry g08_plan_edges g08_plan_nodes g08_plan_entities g09_superseded g13_embeddings g17_expansion g18_bridges w02_ranks w05_fusion a13_facts_per_entity"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_OK = "case when {0} is not null and not isnan({0}) and {0} between 0 and 1 then {0} end"
_SCORED = f"s as (select question_id, fact_id, max({_OK.format('semantic_score')}) as semantic_score, max({_OK.format('keyword_score')}) as keyword_score from scored_facts where question_id is not null and fact_id is not null group by all)"
_CHUNKS = "c as (select context_id, record_id, arg_min(struct_pack(t := coalesce(content, ''), s := session_id, a := actor_role), row(received_at, content, session_id, actor_role, occurred_at)) as r from context_records where context_id is not null and record_id is not null group by all)"
_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda x: length(x) > 2))"
_TIME = """case when regexp_matches(occurred_at, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})$') then cast(floor(epoch(try_cast(occurred_at as timestamptz))) as bigint)
  when regexp_matches(occurred_at, '^\\d{4}/\\d{2}/\\d{2}') then cast(epoch(try_strptime(regexp_replace(occurred_at, '\\s*\\([A-Za-z]+\\)\\s*', ' '), '%Y/%m/%d %H:%M')) as bigint) end"""
SQL = {
    "f05_cosine": """with p as (select vec_id as probe, embedding::double[] as p, label from embeddings where vec_id % 20 = 0), s as (
select probe, vec_id, list_cosine_similarity(embedding::double[], p) as cos from embeddings join p using (label) where vec_id <> probe)
select probe, vec_id, round(cos, 6) as cos, round(1 / (2 - cos), 6) as score from s""",
    "f07_keyword": f"""with i as (select doc_id as fact_id, unnest({_TERMS.format('text')}) as term from documents), q as (select item_id as question_id, unnest({_TERMS.format('question')}) as term from eval_items),
w as (select term, ln(1 + (select count(*) from documents) / count(*)) as w from i where term not in ({", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)}) group by term),
h as (select question_id, fact_id, sum(w) as rank from q join w using (term) join i using (term) group by all) select question_id, fact_id, round(rank, 6) as rank, round(rank / (1 + rank), 6) as keyword_score from h""",
    "f08_plain_surface": "select mention_id, lower(trim(regexp_replace(surface, '\\s+', ' ', 'g'))) as surface from extracted_entities",
    "f09_terms": f"select delivery_id, array_to_string(list_sort({_TERMS.format('memory_text')}), ',') as terms from extracted_drafts",
    "f10_hashes": """with h as (select distinct record_id, 'sha256:' || sha256(content) as hash, sha256(context_id || '/' || record_id) as x from context_records where context_id is not null and record_id is not null)
select record_id, hash, x[1:8] || '-' || x[9:12] || '-' || x[13:16] || '-' || x[17:20] || '-' || x[21:32] as uuid from h""",
    "f12_times": f"select distinct record_id, occurred_at, {_TIME} as seconds from context_records",
    "f13_visible": f"""with {_CHANGES}, n as (select draft_id, lead(observed_at) over (partition by subject_id, predicate_key order by observed_at, turn_index, draft_id) as superseded_at from changes)
select delivery_id from extracted_drafts left join n using (draft_id) where (superseded_at is null or superseded_at >= 1735689600) and (observed_at is null or observed_at <= 1735689600) and coalesce(cast(floor(epoch(valid_from)) as bigint), 0) <= 1735689600
and coalesce(cast(floor(epoch(valid_to)) as bigint), 9999999999) >= 1735689600 and coalesce(not (coalesce(lower(trim(scope_type)), 'user') = 'chat' and observed_at < 1735689600 - 86400), true)""",
    "f18_spans": """select delivery_id, case when length(object_value) > 0 and instr(memory_text, object_value) > 0 then instr(memory_text, object_value) - 1 else 0 end::int as start,
case when length(object_value) > 0 and instr(memory_text, object_value) > 0 then instr(memory_text, object_value) - 1 + length(object_value) else length(memory_text) end::int as "end" from extracted_drafts""",
    "f19_embedding": "with t as (select distinct memory_text, sha256(memory_text) as h from extracted_drafts where memory_text is not null) select memory_text, round(('0x' || h[1:2])::int / 255.0, 6)::double as x0, round(('0x' || h[15:16])::int / 255.0, 6)::double as x7 from t",
    "g01_chunks": f"with {_CHUNKS} select 'chunk:' || sha256(context_id || chr(0) || record_id) as chunk_id, context_id, record_id, 'sha256:' || sha256(r.t) as content_hash from c",
    "g01_conflicts": "select context_id, record_id, count(distinct coalesce(content, '')) as contents from context_records where context_id is not null and record_id is not null group by all having count(distinct coalesce(content, '')) > 1",
    "g02_judged": """select case when draft_id is null then 'no_id' when context_id is null then 'no_context' when length(trim(coalesce(memory_text, ''))) = 0 then 'no_text'
when confidence is null or isnan(confidence) or not confidence between 0 and 1 then 'bad_confidence' when upper(trim(coalesce(action, 'ADD'))) not in ('ADD', 'UPDATE', 'DELETE', '') then 'bad_action'
when observed_at is null then 'no_time' when valid_from > valid_to then 'ends_before_start' else 'accepted' end as outcome, count(*) as n from extracted_drafts group by 1""",
    "g03_defaults": """select delivery_id, draft_id, context_id, subject_id, coalesce(lower(trim(memory_type)), 'semantic') as memory_type, coalesce(lower(trim(scope_type)), 'user') as scope_type,
case when upper(trim(coalesce(action, ''))) = '' then 'ADD' else upper(trim(action)) end as action, coalesce(cast(floor(epoch(valid_from)) as bigint), 0) as valid_from, coalesce(cast(floor(epoch(valid_to)) as bigint), 9999999999) as valid_to from extracted_drafts""",
    "g07_registry": """with v as (select distinct split_part(logical_key, ':', 1) as node_kind, context_id, logical_key from vertices where logical_key is not null and context_id is not null),
o as (select distinct id, split_part(logical_key, ':', 1) as node_kind, context_id, logical_key from vertices where logical_key is not null and context_id is not null and id % 2 = 0),
x as (select node_kind, context_id, logical_key, id as graph_id from o union all select node_kind, context_id, logical_key, null from v where (node_kind, context_id, logical_key) not in (select (node_kind, context_id, logical_key) from o))
select node_kind, context_id, logical_key, graph_id from x""",
    "g08_plan_edges": f"""with {_CHUNKS}, k as (select distinct f.context_id, draft_id, record_id, c.r.a as actor_role from extracted_drafts f join c on c.context_id = f.context_id and c.record_id = f.source_record_id where draft_id is not null)
select distinct 'HAS_TURN' as edge_type, context_id, 'session:' || r.s as src_key, 'turn:' || record_id as dst_key from c where r.s is not null
union all select distinct 'EXTRACTED_FROM', context_id, 'fact:' || draft_id, 'turn:' || record_id from k
union all select distinct 'STATED_BY', context_id, 'fact:' || draft_id, 'actor:' || actor_role from k where actor_role is not null""",
    "g08_plan_nodes": f"""with {_CHUNKS} select distinct 'Session' as label, context_id, 'session:' || r.s as logical_key from c where r.s is not null
union all select distinct 'Turn', context_id, 'turn:' || record_id from c union all select distinct 'Fact', context_id, 'fact:' || draft_id from extracted_drafts where draft_id is not null""",
    "g08_plan_entities": """with m as (select mention_id, context_id, surface, lower(trim(regexp_replace(surface, '\\s+', ' ', 'g'))) as plain from extracted_entities where context_id is not null and surface is not null),
f as (select context_id, plain, arg_min(surface, mention_id) as canonical, min(mention_id) as entity_id from m where plain <> '' group by all),
k as (select distinct m.context_id, surface, 'entity:' || entity_id as e, 'alias:' || sha256(m.context_id || chr(0) || surface)[1:16] as a, canonical from m join f using (context_id, plain)),
t as (select distinct context_id, draft_id, lower(memory_text) as text from extracted_drafts where draft_id is not null and memory_text is not null)
select distinct 'Entity' as kind, context_id, e as key, null::varchar as dst_key from k union all select distinct 'Alias', context_id, a, null from k where surface <> canonical
union all select distinct 'HAS_ALIAS', context_id, e, a from k where surface <> canonical
union all select distinct 'ABOUT', k.context_id, 'fact:' || draft_id, e from k join t using (context_id) where length(canonical) > 2 and contains(text, lower(canonical)) and len(list_filter(regexp_split_to_array(lower(canonical), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) > 0
and list_has_all(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), list_filter(regexp_split_to_array(lower(canonical), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))""",
    "g09_superseded": f"""with {_CHANGES}, n as (select draft_id, lead(observed_at) over w as superseded_at, lead(action) over w as next_action from changes window w as (partition by subject_id, predicate_key order by observed_at, turn_index, draft_id))
select draft_id, superseded_at, case when next_action = 'DELETE' then 'CORRECTION' else 'STATE_CHANGE' end as kind from n where superseded_at is not null""",
    "g13_embeddings": """with r as (select fact_id, model_version, min(embedding) as a, max(embedding) as z from fact_embeddings where fact_id is not null and model_version is not null and len(embedding) = 96
and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by all),
o as (select fact_id, model_version, a = z as is_active, a as e from r where fact_id % 2 = 0 union all select fact_id, model_version, true, z from r where fact_id % 2 <> 0 or a <> z)
select fact_id, model_version, is_active, round(e[1]::double, 6) as first, round(e[96]::double, 6) as last from o""",
    "g17_expansion": f"with {EDGES}, {_SCORED} select s.question_id, s.fact_id, e.dst as entity_id from s left join edges e on e.edge_type = 'ABOUT' and e.src = s.fact_id",
    "g18_bridges": f"""with {EDGES}, a as (select src % 500 as question_id, src as fact_id, dst as entity_id from edges where edge_type = 'ABOUT')
select a.question_id, a.fact_id, 2 as hops, count(*) as paths from a join a b on b.question_id = a.question_id and b.entity_id = a.entity_id and b.fact_id <> a.fact_id group by a.question_id, a.fact_id""",
    "w02_ranks": f"with {_SCORED} select question_id, fact_id, (row_number() over (partition by question_id order by semantic_score desc, fact_id))::int as rank from s where semantic_score > 0",
    "w05_fusion": f"""with {_SCORED}, a as (select question_id, fact_id, row_number() over (partition by question_id order by semantic_score desc, fact_id) as r from s where semantic_score > 0),
b as (select question_id, fact_id, row_number() over (partition by question_id order by keyword_score desc, fact_id) as r from s where keyword_score > 0),
f as (select question_id, fact_id, coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0) as c from a full join b using (question_id, fact_id)),
p as (select *, row_number() over (partition by question_id order by c desc, fact_id) as position from f) select question_id, fact_id, position::int as position, round(c, 9) as composite_score from p where position <= 5""",
    "a13_facts_per_entity": f"with {EDGES} select dst as entity_id, count(*) as facts from edges where edge_type = 'ABOUT' group by dst",
}
