"""The conversation memory pipeline: records to chunks, drafts to accepted facts, facts to graph rows, and their lifetimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import chunk_id, content_hash, parse_time, path_uuid
from graphloom.operators.changes import OPEN_END_SECONDS
from graphloom.operators.history import with_segments
from graphloom.operators.mutate import numbered

#: Fixed values of the data model: scopes, memory types and actions, and the defaults for missing ones.
SCOPES = ("session", "user", "chat", "global")
MEMORY_TYPES = ("episodic", "semantic", "procedural")
ACTIONS = ("ADD", "UPDATE", "DELETE")


def chunks(records: DataFrame) -> DataFrame:
    """chunk_id, context_id, record_id, session_id, actor_role, occurred_at, raw_text, content_hash: one row for each
    record key. Equal repeats are one chunk; where a key comes with different contents, the earliest received counts.
    Rows without context or record are left out; null contents are empty texts."""
    keyed = records.where("context_id is not null and record_id is not null")
    first = F.min(F.struct("received_at", "content", "session_id", "actor_role", "occurred_at")).alias("r")
    one = keyed.groupBy("context_id", "record_id").agg(first)
    text = F.coalesce("r.content", F.lit(""))
    return one.select(
        chunk_id(F.col("context_id"), F.col("record_id")).alias("chunk_id"), "context_id", "record_id", "r.session_id", "r.actor_role",
        parse_time(F.col("r.occurred_at")).alias("occurred_at"), text.alias("raw_text"), content_hash(text).alias("content_hash"),
    )


def chunk_conflicts(records: DataFrame) -> DataFrame:
    """context_id, record_id, contents: keys that came with more than one content."""
    keyed = records.where("context_id is not null and record_id is not null")
    counts = keyed.groupBy("context_id", "record_id").agg(F.count_distinct(F.coalesce("content", F.lit(""))).alias("contents"))
    return counts.where("contents > 1")


def judged(drafts: DataFrame) -> DataFrame:
    """The drafts with reject_reason, null for accepted ones: the first rule that fails."""
    seconds = F.when(F.col("observed_at") >= 100_000_000_000, F.floor(F.col("observed_at") / 1000)).otherwise(F.col("observed_at"))
    reason = (
        F.when(F.col("draft_id").isNull(), "no_id")
        .when(F.col("context_id").isNull(), "no_context")
        .when(F.length(F.trim(F.coalesce("memory_text", F.lit("")))) == 0, "no_text")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "bad_confidence")
        .when(F.upper(F.trim(F.coalesce("action", F.lit("ADD")))).isin(*ACTIONS, "") == False, "bad_action")  # noqa: E712
        .when(seconds.isNull(), "no_time")
        .when((F.col("valid_from") > F.col("valid_to")), "ends_before_start")
    )
    return drafts.withColumn("reject_reason", reason)


def with_defaults(drafts: DataFrame) -> DataFrame:
    """Drafts with memory_type, scope_type, action and times filled in by the pipeline's defaults."""
    start = F.coalesce(F.col("valid_from").cast("timestamp").cast("bigint"), F.lit(0))
    end = F.coalesce(F.col("valid_to").cast("timestamp").cast("bigint"), F.lit(OPEN_END_SECONDS))
    word = F.upper(F.trim(F.coalesce("action", F.lit(""))))
    return drafts.select(
        "delivery_id", "draft_id", "context_id", "subject_id",
        F.coalesce(F.lower(F.trim("memory_type")), F.lit("semantic")).alias("memory_type"),
        F.coalesce(F.lower(F.trim("scope_type")), F.lit("user")).alias("scope_type"),
        F.when(word == "", "ADD").otherwise(word).alias("action"), start.alias("valid_from"), end.alias("valid_to"),
    )


def register(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """graph_id, node_kind, context_id, logical_key of old and new keys; new ids follow the greatest old one.

    keys: (node_kind, context_id, logical_key). New ids are numbered within hash ranges, as no task should see all keys.
    """
    fresh = keys.distinct().join(registry.select("node_kind", "context_id", "logical_key"), ["node_kind", "context_id", "logical_key"], "left_anti")
    top = registry.agg(F.coalesce(F.max("graph_id"), F.lit(0)).alias("_top"))
    new = numbered(fresh, ["node_kind", "context_id", "logical_key"], "_number").crossJoin(F.broadcast(top))  # one row
    new = new.select((F.col("_top") + F.col("_number")).alias("graph_id"), "node_kind", "context_id", "logical_key")
    return registry.select("graph_id", "node_kind", "context_id", "logical_key").unionByName(new)


def plan_nodes(chunked: DataFrame, facts: DataFrame) -> DataFrame:
    """label, context_id, logical_key, node_id of the Session, Turn and Fact nodes of chunks and accepted drafts."""
    node = lambda df, label, key: df.select(F.lit(label).alias("label"), "context_id", F.concat(F.lit(label.lower() + ":"), key).alias("logical_key")).where("logical_key is not null")
    rows = (
        node(chunked.where("session_id is not null"), "Session", F.col("session_id"))
        .unionByName(node(chunked, "Turn", F.col("record_id")))
        .unionByName(node(facts, "Fact", F.col("draft_id")))
        .distinct()
    )
    return rows.withColumn("node_id", path_uuid(F.concat_ws("/", "label", "context_id", "logical_key")))


def plan_edges(chunked: DataFrame, facts: DataFrame) -> DataFrame:
    """edge_type, context_id, src_key, dst_key: HAS_TURN, EXTRACTED_FROM and STATED_BY edges of a write plan."""
    turn, fact = F.concat(F.lit("turn:"), "record_id"), F.concat(F.lit("fact:"), "draft_id")
    has_turn = chunked.where("session_id is not null").select(F.lit("HAS_TURN").alias("edge_type"), "context_id", F.concat(F.lit("session:"), "session_id").alias("src_key"), turn.alias("dst_key"))
    source = facts.where("source_record_id is not null").select("context_id", "draft_id", F.col("source_record_id").alias("record_id")).distinct()
    known = source.join(chunked.select("context_id", "record_id", "actor_role"), ["context_id", "record_id"])
    extracted = known.select(F.lit("EXTRACTED_FROM").alias("edge_type"), "context_id", fact.alias("src_key"), turn.alias("dst_key"))
    stated = known.where("actor_role is not null").select(F.lit("STATED_BY").alias("edge_type"), "context_id", fact.alias("src_key"), F.concat(F.lit("actor:"), "actor_role").alias("dst_key"))
    return has_turn.unionByName(extracted).unionByName(stated).distinct()


def plan_entities(resolved: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of entities: Entity nodes, Alias nodes of other spellings of a resolved entity, HAS_ALIAS from entity to
    alias, and ABOUT from a fact to each entity that is named in its text.

    resolved: (context_id, surface, entity_id, canonical) of mentions; facts: (context_id, draft_id, memory_text). A fact and
    an entity meet on a word of the canonical name, then the whole name must be in the text, each of its words as a whole word.
    """
    known = resolved.where("entity_id is not null and surface is not null and context_id is not null").select("context_id", "surface", "entity_id", "canonical").distinct()
    entity = F.concat(F.lit("entity:"), F.col("entity_id").cast("string"))
    alias = F.concat(F.lit("alias:"), F.substring(F.sha2(F.concat_ws("\x00", "context_id", "surface"), 256), 1, 16))
    other = known.where("surface <> canonical")
    nodes = known.select(F.lit("Entity").alias("label"), "context_id", entity.alias("logical_key")).unionByName(other.select(F.lit("Alias").alias("label"), "context_id", alias.alias("logical_key"))).distinct()
    aliased = other.select(F.lit("HAS_ALIAS").alias("edge_type"), "context_id", entity.alias("src_key"), alias.alias("dst_key"))
    words = lambda of: F.array_distinct(F.filter(F.split(F.lower(of), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    names = known.select("context_id", "entity_id", F.lower("canonical").alias("name")).where("length(name) > 2").distinct()
    # The longest word of a name is its rarest guess; one key a name keeps the join small.
    longest = F.element_at(F.sort_array(F.transform(words(F.col("name")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), 1)["w"]
    texts = facts.where("draft_id is not null and memory_text is not null").select("context_id", "draft_id", F.lower("memory_text").alias("text")).distinct()
    met = texts.select("context_id", "draft_id", "text", F.explode(words(F.col("text"))).alias("word")).join(names.withColumn("word", longest), ["context_id", "word"])
    named = met.where((F.instr(F.col("text"), F.col("name")) > 0) & (F.size(F.array_except(words(F.col("name")), words(F.col("text")))) == 0))
    about = named.select(F.lit("ABOUT").alias("edge_type"), "context_id", F.concat(F.lit("fact:"), "draft_id").alias("src_key"), entity.alias("dst_key"))
    return nodes, aliased.unionByName(about).distinct()


def superseded(changes: DataFrame) -> DataFrame:
    """draft_id, superseded_at, kind: each change of a subject's attribute that a later one closes.

    A DELETE closes only what is known (CORRECTION); an ADD or UPDATE also ends validity (STATE_CHANGE). A long history is
    looked at in segments of time; the last change of a segment is closed by the first one of the key's next segment.
    """
    keys, order = ["subject_id", "predicate_key"], ["observed_at", "turn_index", "draft_id"]
    rows = with_segments(changes.select(*keys, *order, "action"), keys, "observed_at")
    change = F.struct(*order, "action")
    inside = rows.withColumn("_next", F.lead(change).over(Window.partitionBy(*keys, "segment").orderBy(*order)))
    firsts = rows.groupBy(*keys, "segment").agg(F.min(change).alias("_first"))
    after = firsts.select(*keys, "segment", F.lead("_first").over(Window.partitionBy(*keys).orderBy("segment")).alias("_after")).where("_after is not null")
    both = inside.join(after, [*keys, "segment"], "left").withColumn("_by", F.coalesce("_next", "_after"))
    return both.where("_by is not null").select(
        "draft_id", F.col("_by.observed_at").alias("superseded_at"), F.when(F.col("_by.action") == "DELETE", "CORRECTION").otherwise("STATE_CHANGE").alias("kind")
    )


def upsert_embeddings(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Embeddings by fact_id and model_version: an equal one is no change, a different one replaces the active one, which
    is kept inactive."""
    keys = ["fact_id", "model_version"]
    digest = F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string"))), 256)
    new = batch.withColumn("digest", digest).groupBy(*keys).agg(F.max(F.struct("digest", "embedding")).alias("n")).select(*keys, "n.digest", "n.embedding")
    known = store.withColumn("digest", digest)
    same = known.where("is_active").select(*keys, "digest").distinct()
    fresh = new.join(same, [*keys, "digest"], "left_anti")
    hit = fresh.select(*keys).distinct().withColumn("_hit", F.lit(True))
    old = known.join(hit, keys, "left").withColumn("is_active", F.col("is_active") & F.col("_hit").isNull())
    return old.select(*keys, "embedding", "is_active").unionByName(fresh.select(*keys, "embedding", F.lit(True).alias("is_active")))


