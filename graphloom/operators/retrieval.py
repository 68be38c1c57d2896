"""Hybrid retrieval over facts for many questions at once: vector and keyword channels, graph expansion, rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.predicates import visible_at
from graphloom.functions.text import entity_terms, keyword_score

#: Fixed values of the ranking: the constant of rank fusion, over-fetch, abstention thresholds, sibling weights.
FUSION = 60
SIBLING_PENALTY, SIBLING_SHARE, SIBLINGS = 0.1, 0.80, 20
#: Facts and anchors that meet in a task, and numbers of a matrix of their scores (16 MB).
SIBLING_ROWS, SIBLING_SCORES = 4_096, 2_097_152


def over_fetch(top_k: int) -> int:
    return max(top_k * 4, 60)


def channel_ranks(scored: DataFrame, score: str, rank: str, most: int | None = None) -> DataFrame:
    """scored with `rank`: 1-based by descending score within a question, ties by fact_id; only scores above 0 that are
    numbers. Spark limits each partition's rows before the shuffle where `most` is given."""
    kept = scored.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) > 0))
    w = Window.partitionBy("question_id").orderBy(F.col(score).desc(), "fact_id")
    out = kept.withColumn(rank, F.row_number().over(w))
    return out if most is None else out.where(F.col(rank) <= most)


def seeds(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """question_id, fact_id with the scores and ranks of both channels, null where a channel lacks the fact."""
    return semantic.join(keyword, ["question_id", "fact_id"], "full")


def fused(seeded: DataFrame, ranks: list[str]) -> DataFrame:
    """seeded with composite_score: the sum over channels of 1 / (60 + rank), a missing channel adding 0."""
    total = sum((F.coalesce(1.0 / (FUSION + F.col(r)), F.lit(0.0)) for r in ranks), F.lit(0.0))
    return seeded.withColumn("composite_score", total)


def structural_score(hops, paths):
    """(1 / hops) * min(paths, 3) / 3; 0 without paths."""
    return F.when((hops > 0) & (paths > 0), (1.0 / hops) * F.least(paths, F.lit(3)) / 3.0).otherwise(0.0)


def entity_boost(terms, question_terms, facts):
    """min(0.5 / facts, 0.5) where the entity is named in the question, else 0."""
    return F.when(F.arrays_overlap(terms, question_terms) & (facts > 0), F.least(0.5 / facts, F.lit(0.5))).otherwise(0.0)


#: English words that a text search leaves out.
STOP_WORDS = (
    "the and for are but not you all any can had her was one our out has him his how its may new now old see two who did get she too use that this with from they have were been "
    "what when where which while will would your about after before into over than then them there these their those does just only some such very"
).split()
#: Parts that a term's rows are spread over, so that one which a third of the texts has isn't one task.
TERM_SALTS = 8


def keyword_matches(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """question_id, fact_id, rank, keyword_score by inverse-frequency weighted term matches (an OR of all terms).

    questions: (question_id, text); texts: (fact_id, text). An inverted index join: terms meet on a salted equi-join; weights
    come from counts over all texts. Only a fixed list of stop words is left out; a frequent term weighs little but counts.
    """
    terms = lambda df, key: df.select(key, F.explode(F.array_except(entity_terms(F.col("text")), F.array(*map(F.lit, STOP_WORDS)))).alias("term"))
    asked = terms(questions, "question_id")
    index = terms(texts, "fact_id").join(asked.select("term").distinct(), "term", "left_semi")
    total = texts.agg(F.count(F.lit(1)).alias("_total"))
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))  # one row
    weighed = asked.join(counts.select("term", F.log(1 + F.col("_total") / F.col("df")).alias("w")), "term")
    salted = weighed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
    index = index.withColumn("_salt", F.pmod(F.xxhash64("fact_id"), F.lit(TERM_SALTS)).cast("int"))
    hits = salted.join(index, ["term", "_salt"]).groupBy("question_id", "fact_id").agg(F.sum("w").alias("rank"))
    return hits.withColumn("keyword_score", keyword_score(F.col("rank")))


def about_entities(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """fact_id, entity_id (null where a fact has none): the optional ABOUT step of seeded facts."""
    about = edges.where("edge_type = 'ABOUT'").select(F.col("src").alias("fact_id"), F.col("dst").alias("entity_id")).distinct()
    return facts.join(about, "fact_id", "left")


def facts_per_entity(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type = 'ABOUT'").select("src", "dst").distinct().groupBy(F.col("dst").alias("entity_id")).agg(F.count(F.lit(1)).alias("facts"))


def bridges(seeded: DataFrame, edges: DataFrame) -> DataFrame:
    """question_id, fact_id, hops, paths: how many two-step paths over a shared entity lead to each seeded fact from other
    seeded facts of its question.

    Counted per entity, never as pairs: a fact has as many paths as its entities have other seeded facts.
    """
    about = edges.where("edge_type = 'ABOUT'").select(F.col("src").alias("fact_id"), F.col("dst").alias("entity_id")).distinct()
    both = seeded.select("question_id", "fact_id").distinct().join(about, "fact_id")
    sizes = both.groupBy("question_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    counted = both.join(sizes, ["question_id", "entity_id"]).groupBy("question_id", "fact_id").agg(F.sum(F.col("n") - 1).alias("paths"))
    return counted.where("paths > 0").select("question_id", "fact_id", F.lit(2).alias("hops"), "paths")


def visible(facts: DataFrame, at) -> DataFrame:
    """Facts that were known and valid at an instant (epoch seconds); chat-scoped facts last 24 hours."""
    known = visible_at(F.col("observed_at"), F.col("superseded_at"), at)
    valid = visible_at(F.col("valid_from"), F.col("valid_to"), at)
    chat = ~((F.coalesce("scope_type", F.lit("")) == "chat") & (F.col("observed_at") < at - 86_400))
    return facts.where(known & valid & F.coalesce(chat, F.lit(True)))


def abstains(semantic, keyword, structural, semantic_least: float = 0.5, keyword_least: float = 0.1):
    """No answer: both channels weak and no path."""
    return (F.coalesce(semantic, F.lit(0.0)) < semantic_least) & (F.coalesce(keyword, F.lit(0.0)) < keyword_least) & (F.coalesce(structural, F.lit(0.0)) == 0)


#: Fixed value: questions about a period look this far around it.
BUFFER_SECONDS = 2 * 86_400


def expanded(seeded: DataFrame, about: DataFrame, asked_at: DataFrame) -> DataFrame:
    """question_id, fact_id, scores, entity_id (null where a fact has none) of seeds that were known and valid when asked.

    about: (fact_id, entity_id); asked_at: (question_id, asked_at in epoch seconds); seeded has observed_at, superseded_at,
    valid_from and valid_to. A missing end restricts nothing; two days around the question are allowed.
    """
    rows = seeded.join(asked_at, "question_id", "left")
    known = visible_at(F.col("observed_at"), F.col("superseded_at") + BUFFER_SECONDS, F.col("asked_at") + BUFFER_SECONDS)
    valid = visible_at(F.col("valid_from"), F.col("valid_to") + BUFFER_SECONDS, F.col("asked_at") + BUFFER_SECONDS)
    kept = rows.where(F.col("asked_at").isNull() | (known & valid))
    return kept.join(about.select("fact_id", "entity_id").distinct(), "fact_id", "left")


def composite(expanded_seeds: DataFrame, entity_terms_of: DataFrame, question_terms: DataFrame, semantic_least: float = 0.5, keyword_least: float = 0.5) -> DataFrame:
    """question_id, fact_id, the four channels' ranks, structural_score, entity_boost, composite_score, position, abstains.

    expanded_seeds: (question_id, fact_id, semantic_score, keyword_score, entity_id), a row for each entity of a fact;
    entity_terms_of: (entity_id, terms); question_terms: (question_id, asked). Facts are ranked in each channel by scores
    above 0, ranks are fused, ties go to the smaller fact_id. A question abstains where its best fact is weak in the
    semantic and keyword channels and has no path.
    """
    facts = expanded_seeds.select("question_id", "fact_id", "semantic_score", "keyword_score").distinct()
    links = expanded_seeds.where("entity_id is not null").select("question_id", "fact_id", "entity_id").distinct()
    sizes = links.groupBy("question_id", "entity_id").agg(F.count(F.lit(1)).alias("facts"))
    linked = links.join(sizes, ["question_id", "entity_id"]).join(entity_terms_of, "entity_id", "left").join(question_terms, "question_id", "left")
    boost = F.coalesce(entity_boost(F.col("terms"), F.col("asked"), F.col("facts")), F.lit(0.0))
    per = linked.groupBy("question_id", "fact_id").agg(F.sum(F.col("facts") - 1).alias("paths"), F.max(boost).alias("entity_boost"))
    scored = facts.join(per, ["question_id", "fact_id"], "left")
    scored = scored.withColumn("structural_score", structural_score(F.lit(2), F.coalesce("paths", F.lit(0)))).fillna({"entity_boost": 0.0}).drop("paths")
    channels = {"semantic_score": "semantic_rank", "keyword_score": "keyword_rank", "structural_score": "structural_rank", "entity_boost": "entity_rank"}
    out = scored
    for score, rank in channels.items():
        out = out.join(channel_ranks(scored, score, rank).select("question_id", "fact_id", rank), ["question_id", "fact_id"], "left")
    w = Window.partitionBy("question_id").orderBy(F.round("composite_score", 12).desc(), "fact_id")
    ranked = fused(out, list(channels.values())).withColumn("position", F.row_number().over(w))
    weak = abstains(F.col("semantic_score"), F.col("keyword_score"), F.col("structural_score"), semantic_least, keyword_least)
    return ranked.withColumn("abstains", F.first(weak).over(w))


def top_facts(ranked: DataFrame, k: int) -> DataFrame:
    """The k best facts of each question by composite_score, then fact_id, with `position`."""
    w = Window.partitionBy("question_id").orderBy(F.col("composite_score").desc(), "fact_id")
    return ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def siblings(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """question_id, fact_id, score: facts from the same source chunk as an anchor, anchors left out.

    anchors: (question_id, fact_id, context_id, source_chunk_id, q_cos: cosine to the question); facts: (fact_id, context_id,
    source_chunk_id, q_cos, with question_id, and a_cos: cosine to the anchor given as anchor_id). The score is
    q_cos - 0.1 * (1 - a_cos); it must exceed 0.8 of the anchor's q_cos; the best over anchors counts, at most 20 remain.
    """
    key = ["question_id", "context_id", "source_chunk_id"]
    near = facts.join(anchors.select(*key, F.col("fact_id").alias("anchor_id"), F.col("q_cos").alias("anchor_cos")), [*key, "anchor_id"])
    near = near.withColumn("score", F.col("q_cos") - SIBLING_PENALTY * (1 - F.col("a_cos"))).where(F.col("score") > SIBLING_SHARE * F.col("anchor_cos"))
    near = near.join(anchors.select("question_id", "fact_id"), ["question_id", "fact_id"], "left_anti")
    return _most_siblings(near.groupBy("question_id", "fact_id").agg(F.max("score").alias("score")))


def _most_siblings(best: DataFrame) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "fact_id")
    return best.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= SIBLINGS).drop("_rn")


def siblings_by_vector(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """What siblings() gives, with all cosines (rounded to nine decimals) taken from the vectors.

    anchors: (question_id, fact_id, context_id, source_chunk_id, vector, asked: the question's vector, probe: a fact that is
    no sibling, or null); facts: (fact_id, context_id, source_chunk_id, vector), one row each. Facts and anchors of a chunk
    meet in a grid of blocks as matrix products; only the best of each question in a block leave it, never pairs of vectors.
    """
    key = ["context_id", "source_chunk_id"]
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SIBLING_ROWS).cast("int").alias(name))
    grid = blocks(anchors, "as").join(blocks(facts, "fs"), key)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = anchors.join(grid, key).select(*key, part("question_id", "as").alias("a"), each("fs").alias("f"), "question_id", "fact_id", "vector", "asked", "probe")
    holds = facts.join(grid, key).select(*key, each("as").alias("a"), part("fact_id", "fs").alias("f"), "fact_id", "vector")
    met = asks.unionByName(holds, allowMissingColumns=True).groupBy(*key, "a", "f")
    return _most_siblings(met.applyInPandas(_block_siblings, "question_id bigint, fact_id bigint, score double"))


def _units(column: pd.Series) -> np.ndarray:
    rows = np.stack(column).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _block_siblings(frame: pd.DataFrame) -> pd.DataFrame:
    """The best siblings of each question among the facts of a block; all anchors of a question in the chunk are in it."""
    asks = frame[frame["question_id"].notna()].sort_values("question_id")
    holds = frame[frame["question_id"].isna()].sort_values("fact_id")
    out: list[tuple] = []
    ids, questions = holds["fact_id"].to_numpy(np.int64), asks["question_id"].to_numpy(np.int64)
    y = _units(holds["vector"]).T if len(ids) else None
    first = np.flatnonzero(np.r_[True, questions[1:] != questions[:-1]]) if len(asks) else np.empty(0, np.int64)
    step = max(1, SIBLING_SCORES // max(1, len(ids)))
    while len(first) and len(ids):
        # Whole questions, at least one.
        at, stop = first[0], first[np.searchsorted(first, first[0] + step)] if first[-1] >= first[0] + step else len(asks)
        mine, first = first[first < stop] - at, first[first >= stop]
        rows = asks.iloc[at:stop]
        anchors, asked = _units(rows["vector"]), _units(rows["asked"])
        score = np.round(asked @ y, 9) - SIBLING_PENALTY * (1 - np.round(anchors @ y, 9))
        least = SIBLING_SHARE * np.round(np.einsum("ij,ij->i", anchors, asked), 9)
        score[score <= least[:, None]] = -np.inf
        best = np.maximum.reduceat(score, mine, axis=0)
        own = np.repeat(np.arange(len(mine)), np.diff(np.r_[mine, len(rows)]))
        for column in ("fact_id", "probe"):
            known = rows[column].notna().to_numpy()
            left_out = rows[column][known].to_numpy(np.int64)
            place = np.minimum(np.searchsorted(ids, left_out), len(ids) - 1)
            hit = ids[place] == left_out
            best[own[known][hit], place[hit]] = -np.inf
        take = min(SIBLINGS, len(ids))
        kth = np.partition(best, len(ids) - take, axis=1)[:, len(ids) - take]
        for i, question in enumerate(questions[at + mine].tolist()):
            j = np.flatnonzero((best[i] >= kth[i]) & (best[i] > -np.inf))
            j = j[np.lexsort((j, -best[i][j]))][:SIBLINGS]
            out += [(question, f, s) for f, s in zip(ids[j].tolist(), best[i][j].tolist())]
    return pd.DataFrame(out, columns=["question_id", "fact_id", "score"])
