"""The memory pipeline, retrieval, sources and streams."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import memory, retrieval
from graphloom.sources import bulk
from graphloom.streaming import feeds
from graphloom.streaming.versions import drop_before, read_version, versions, write_version


def test_text_helpers(spark):
    df = spark.createDataFrame([("  Ｍax  STRASSE ß ", "a dog named Max", "Max"), (None, None, None), ("", "text", "zzz")], "s string, t string, q string")
    assert [r[0] for r in df.select(X.canonical_surface(F.col("s"))).collect()] == ["max strasse ss", None, ""]
    assert [r[0] for r in df.select(X.entity_terms(F.col("t"))).collect()] == [["dog", "named", "max"], [], ["text"]]
    spans = [r[0] for r in df.select(X.source_span(F.col("t"), F.col("q"))).collect()]
    assert (spans[0]["start"], spans[0]["end"]) == (12, 15)
    assert (spans[2]["start"], spans[2]["end"]) == (0, 4)


def test_times(spark):
    df = spark.createDataFrame([("2024-05-01T23:48:05Z",), ("2025-11-19T03:46:17+05:00",), ("2025/01/25 (Sat) 15:27",), ("yesterday",), (None,), ("2024-02-30T00:00:00Z",)], "t string")
    got = [r[0] for r in df.select(F.unix_timestamp(X.parse_time(F.col("t")))).collect()]
    assert got == [1714607285, 1763505977, 1737818820, None, None, None]


def test_vector_scores(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None, None]
    assert [r[0] for r in df.limit(2).select(X.semantic_score(X.cosine(F.col("a"), F.col("b")))).collect()] == [1.0, 0.5]


RECORDS = "record_id string, context_id string, session_id string, actor_role string, occurred_at string, content string, received_at timestamp"


def records(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    return spark.createDataFrame(
        [
            ("r1", "c", "s", "user", "2024-01-01T00:00:00Z", "hello", at(2)), ("r1", "c", "s", "user", "2024-01-01T00:00:00Z", "hello", at(3)),
            ("r2", "c", None, None, None, "first", at(1)), ("r2", "c", None, None, None, "second", at(5)), (None, "c", None, None, None, "x", at(1)), ("r3", "c", "s", "bot", None, None, at(1)),
        ],
        RECORDS,
    )


def test_chunks(spark):
    assert rows(memory.chunks(records(spark)), "record_id", "raw_text") == [("r1", "hello"), ("r2", "first"), ("r3", "")]
    assert rows(memory.chunk_conflicts(records(spark))) == [("c", "r2", 2)]


def test_registry_keeps_old_ids(spark):
    old = spark.createDataFrame([(7, "Fact", "c", "a")], "graph_id bigint, node_kind string, context_id string, logical_key string")
    keys = spark.createDataFrame([("Fact", "c", "a"), ("Fact", "c", "b"), ("Fact", "d", "a"), ("Fact", "d", "a")], "node_kind string, context_id string, logical_key string")
    got = memory.register(keys, old).collect()
    assert len(got) == 3 and {r["graph_id"] for r in got} == {7, 8, 9}


def test_embedding_upsert(spark):
    schema = "fact_id bigint, model_version string, embedding array<float>, is_active boolean"
    store = spark.createDataFrame([(1, "m", [1.0], True), (2, "m", [2.0], True)], schema)
    batch = spark.createDataFrame([(1, "m", [1.0]), (2, "m", [3.0]), (3, "m", [4.0])], "fact_id bigint, model_version string, embedding array<float>")
    assert rows(memory.upsert_embeddings(store, batch), "fact_id", "embedding", "is_active") == [(1, [1.0], True), (2, [2.0], False), (2, [3.0], True), (3, [4.0], True)]


def test_rank_fusion(spark):
    scored = spark.createDataFrame([(1, 10, 0.9, None), (1, 11, 0.8, 0.5), (1, 12, 0.0, 0.9), (1, 13, float("nan"), -1.0)], "question_id bigint, fact_id bigint, semantic_score double, keyword_score double")
    s = retrieval.channel_ranks(scored, "semantic_score", "a").select("question_id", "fact_id", "a")
    k = retrieval.channel_ranks(scored, "keyword_score", "b").select("question_id", "fact_id", "b")
    got = {r["fact_id"]: r["composite_score"] for r in retrieval.fused(retrieval.seeds(s, k), ["a", "b"]).collect()}
    assert got == pytest.approx({10: 1 / 61, 11: 1 / 62 + 1 / 62, 12: 1 / 61})
    assert [r["fact_id"] for r in retrieval.top_facts(retrieval.fused(retrieval.seeds(s, k), ["a", "b"]), 2).orderBy("position").collect()] == [11, 10]


def test_scores_of_structure_and_entities(spark):
    df = spark.createDataFrame([(2, 3, ["max"], 2), (1, 9, ["dog"], 1), (None, 0, ["max"], 0)], "hops int, paths int, terms array<string>, facts int")
    assert [r[0] for r in df.select(retrieval.structural_score(F.col("hops"), F.col("paths"))).collect()] == [0.5, 1.0, 0.0]
    assert [r[0] for r in df.select(retrieval.entity_boost(F.col("terms"), F.array(F.lit("max")), F.col("facts"))).collect()] == [0.25, 0.0, 0.0]
    assert [r[0] for r in df.select(retrieval.abstains(F.lit(0.1), F.lit(None).cast("double"), F.lit(0.0))).collect()] == [True] * 3


def test_visibility(spark):
    df = spark.createDataFrame(
        [(1, 0, 100, None, None, "user"), (2, 0, 49, None, None, "user"), (3, 60, None, None, None, "user"), (4, None, None, 10, 50, None), (5, None, None, -90000, None, "chat"), (6, 0, 50, 0, 50, "chat")],
        "id int, valid_from bigint, valid_to bigint, observed_at bigint, superseded_at bigint, scope_type string",
    )
    assert rows(retrieval.visible(df, F.lit(50)), "id") == [(1,), (4,), (6,)]


def test_siblings(spark):
    anchors = spark.createDataFrame([(1, 10, "c", "k", 0.8)], "question_id bigint, fact_id bigint, context_id string, source_chunk_id string, q_cos double")
    facts = spark.createDataFrame(
        [(1, 10, "c", "k", 0.8, 1.0, 10), (1, 11, "c", "k", 0.75, 0.9, 10), (1, 12, "c", "k", 0.60, 0.9, 10), (1, 13, "c", "other", 0.9, 0.9, 10)],
        "question_id bigint, fact_id bigint, context_id string, source_chunk_id string, q_cos double, a_cos double, anchor_id bigint",
    )
    assert rows(retrieval.siblings(anchors, facts), "fact_id", "score") == [(11, pytest.approx(0.74))]


def test_siblings_by_vector_agree_with_pairs_and_shuffle_none(spark, monkeypatch):
    import numpy as np

    from graphloom.functions.text import dot, unit

    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 6))
    facts = [(i, "c" if i % 3 else "d", "all", [float(x) for x in base[i % 4] + 0.4 * rng.normal(size=6)]) for i in range(90)]
    facts[7] = (7, "c", "all", facts[8][3])  # a tie
    facts.append((90, None, "all", facts[0][3]))
    facts = spark.createDataFrame(facts, "fact_id bigint, context_id string, source_chunk_id string, vector array<float>")
    asked = [(q, f, [float(x) for x in base[q % 4]], 10 * q if q else None) for q in range(9) for f in (q, q + 20, q + 33, 90)]
    asked = spark.createDataFrame(asked, "question_id bigint, fact_id bigint, asked array<float>, probe bigint")
    anchors = asked.join(facts, "fact_id")
    cos = lambda a, b: F.round(dot(unit(F.col(a)), unit(F.col(b))), 9)
    pairs = anchors.withColumnsRenamed({"fact_id": "anchor_id", "vector": "anchor"}).join(facts, ["context_id", "source_chunk_id"]).where("probe is null or fact_id <> probe")
    pairs = pairs.withColumn("q_cos", cos("asked", "vector")).withColumn("a_cos", cos("anchor", "vector")).drop("asked", "anchor", "vector", "probe")
    want = rows(retrieval.siblings(anchors.withColumn("q_cos", cos("asked", "vector")), pairs).withColumn("score", F.round("score", 9)))
    monkeypatch.setattr(retrieval, "SIBLINGS", 7)
    fewer = rows(retrieval.siblings(anchors.withColumn("q_cos", cos("asked", "vector")), pairs).withColumn("score", F.round("score", 9)))
    for size, scores in ((4_096, 2_097_152), (8, 60)):
        monkeypatch.setattr(retrieval, "SIBLING_ROWS", size)
        monkeypatch.setattr(retrieval, "SIBLING_SCORES", scores)
        for most, expected in ((20, want), (7, fewer)):
            monkeypatch.setattr(retrieval, "SIBLINGS", most)
            assert rows(retrieval.siblings_by_vector(anchors, facts).withColumn("score", F.round("score", 9))) == expected
    assert len(want) > len(fewer) > 40
    assert rows(retrieval.siblings_by_vector(anchors, facts.limit(0))) == []
    frame = anchors.unionByName(facts, allowMissingColumns=True).where("context_id = 'c'").toPandas()
    whole = retrieval._block_siblings(frame)
    monkeypatch.setattr(retrieval, "SIBLING_SCORES", 2_097_152)
    assert len(whole) and retrieval._block_siblings(frame).equals(whole)


def test_best_sibling_query_sends_no_pairs(spark):
    from graphloom.plans import more

    plan = more.a14_best_sibling(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Before, a row of two vectors was shuffled for each question and fact of a context.
    assert "FlatMapGroupsInPandas" in plan and "RepartitionByExpression" not in plan


def test_bridges_count_paths_without_pairs(spark):
    e = spark.createDataFrame([("ABOUT", f, e) for f, e in [(1, 9), (2, 9), (3, 9), (3, 8), (4, 7)]], "edge_type string, src bigint, dst bigint")
    seeded = spark.createDataFrame([(1, f) for f in (1, 2, 3, 4)], "question_id bigint, fact_id bigint")
    assert rows(retrieval.bridges(seeded, e), "fact_id", "paths") == [(1, 2), (2, 2), (3, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "nodes.jsonl").write_text('{"id": 1, "labels": ["A"], "properties": {"x": "1"}}\nbroken\n{"labels": []}\n')
    (tmp_path / "edges.jsonl").write_text('{"id": 5, "type": "T", "source_id": 1, "target_id": 2, "properties": {}}\n{"id": 6, "type": "T", "source_id": 1}\n')
    assert rows(bulk.node_lines(spark, str(tmp_path / "nodes.jsonl")), "id", "labels") == [(1, ["A"])]
    assert rows(bulk.edge_lines(spark, str(tmp_path / "edges.jsonl")), "edge_type", "src", "dst", "relationship_id") == [("T", 1, 2, 5)]
    item = {"question_id": "q", "question": "?", "answer": "gold", "haystack_session_ids": ["s2", "s1"], "haystack_dates": ["2024/01/02 (Tue) 10:00", "2024/01/01 (Mon) 09:00"],
            "haystack_sessions": [[{"role": "user", "content": "hi", "has_answer": True}], [{"role": "user", "content": " "}, {"role": "bot", "content": "yo"}]]}
    (tmp_path / "hay.json").write_text(json.dumps([item]))
    got = bulk.haystack_records(spark, str(tmp_path / "hay.json"))
    assert "answer" not in got.columns
    assert [r["record_id"] for r in got.orderBy("occurred_at").collect()] == ["s1:source-0002:turn-0002", "s2:source-0001:turn-0001"]
    bulk.write_lines(got.select("record_id"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions(spark, root) == []
    for n in range(3):
        write_version(spark.range(n + 1), root)
    write_version(spark.range(99), root, 2)
    assert versions(spark, root) == [0, 1, 2]
    assert read_version(spark, root).count() == 3
    assert read_version(spark, root, 0).count() == 1
    with pytest.raises(ValueError):
        read_version(spark, root, at_least=5)
    drop_before(spark, root, 2)
    assert versions(spark, root) == [2]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    from graphloom.streaming import versions as module

    root = str(tmp_path / "t")
    write_version(spark.range(1), root)
    seen = module.versions(spark, root)
    write_version(spark.range(2), root)
    monkeypatch.setattr(module, "versions", lambda *_: seen)  # a writer that looked before the other was done
    with pytest.raises(RuntimeError, match="another writer"):
        write_version(spark.range(3), root)
    assert spark.read.parquet(f"{root}/v1").count() == 2


def test_streamed_edges_equal_a_full_build_after_a_restart(spark, tmp_path):
    source = tmp_path / "edge_changes.parquet"
    schema = "edge_type string, src bigint, dst bigint, seq bigint, exists boolean"
    batches = [[("T", 1, 2, 1, True), ("T", 2, 3, 2, True)], [("T", 1, 2, 3, False)], [("T", 4, 5, 4, True), ("T", 1, 2, 5, True)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        feeds.maintain_edges(feeds.table_stream(spark, str(tmp_path), "edge_changes", 1), str(tmp_path / "edges"), str(tmp_path / "progress"))
    assert rows(feeds.current_edges(spark, str(tmp_path / "edges")), "src", "dst") == [(1, 2), (2, 3), (4, 5)]
    feeds.compact_edges(spark, str(tmp_path / "edges"), str(tmp_path / "compact"))
    assert rows(feeds.current_edges(spark, str(tmp_path / "compact")), "src", "dst") == [(1, 2), (2, 3), (4, 5)]
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3


def test_streamed_newest_row(spark, tmp_path):
    source = tmp_path / "facts.parquet"
    for batch in ([(1, 5, "a")], [(1, 4, "older"), (2, 1, "b")], [(1, 6, "newer")]):
        spark.createDataFrame(batch, "id bigint, at bigint, name string").coalesce(1).write.mode("append").parquet(str(source))
        feeds.maintain_newest(feeds.table_stream(spark, str(tmp_path), "facts", 1), str(tmp_path / "state"), str(tmp_path / "progress"), "id", "at")
    assert rows(feeds.current_newest(spark, str(tmp_path / "state"), "id", "at"), "id", "name") == [(1, "newer"), (2, "b")]


def test_registered_queries_have_columns_that_match_their_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_composite_ranking_over_four_channels(spark):
    seeds = spark.createDataFrame(
        [(1, 10, 0.9, 0.2, None, None, None, None), (1, 11, 0.4, None, None, None, None, None), (1, 12, 0.8, 0.9, 900_000, None, None, None), (1, 13, 0.7, 0.1, 50, None, None, None), (2, 14, 0.1, 0.1, None, None, None, None)],
        "question_id bigint, fact_id bigint, semantic_score double, keyword_score double, observed_at bigint, superseded_at bigint, valid_from bigint, valid_to bigint",
    )
    about = spark.createDataFrame([(10, "e1"), (11, "e1"), (11, "e2"), (13, "e2"), (12, "e3")], "fact_id bigint, entity_id string")
    asked_at = spark.createDataFrame([(1, 100)], "question_id bigint, asked_at bigint")
    rows_of = retrieval.expanded(seeds, about, asked_at)
    assert 12 not in {r["fact_id"] for r in rows_of.collect()}  # seen long after the question
    terms = spark.createDataFrame([("e1", ["alma"]), ("e2", ["rome"])], "entity_id string, terms array<string>")
    asked = spark.createDataFrame([(1, ["where", "rome"])], "question_id bigint, asked array<string>")
    got = {(r["question_id"], r["fact_id"]): r for r in retrieval.composite(rows_of, terms, asked).collect()}
    # Fact 11 shares an entity with each of the others; only e2 is named, by two facts.
    assert got[1, 11]["structural_rank"] == 1 and got[1, 11]["entity_boost"] == 0.25 and got[1, 10]["entity_boost"] == 0.0
    # 13: 1/62 + 1/62 + 1/63 + 1/62, 10: 1/61 + 1/61 + 1/62 and no entity named, 11: 1/63 + 1/61 + 1/61 and no keyword.
    assert [got[1, f]["position"] for f in (13, 10, 11)] == [1, 2, 3] and not got[1, 11]["abstains"]
    expected = 1 / 63 + 1 / 61 + 1 / 61
    assert abs(got[1, 11]["composite_score"] - expected) < 1e-12
    assert got[2, 14]["abstains"]


def test_frequent_terms_still_count(spark):
    texts = spark.createDataFrame([(i, "graph memory" if i % 2 else "graph") for i in range(40)] + [(99, "the and"), (100, None)], "fact_id bigint, text string")
    questions = spark.createDataFrame([(1, "the graph"), (2, "memory"), (3, ""), (4, None)], "question_id bigint, text string")
    got = retrieval.keyword_matches(questions, texts).collect()
    assert len([r for r in got if r["question_id"] == 1]) == 40 and len([r for r in got if r["question_id"] == 2]) == 20
    assert 99 not in {r["fact_id"] for r in got}


def test_long_histories_are_closed_across_segments(spark, monkeypatch):
    from graphloom.operators import history

    monkeypatch.setattr(history, "VERSION_EVERY", 10)
    items = [(1, "k", t, 0, f"d{t:03}", "DELETE" if t % 3 == 0 else "ADD") for t in range(60)] + [(2, "k", t, 0, f"e{t}", "ADD") for t in range(3)]
    df = spark.createDataFrame(items, "subject_id bigint, predicate_key string, observed_at bigint, turn_index int, draft_id string, action string")
    expected = [(f"d{t:03}", t + 1, "CORRECTION" if (t + 1) % 3 == 0 else "STATE_CHANGE") for t in range(59)] + [("e0", 1, "STATE_CHANGE"), ("e1", 2, "STATE_CHANGE")]
    assert rows(memory.superseded(df), "draft_id", "superseded_at", "kind") == expected
