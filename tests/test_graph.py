"""Patterns, walks, paths and writes on small graphs."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.operators import mutate, paths, scan, verify
from graphloom.operators.match import Match, limited, page, parallel_edges, prop, total, union
from graphloom.operators.traverse import bfs, edge_visits, overlay, walks_from
from graphloom.sources.graph import Graph


@pytest.fixture(scope="module")
def social(spark):
    vertices = spark.createDataFrame(
        [
            (1, ["User"], True, "alice", None), (2, ["User", "Moderator"], True, "bob", None), (3, ["User"], False, "carol", None),
            (100, ["Post"], None, None, 5), (101, ["Post"], None, None, 7), (102, ["Post"], None, None, 11), (200, None, None, None, None),
        ],
        "id bigint, labels array<string>, active boolean, name string, score bigint",
    )
    edges = spark.createDataFrame(
        [("FOLLOWS", 1, 2, 2020, True), ("FOLLOWS", 1, 3, 2021, None), ("FOLLOWS", 2, 3, None, None), ("POSTED", 2, 100, None, None), ("POSTED", 2, 101, None, None), ("POSTED", 3, 102, None, None)],
        "edge_type string, src bigint, dst bigint, since bigint, close boolean",
    )
    return Graph(vertices, edges)


def test_property_pattern(social):
    m = Match(social).node("u", "User", active=True).load("u", "name")
    assert rows(m.returns(name="u.name")) == [("alice",), ("bob",)]


def test_optional_keeps_rows(social):
    m = Match(social).node("u", "User").optional(lambda b: b.expand("u", "POSTED", "p"))
    assert rows(m.returns(user="u", post="p")) == [(1, None), (2, 100), (2, 101), (3, 102)]


def test_optional_condition_counts_before_nulls_are_filled_in(social):
    m = Match(social).node("u", "User").optional(lambda b: b.expand("u", "POSTED", "p").load("p", "score").where(P.greater(prop("p", "score"), F.lit(6))))
    assert rows(m.returns(user="u", post="p")) == [(1, None), (2, 101), (3, 102)]
    assert rows(m.expand("u", "FOLLOWS", "v").returns(u="u", v="v")) == [(1, 2), (1, 3), (2, 3)]


def test_relationship_properties(social):
    m = Match(social).node("u", "User").expand("u", "FOLLOWS", "v", rel="r", since=2020)
    assert rows(m.returns(user="u", followed="v", close=prop("r", "close"))) == [(1, 2, True)]


def test_grouping_and_union(social):
    m = Match(social).node("u", "User").expand("u", "POSTED", "p").load("p", "score")
    assert rows(m.grouped({"user": "u"}, n=F.count(F.lit(1)), score=total(prop("p", "score")))) == [(2, 2, 12), (3, 1, 11)]
    a, b = Match(social).node("v", "User").returns(id="v"), Match(social).node("v", "Moderator").returns(id="v")
    assert rows(union(a, b)) == [(1,), (2,), (3,)]
    assert len(rows(union(a, b, all=True))) == 4


def test_refused_patterns(social):
    with pytest.raises(ValueError):
        Match(social).node("n")
    with pytest.raises(ValueError):
        Match(social).node("a", "User").node("b", "Post")
    with pytest.raises(ValueError):
        union(social.vertices, social.edges)
    with pytest.raises(ValueError):
        limited(social.edges, 3)


def test_product_is_bounded(social):
    a, b = Match(social).node("a", "Moderator"), Match(social).node("b", "Post")
    assert len(rows(a.product(b).returns(a="a", b="b"))) == 3
    with pytest.raises(ValueError):
        a.product(b, most=2)


def test_two_valued_logic(spark, social):
    v = social.vertices
    assert rows(v.where(~P.equal(F.col("active"), F.lit(True))), "id") == [(100,), (101,), (102,), (200,), (3,)]
    assert rows(v.where(P.unequal(F.col("active"), F.lit(True))), "id") == [(3,)]
    big = spark.createDataFrame([(9007199254740993, 9007199254740992.0), (5, 5.0), (None, 1.0)], "a bigint, b double")
    assert rows(big.where(P.equal_number(F.col("a"), F.col("b"))), "a") == [(5,)]


def test_lookups(spark, social):
    ids = spark.createDataFrame([(42,), (1,), (None,)], "id bigint")
    assert rows(scan.seek(ids, social.vertices), "id", "name") == [(1, "alice"), (42, None)]
    asked = spark.createDataFrame([(0, 2), (1, 9), (2, 2)], "position int, vertex bigint")
    assert [tuple(r) for r in scan.neighbour_batch(asked, social.edges, "POSTED").orderBy("position").collect()] == [(0, 2, [100, 101]), (1, 9, []), (2, 2, [100, 101])]
    pairs = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, None, 1)], "position int, src bigint, dst bigint")
    assert rows(scan.exists_batch(pairs, social.edges, "FOLLOWS"), "position", "exists") == [(0, True), (1, False), (2, False)]
    assert rows(scan.neighbours(social.edges, "FOLLOWS", 3, incoming=True)) == [(1,), (2,)]
    got, cursor = page(social.vertices.select("id"), [F.col("id").asc()], 2, 2)
    assert ([r["id"] for r in got], cursor) == ([3, 100], 4)
    assert page(social.vertices.select("id"), [F.col("id").asc()], 6, 2)[1] is None


def test_segments_and_tombstones(spark):
    segments = spark.createDataFrame([("T", 1, 5, [2, 3, 4])], "edge_type string, src bigint, seq bigint, destinations array<bigint>")
    dead = spark.createDataFrame([("T", 1, 2, 5), ("T", 1, 3, 4)], "edge_type string, src bigint, dst bigint, seq bigint")
    assert rows(scan.from_segments(segments, dead), "dst") == [(3,), (4,)]


def edges_of(spark, pairs, kind="T"):
    return spark.createDataFrame([(kind, a, b) for a, b in pairs], "edge_type string, src bigint, dst bigint")


def test_walks_follow_cycles(spark):
    e = edges_of(spark, [(1, 2), (2, 1), (2, 3), (1, 2)])
    root = spark.createDataFrame([(1,), (1,), (None,)], "root bigint")
    at = lambda low, high: [r[1] for r in rows(walks_from(root, e, "T", low, high))]
    assert (at(1, 1), at(2, 2), at(3, 3), at(1, 3), at(0, 1)) == ([2], [1, 3], [2], [1, 2, 3], [1, 2])
    starts = spark.createDataFrame([(1,)], "v bigint")
    assert rows(bfs(starts, e, "T", 3)) == [(2, 1), (3, 2)]
    assert rows(edge_visits(root, e, "T", 2)) == [(1, 1), (2, 2)]
    assert rows(verify.traversal_check(e, "T", starts, 4)) == []
    with pytest.raises(ValueError):
        walks_from(root, e, "T", 3, 2)


@pytest.mark.parametrize("fanout,hops", [(50, 1), (50, 5), (20, 10)])
def test_layered_graph_has_closed_form(spark, fanout, hops):
    node = lambda hop, i: 1 if hop == 0 else hop * 1_000_000 + i + 1
    e = edges_of(spark, [(node(h, i), node(h + 1, i)) for i in range(fanout) for h in range(hops)])
    assert walks_from(spark.createDataFrame([(1,)], "root bigint"), e, "T", 1, hops).count() == fanout * hops


def test_overlay(spark):
    base = edges_of(spark, [(1, 2), (2, 3)])
    delta = spark.createDataFrame([("T", 1, 2, 1, False), ("T", 3, 4, 2, True), ("T", 2, 3, 3, False), ("T", 2, 3, 4, True)], "edge_type string, src bigint, dst bigint, seq bigint, exists boolean")
    assert rows(overlay(base, delta), "src", "dst") == [(2, 3), (3, 4)]


def test_simple_paths_rank_and_prune(spark):
    e = spark.createDataFrame(
        [("T", 1, 2, 1.0, 5.0), ("T", 2, 4, 1.0, 5.0), ("T", 1, 3, 4.0, 1.0), ("T", 3, 4, 4.0, 1.0), ("T", 4, 1, 1.0, 0.0), ("T", 2, 9, None, None)],
        "edge_type string, src bigint, dst bigint, w double, c double",
    )
    v = lambda *ids: spark.createDataFrame([(i,) for i in ids], "v bigint")
    found = paths.simple_paths(e, "T", v(1), v(4), max_len=3, weight="w", cost="c")
    assert rows(paths.ranked(found, 5), "nodes", "weight", "cost", "rank") == [([1, 2, 4], 2.0, 10.0, 1), ([1, 3, 4], 8.0, 2.0, 2)]
    assert rows(paths.simple_paths(e, "T", v(1), v(4), max_len=3, weight="w", cost="c", max_cost=3.0), "nodes") == [([1, 3, 4],)]
    assert rows(paths.ranked(paths.simple_paths(e, "T", v(1), v(4), max_len=3), 0), "nodes") == [([1, 2, 4],), ([1, 3, 4],)]
    assert rows(paths.simple_paths(e, "T", v(1, 4), v(1, 4), max_len=3, pairwise=True), "source", "target") == [(1, 4), (1, 4)]
    assert rows(paths.simple_paths(e, "T", v(9), max_len=2)) == []
    assert ([2, 1],) in rows(paths.simple_paths(e, "T", v(2), max_len=1, direction="both"), "nodes")


def test_parallel_relationships_multiply_paths(spark):
    r = spark.createDataFrame([("T", 1, 2, 10), ("T", 1, 2, 11), ("T", 2, 3, 12), ("T", 1, 4, 13)], "edge_type string, src bigint, dst bigint, relationship_id bigint")
    one = spark.createDataFrame([(1,)], "v bigint")
    found = paths.simple_paths(r, "T", one, max_len=2)
    assert found.count() == 5
    fair = paths.fair_variants(found, 1)
    assert sorted(x["target"] for x in fair.collect()) == [2, 3, 4]
    vertices = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    named = paths.load_paths(found.where("target = 3"), vertices, ["name"])
    assert {tuple(n["name"] for n in x["path_nodes"]) for x in named.collect()} == {("a", "b", None)}


def test_parallel_edges_view(spark):
    g = Graph(
        spark.createDataFrame([(1, ["A"])], "id bigint, labels array<string>"),
        spark.createDataFrame([("T", 1, 2, 7), ("T", 1, 3, None), ("T", 1, 4, None)], "edge_type string, src bigint, dst bigint, since bigint"),
        spark.createDataFrame([("T", 1, 2, 50, 1), ("T", 1, 3, 51, 2)], "edge_type string, src bigint, dst bigint, relationship_id bigint, rank bigint"),
    )
    assert rows(parallel_edges(g), "dst", "relationship_id", "since") == [(2, 50, None), (2, None, 7), (3, 51, None), (4, None, None)]


def test_merge_and_create(spark):
    e = spark.createDataFrame([("T", 1, 2, 5)], "edge_type string, src bigint, dst bigint, w bigint")
    batch = spark.createDataFrame([("T", 1, 2, 9), ("T", 3, 4, None), ("T", None, 4, 1)], "edge_type string, src bigint, dst bigint, w bigint")
    assert rows(mutate.merge_edges(e, batch)) == [("T", 1, 2, 9), ("T", 3, 4, None)]
    old = spark.createDataFrame([("T", 1, 2, 40)], "edge_type string, src bigint, dst bigint, relationship_id bigint")
    new = mutate.create_relationships(old, spark.createDataFrame([("T", 1, 2)] * 3 + [("T", 5, 6)], "edge_type string, src bigint, dst bigint"), ["src", "dst"])
    assert sorted(r["relationship_id"] for r in new.collect()) == [40, 41, 42, 43, 44]


def test_upsert_guard_and_conflicts(spark):
    v = spark.createDataFrame([(1, ["A"], "x", 10), (2, None, "y", None)], "id bigint, labels array<string>, name string, at bigint")
    batch = spark.createDataFrame([(1, ["B"], None, 5), (3, ["C"], "z", 1)], "id bigint, labels array<string>, name string, at bigint")
    assert rows(mutate.upsert_vertices(v, batch)) == [(1, ["A", "B"], "x", 5), (2, [], "y", None), (3, ["C"], "z", 1)]
    guarded = mutate.guarded_upsert(v.drop("labels"), spark.createDataFrame([(1, "older", 9), (1, "newer", 11), (2, "first", 1), (4, "new", None)], "id bigint, name string, at bigint"), "id", "at")
    assert rows(guarded) == [(1, "newer", 11), (2, "first", 1), (4, "new", None)]
    assert rows(mutate.guarded_upsert(v.drop("labels"), spark.createDataFrame([(1, "older", 10)], "id bigint, name string, at bigint"), "id", "at"), "id", "name") == [(1, "x"), (2, "y")]
    clash = spark.createDataFrame([(1, "a"), (1, "b")], "id bigint, name string")
    with pytest.raises(Exception, match="conflicting"):
        mutate.coalesced(clash).collect()


def test_deletes(spark):
    v = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    e = edges_of(spark, [(1, 2)])
    gone = spark.createDataFrame([(3,), (None,)], "id bigint")
    left, _, _ = mutate.delete_vertices(v, e, gone)
    assert rows(left) == [(1,), (2,)]
    with pytest.raises(Exception, match="has edges"):
        mutate.delete_vertices(v, e, spark.createDataFrame([(2,)], "id bigint"))[0].collect()
    left, kept, _ = mutate.delete_vertices(v, e, spark.createDataFrame([(2,)], "id bigint"), detach=True)
    assert (rows(left), rows(kept)) == ([(1,), (3,)], [])


def test_idempotency(spark):
    batch = spark.createDataFrame([("k1", 1), ("k1", 1), ("k2", 2), (None, 3), (None, 3)], "key string, x bigint")
    ledger = batch.where("key = 'k2'").select("key", F.sha2(F.to_json(F.struct("x")), 256).alias("digest"))
    assert rows(mutate.idempotent(batch, ledger, "key", ["x"])) == [("k1", 1), (None, 3), (None, 3)]
    with pytest.raises(Exception, match="other content"):
        mutate.idempotent(spark.createDataFrame([("k2", 9)], "key string, x bigint"), ledger, "key", ["x"]).collect()


def test_import_replace_and_outcome(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    assert rows(mutate.import_new(t, spark.createDataFrame([(2, "b"), (3, "c")], "id bigint, name string"), "id")) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(Exception, match="already there"):
        mutate.import_new(t, spark.createDataFrame([(2, "q")], "id bigint, name string"), "id").collect()
    new = mutate.replace_rows(t, spark.createDataFrame([(2, "q"), (5, "e")], "id bigint, name string"), ["id"])
    assert rows(mutate.outcome(t, new, ["id"])) == [(1, 0, 1, 1)]


def test_digest_ignores_order_and_repeats(spark):
    pairs = [(1, 2), (2, 3), (3, 1)]
    a, b = verify.digest(edges_of(spark, pairs)), verify.digest(edges_of(spark, [*reversed(pairs), (1, 2)]))
    assert rows(a) == rows(b)
    assert rows(a) != rows(verify.digest(edges_of(spark, [(1, 2), (2, 3), (3, 2)])))
    assert rows(verify.degree_repairs(edges_of(spark, pairs), spark.createDataFrame([("T", 1, 1), ("T", 2, 4)], "edge_type string, vertex bigint, degree bigint"))) == [("T", 2, 4, 1), ("T", 3, 0, 1)]


def test_empty_graph(spark):
    none = edges_of(spark, [])
    v = spark.createDataFrame([], "v bigint")
    assert rows(walks_from(v.withColumnRenamed("v", "root"), none, "T", 0, 3)) == []
    assert rows(bfs(v, none, "T", 2)) == []
    assert rows(paths.simple_paths(none, "T", v, v, max_len=2)) == []
    assert rows(verify.digest(none)) == []


def test_resolution_and_manifest(spark):
    from graphloom.operators import resolution

    m = spark.createDataFrame([("c", "max", 1), ("c", "rex", 2), ("c", "new", 3), ("c", "new", 4), ("d", "max", 5), ("c", None, 6)], "context_id string, surface string, n int")
    known = spark.createDataFrame([("c", "max", 9), ("c", "max", 7)], "context_id string, surface string, entity_id bigint")
    alias = spark.createDataFrame([("c", "rex", 8), ("c", "max", 1)], "context_id string, surface string, entity_id bigint")
    got = {r["n"]: (r["how"], r["entity_id"]) for r in resolution.resolve(m, known, alias).collect()}
    assert (got[1], got[2], got[6]) == (("exact", 7), ("alias", 8), (None, None))
    assert got[3] == got[4] and got[3][1] < 0 and got[5][0] == "new" and got[5][1] != got[3][1]
    store = spark.createDataFrame([(1, "a", True), (2, "b", None)], "id bigint, name string, active boolean")
    new = spark.createDataFrame([(1, "a", False), (3, "c", True)], "id bigint, name string, active boolean")
    assert rows(resolution.guarded_manifest(store, new, ["id"], ["active"])) == [(1, "a", False), (2, "b", None), (3, "c", True)]
    with pytest.raises(Exception, match="immutable"):
        resolution.guarded_manifest(store, spark.createDataFrame([(1, "z", True)], store.schema), ["id"], ["active"]).collect()


def test_property_kinds(spark):
    from graphloom.operators.resolution import property_kind

    texts = ['{"k": 24}', '{"k": 2.0}', '{"k": 2.5}', '{"k": "x"}', '{"k": true}', '{"k": [1]}', "{}", "broken", None]
    p = property_kind(F.col("t"), "$.k")
    got = [(r["kind"], r["text"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(p["kind"].alias("kind"), p["text"].alias("text")).collect()]
    assert got == [("int", "24"), ("int", "2"), ("float", "2.5"), ("string", "x"), ("bool", "true"), ("json", "[1]"), (None, None), (None, None), (None, None)]


def test_values_of_different_kinds(spark):
    df = spark.createDataFrame([("1", 1, 2**53 + 1, float(2**53), True), ("abc", None, 3, 3.0, False)], "s string, i int, b bigint, d double, t boolean")
    c = F.col
    for on in (df, None):
        got = df.select(
            P.equal(c("s"), c("i"), on), P.unequal(c("s"), c("i"), on), P.equal(c("b"), c("d"), on), P.greater(c("b"), c("d"), on), P.less_equal(c("d"), c("b"), on),
            P.equal(F.lit("abc"), F.lit(1), on), P.unequal(c("t"), c("d"), on), P.less(c("s"), F.lit("b"), on), P.equal(c("t"), F.lit(True), on), P.less(c("i"), c("b"), on),
        ).collect()
        assert [tuple(r) for r in got] == [(False, True, False, True, True, False, True, True, True, True), (False, False, True, False, True, False, True, True, False, False)]
        for bad in (P.less(c("s"), F.lit(2), on), P.greater(c("t"), F.lit(False), on)):
            with pytest.raises(Exception, match="no order"):
                df.select(bad).collect()


def test_known_kinds_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "k string, n bigint").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = t.where(P.equal(F.col("k"), F.lit("a"), t))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,a)" in plan


def test_deletes_take_records_along_and_merges_set_values(spark):
    v = spark.createDataFrame([(1, []), (2, []), (3, [])], "id bigint, labels array<string>")
    r = spark.createDataFrame([("T", 1, 2, 10, "a"), ("T", 1, 2, 11, "b"), ("T", 2, 3, 12, "c"), ("T", 3, 3, 13, None)], "edge_type string, src bigint, dst bigint, relationship_id bigint, w string")
    e = r.select("edge_type", "src", "dst").distinct()
    _, kept, records = mutate.delete_vertices(v, e, spark.createDataFrame([(2,)], "id bigint"), detach=True, relationships=r)
    assert rows(kept, "src", "dst") == [(3, 3)] and rows(records, "relationship_id") == [(13,)]
    kept, records = mutate.delete_edges_with_records(e, r, e.where("src = 1"))
    assert rows(records, "relationship_id") == [(12,), (13,)]
    batch = spark.createDataFrame([("T", 1, 2, 10, "z"), ("T", 1, 2, 11, None), ("T", 9, 9, 20, "n")], r.schema)
    assert rows(mutate.merge_relationships(r, batch), "relationship_id", "w") == [(10, "z"), (11, "b"), (12, "c"), (13, None), (20, "n")]
    with pytest.raises(Exception, match="other ends"):
        mutate.merge_relationships(r, spark.createDataFrame([("T", 5, 2, 10, "z")], r.schema)).collect()


def test_numbers_are_consecutive(spark, monkeypatch):
    monkeypatch.setattr(mutate, "NUMBERED_ROWS", 3)
    got = mutate.numbered(spark.range(500).withColumn("x", F.lit(None).cast("string")), ["id"], "n")
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 501))


def test_scratch_tables_need_a_shared_folder_off_local(spark):
    from types import SimpleNamespace

    from graphloom.session import scratch_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="local-cluster[2,1,1024]", setCheckpointDir=None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(SimpleNamespace(sparkContext=context))
