"""Change feeds and histories against plain Python."""

import datetime as dt
import random

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from graphloom.operators.changes import apply_changes, current_drafts
from graphloom.operators.history import draft_periods, reconstruct, store_history, validity_periods

DRAFTS = (
    "delivery_id bigint, draft_id string, subject_id bigint, predicate_key string, action string, object_value string, observed_at bigint, "
    "turn_index int, valid_from timestamp, valid_to timestamp, subject_id_2 string"
)


def draft(n, draft_id, subject, key, action, value, observed, turn=0, start=None, end=None):
    when = lambda s: None if s is None else dt.datetime.fromtimestamp(s, dt.timezone.utc)
    return (n, draft_id, subject, key, action, value, observed, turn, when(start), when(end), "clash")


def feed(spark, items):
    return spark.createDataFrame(items, DRAFTS)


def test_newest_change_wins_over_repeats_and_order(spark):
    df = feed(spark, [
        draft(1, "a", 1, "Home City", "add", "x", 100),
        draft(2, "a", 1, "home_city", "ADD", "x", 100),
        draft(3, "b", 1, "homeCity", " Update ", "y", 90),
        draft(4, "c", 1, "pet", None, "cat", 50),
        draft(5, "d", 1, "pet", "Delete", None, 60),
        draft(6, "e", 2, "pet", "", "dog", 70_000, 1),
        draft(7, "f", 2, "pet", "UPDATE", "cow", 70_000, 2),
        draft(8, "g", 3, "  -- ", "ADD", "lost", 10),
        draft(9, "h", 3, "pet", "ADD", "lost", None),
        draft(10, "i", 4, "pet", "ADD", "ms", 170_000_000_000_0),
        draft(11, "j", 4, "pet", "ADD", "s", 1_700_000_001),
        draft(12, "k", None, "pet", "ADD", "s", 1),
    ])
    assert rows(current_drafts(df)) == [(1, "homecity", "a"), (2, "pet", "f"), (4, "pet", "j")]


def test_state_matches_replay_with_a_base_and_a_hot_key(spark):
    rng = random.Random(5)
    changes = [(1 if rng.random() < 0.4 else rng.randrange(2, 30), t, rng.choice(["ADD", "UPDATE", "DELETE"]), f"v{t}") for t in rng.sample(range(2000), 600)]
    base = [(k, f"base{k}") for k in range(0, 45, 3)] + [(90, None), (90, None)]
    state = {k: v for k, v in base if k != 90}
    for k, _, action, value in sorted(changes, key=lambda c: c[1]):
        state.pop(k, None)
        if action != "DELETE":
            state[k] = value
    feed_df = spark.createDataFrame(changes, "k bigint, t bigint, action string, v string")
    got = apply_changes(feed_df, ["k"], ["t"], values=["v"], base=spark.createDataFrame(base, "k bigint, v string"), batches=5)
    assert rows(got) == sorted([*state.items(), (90, None), (90, None)], key=lambda t: [(x is None, str(x)) for x in t])


def test_empty_feed_gives_the_base(spark):
    none = spark.createDataFrame([], "k bigint, t bigint, action string, v string")
    base = spark.createDataFrame([(1, "a"), (None, "b")], "k bigint, v string")
    assert rows(apply_changes(none, ["k"], ["t"], values=["v"], base=base)) == [(1, "a"), (None, "b")]
    assert rows(current_drafts(feed(spark, []))) == []
    assert rows(draft_periods(feed(spark, []))) == []


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, 1, "ADD", "a"), (None, 2, "ADD", "b"), (3, 1, None, "c")], "k bigint, t bigint, action string, v string")
    assert rows(apply_changes(df.fillna({"action": "ADD"}), ["k"], ["t"], values=["v"], batches=3)) == [(3, "c"), (None, "b")]


def test_periods_of_drafts(spark):
    df = feed(spark, [
        draft(1, "a", 1, "city", "ADD", "Rome", 100),
        draft(2, "b", 1, "city", "UPDATE", " rome ", 200),
        draft(3, "c", 1, "city", "UPDATE", "Oslo", 300, end=350),
        draft(4, "d", 1, "city", "DELETE", None, 500),
        draft(5, "e", 1, "city", "ADD", "Rome", 450, start=600, end=9_999_999_999),
        draft(6, "f", 1, "city", "ADD", "Bonn", 40, start=0, end=30),
    ])
    assert rows(draft_periods(df, segments=3)) == [(1, "city", 100, 300), (1, "city", 300, 350), (1, "city", 40, 100), (1, "city", 600, 9_999_999_999)]


def test_history_matches_folding_in_python_at_any_number_of_segments(spark):
    rng = random.Random(11)
    patches = []
    for key in range(6):
        for start in sorted(rng.sample(range(1000), 120 if key == 0 else rng.randrange(1, 20))):
            patches.append((key, start, start + rng.randrange(-5, 60) if rng.random() < 0.4 else None, rng.choice(["a", "b", None]), rng.random() < 0.15))
    expected = []
    for key in range(6):
        mine = [p for p in patches if p[0] == key]
        held = []
        for p, nxt in zip(mine, [*mine[1:], None]):
            if not p[4]:
                stop = nxt[1] if nxt else 9_999_999_999
                stop = min(stop, p[2]) if p[2] is not None and p[2] > p[1] else stop
                if held and held[-1][2] == p[1] and held[-1][3] == p[3]:
                    held[-1] = (key, held[-1][1], stop, p[3])
                else:
                    held.append((key, p[1], stop, p[3]))
        expected += held
    df = spark.createDataFrame(patches, "k bigint, start bigint, own_end bigint, value string, removes boolean")
    patches = [*patches, *[(None, *p[1:]) for p in patches if p[0] == 1]]
    expected += [(None, *e[1:]) for e in expected if e[0] == 1]
    df = spark.createDataFrame(patches, df.schema)
    for segments in (1, 7, 40):
        got = validity_periods(df, ["k"], segments=segments)
        assert rows(got, "k", "valid_from", "valid_to", "value") == sorted(expected, key=lambda t: [(x is None, str(x)) for x in t]), segments
    for segments in (1, 7):
        stored = store_history(df, ["k"], [], segments)
        assert segments == 1 or 0 < stored.checkpoints.count() < stored.patches.count()
        for at in (0, 500, 2000):
            got = rows(reconstruct(stored, at))
            assert got == sorted([(k, v) for k, a, b, v in expected if a <= at < b], key=lambda t: [(x is None, str(x)) for x in t])
        some = spark.createDataFrame([(1,), (77,)], "k bigint")
        assert {r["k"] for r in reconstruct(stored, 500, some).collect()} <= {1}


def test_a_long_history_gets_versions_and_a_short_one_none(spark, monkeypatch):
    from graphloom.operators import history

    monkeypatch.setattr(history, "VERSION_EVERY", 50)
    rng = random.Random(3)
    patches = [(1, rng.choice("abc"), t, None, str(t % 7), False) for t in rng.sample(range(5000), 600)] + [(k, "a", t, None, "x", False) for k in range(2, 30) for t in rng.sample(range(5000), 3)]
    df = spark.createDataFrame(patches, "e bigint, a string, start bigint, own_end bigint, value string, removes boolean")
    stored = store_history(df, ["e"], ["a"])
    assert {r["e"] for r in stored.checkpoints.select("e").distinct().collect()} == {1}
    assert 10 <= stored.spans.where("e = 1").count() <= 12 and stored.spans.where("e = 2").count() == 1
    assert rows(validity_periods(df, ["e", "a"])) == rows(validity_periods(df, ["e", "a"], segments=1))


def test_slices_are_found_in_two_steps(spark):
    from graphloom.operators.history import slice_of

    for bounds in ([], [5], list(range(0, 100, 7)), list(range(0, 1000, 3))):
        got = spark.range(0, 1100, 9).select("id", slice_of(F.col("id"), bounds).alias("s")).collect()
        assert all(r["s"] == sum(b < r["id"] for b in bounds) for r in got)


def test_folding_batches_without_a_finished_period(spark):
    from graphloom.operators.history import fold

    def batch(entity, starts, removes=False):
        n = len(starts)
        fixed = {"a": ["x"] * n, "segment": [0] * n, "own_end": [None] * n, "value": [str(s) for s in starts], "removes": [removes] * n}
        return pd.DataFrame({"e": [entity] * n, **fixed, "start": starts, "final": [True] * n, "alone": [True] * n})

    def folded(*frames):
        return [tuple(r) for out in fold(iter(frames), ["e", "a"], 99) for r in out[["e", "valid_from", "valid_to"]].itertuples(index=False)]

    assert folded(batch(1, [1, 2]), batch(1, [5])) == [(1, 1, 2), (1, 2, 5), (1, 5, 99)]
    assert folded(batch(1, [1]), batch(2, [3, 4], True)) == [(1, 1, 99)]
    assert folded(batch(1, [1, 2], True), batch(2, [7])) == [(2, 7, 99)]
    # One key with more changes than an Arrow batch (10,000 rows) has, and a key that is only removed.
    df = spark.range(12_000).selectExpr("1L as e", "'x' as a", "id as start", "cast(null as bigint) as own_end", "cast(id as string) as value", "false as removes")
    df = df.unionByName(df.where("start < 3").withColumn("e", F.lit(2)).withColumn("removes", F.lit(True)))
    got = validity_periods(df, ["e", "a"], segments=1)
    assert got.where("e = 1").count() == 12_000 and got.where("e = 2").count() == 0
