"""Operators of the llm subpackage against brute force, round trips and planted cases."""

import random

import numpy as np
import pytest
from conftest import rows

from graphloom.llm.groups import connected_groups
from graphloom.llm.leaks import leaked_items, reparameterised
from graphloom.llm.names import name_groups, parse, same_name_pairs
from graphloom.llm.sentences import code_like, fit_events, forward_backward, gap_table, sentence_units
from graphloom.llm.tokenizer import WORD_PATTERN, Transducer, decode_texts, encode_texts, round_trip, transducer
from graphloom.llm import vectors

# p1: vectors ------------------------------------------------------------------------------------------------------------

FACTS = "fact_id bigint, is_active boolean, embedding array<float>, source_chunk_id string"


def facts(spark, items):
    return spark.createDataFrame([(i, a, None if v is None else [float(x) for x in v], "k") for i, a, v in items], FACTS)


def brute(ids, matrix, k):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    out = {}
    for i, row in zip(ids, unit):
        cos = np.round(unit @ row, 9)
        order = sorted((-c, j) for c, j in zip(cos, ids) if j != i)
        out[i] = [j for _, j in order[:k]]
    return out


@pytest.mark.parametrize("cell_rows,least", [(10_000, 1.0), (60, 0.9)])
def test_vectors_match_brute_force(spark, monkeypatch, cell_rows, least):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    matrix = (centres[rng.integers(12, size=600)] + 0.3 * rng.normal(size=(600, 16))).astype(np.float32)
    matrix[5] = matrix[6] * 4
    ids = list(range(100, 700))
    got = {}
    for r in vectors.most_similar(facts(spark, zip(ids, [True] * 600, matrix)), 5, 16).collect():
        got.setdefault(r["id"], []).append(r["other_id"])
    true = brute(ids, matrix.astype(np.float64), 5)
    assert set(got) == set(ids) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[i]) & set(true[i])) / 5 for i in ids]) >= least


def test_vectors_without_clusters_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    monkeypatch.setattr(vectors, "SHELL_ROWS", 8)
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(500, 96)).astype(np.float32)
    matrix[:40] = matrix[40:80] + 0.05 * rng.normal(size=(40, 96))
    ids = list(range(500))
    got = {}
    for r in vectors.most_similar(facts(spark, zip(ids, [True] * 500, matrix)), 10).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other_id"])
    assert got == brute(ids, matrix.astype(np.float64), 10)


def test_groups_of_close_vectors_keep_almost_all_pairs_apart():
    rng = np.random.default_rng(8)
    sizes = np.r_[rng.integers(4, 30, 40), 300, np.ones(20, int)]
    x = np.repeat(rng.normal(size=(len(sizes), 96)), sizes, axis=0) + 0.3 * rng.normal(size=(sizes.sum(), 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    group = vectors.close_groups(x.astype(np.float32))
    assert (group < 0).sum() == 20 and len(set(group[group >= 0])) == 41
    order = np.argsort(group, kind="stable")[20:]
    x, group = x[order], group[order]
    starts = np.r_[np.flatnonzero(np.diff(group, prepend=-1)), len(x)].astype(np.int32)
    cos = x @ x.T
    kth = np.sort(cos, axis=1)[:, -4].round(9)
    entered = np.full((len(x), 3), -1, np.int32)
    entered[:, 1] = np.arange(len(x)) % 2
    entered[:, 0] = 7
    centres, radii, reach, common = vectors.group_bounds(x, kth, entered, starts)
    near = vectors.near_groups(centres, reach, centres, radii)
    own = np.repeat(np.arange(len(centres)), np.diff(starts))
    assert near[own][:, own][cos >= kth[:, None]].all(), "a pair that counts is never left out"
    assert near.mean() < 0.05 and (common[:, 0] == 7).all() and (common[:, 1:] == -1).all()
    # Without a k-th score nothing is left out.
    assert vectors.near_groups(centres, vectors.group_bounds(x, np.full(len(x), -2.0), entered, starts)[2], centres, radii).all()


def test_tiles_keep_what_counts_with_a_cheap_bound_on_the_score():
    rng = np.random.default_rng(9)
    low = rng.normal(size=(40, 1003)).astype(np.float32)
    low[:5, :500] = 2  # ties
    kth = np.sort(low, axis=1)[:, -10]
    got = vectors._kth_at_least(low, 10)
    assert (got <= kth).all() and (low >= got[:, None]).sum(1)[5:].max() <= 30
    assert (vectors._kth_at_least(low[:, :30], 10) == np.sort(low[:, :30], axis=1)[:, -10]).all()
    x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.normal(size=(50, 96)), rng.normal(size=(70, 96))))
    score, bound = vectors.Tile(y.astype(np.float32), y[0].astype(np.float32)).scores(x.astype(np.float32))
    assert (np.abs(score - x @ y.T) <= bound).all()


def test_vectors_leave_out_unusable_rows_and_break_ties_by_id(spark):
    v = [1.0, 0.0, 0.0]
    items = [(1, True, v), (1, True, v), (4, True, [2.0, 0.0, 0.0]), (3, True, v), (2, True, [0.0, 1e30, 1e-30]), (9, False, v), (10, True, None), (11, True, []), (12, True, [0, 0, 0]), (13, True, [float("nan"), 1, 1]), (14, True, [float("inf"), 1, 1]), (None, True, v), (15, None, v)]
    got = vectors.most_similar(facts(spark, items), 2, 3)
    assert rows(got, "id", "other_id", "rank") == [(1, 3, 1), (1, 4, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 4, 2), (4, 1, 1), (4, 3, 2)]
    assert rows(vectors.most_similar(facts(spark, []), 2, 3)) == []
    assert rows(vectors.most_similar(facts(spark, [(1, True, v)]), 2, 3)) == []


def test_survivors_below_the_score_give_no_frame():
    import pandas as pd

    row = np.ones(4, np.float32)
    frame = pd.DataFrame({"id": [1], "other_id": [2], "x": [row.tobytes()], "y": [(-row).tobytes()], "least": [0.5]})
    assert list(vectors._exact(iter([frame]))) == []
    assert list(vectors._exact(iter([frame.assign(least=-1.0)])))[0]["others"].tolist() == [[2]]


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 96)) * 0.2, rng.normal(size=(60, 96)) * 0.3
    (qa, sa, ea), (qb, sb, eb) = vectors.quantise(a), vectors.quantise(b)
    approx = (qa * sa[:, None]) @ (qb * sb[:, None]).T
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    assert (np.abs(approx - a @ b.T) <= ea[:, None] * nb + (na + ea)[:, None] * eb + 1e-6).all()


# p2: names --------------------------------------------------------------------------------------------------------------

MENTIONS = "mention_id bigint, context_id string, surface string, entity_type string, group_id string"


def mentions(spark, items):
    return spark.createDataFrame([(n, c, s, t, "clash") for n, (c, s, t) in enumerate(items)], MENTIONS)


def groups_of(spark, items):
    df = mentions(spark, items)
    texts = {n: s for n, (_, s, _) in enumerate(items)}
    out = {}
    for r in name_groups(df).collect():
        out.setdefault(r["group_id"], set()).add(texts[r["mention_id"]])
    return sorted(sorted(v) for v in out.values())


def test_names_of_a_person(spark):
    same = ["Katherine Limgomgru", "Limgomgru, Katherine", "Kat Limgomgru", "K. Limgomgru", "KATHERINE LIMGOMGRU", "Katherine Limgomrgu", "Ｋａｔｈｅｒｉｎｅ　Ｌｉｍｇｏｍｇｒｕ", "Kаtherine Limgomgru", "Katherine Limgomgru’s", "Dr. Katherine Limgomgru"]
    other = ["Theodore Limgomgru", "Theodore Limgomgru", "Katherine Noktrukfok"]
    got = groups_of(spark, [("c", s, "person") for s in [*same, "Katherine Limgomgru", *other]])
    assert sorted(set(same)) in got and ["Theodore Limgomgru"] in got and ["Katherine Noktrukfok"] in got


def test_names_of_organisations_products_and_places(spark):
    items = ["Taltonhal Digital Laboratories GmbH", "Taltonhal Digital Labs", "Taltonhal", "T.D.L.", "Taltonhal Urban Hospital", "Lermulbrul Mini 84", "Lermulbrul-Mini-84.", "Lermulbrul Mini84", "Lermulbrul Mini 85", "Mt Gampru Valley", "Mount Gampru Valley", "Valley, Mount Gampru", "New Gampru Hills"]
    got = groups_of(spark, [("c", s, None) for s in [*items, items[0]]])
    for group in (["Lermulbrul Mini 84", "Lermulbrul Mini84", "Lermulbrul-Mini-84."], ["Lermulbrul Mini 85"], ["Mount Gampru Valley", "Mt Gampru Valley", "Valley, Mount Gampru"], ["Taltonhal Urban Hospital"], ["New Gampru Hills"]):
        assert group in got
    assert any({"T.D.L.", "Taltonhal Digital Labs", "Taltonhal Digital Laboratories GmbH"} <= set(g) for g in got)


def test_names_outside_any_list(spark, monkeypatch):
    from graphloom.llm import names

    monkeypatch.setattr(names, "SQUARE", 4)
    pairs = [
        ("Jonathan Smithson", "Jon Smithson"), ("Michael Carter", "Mike Carter"), ("Catherine Jones", "Cathy Jones"), ("Stephen Brown", "Steve Brown"), ("Robert Jones", "Bob Jones"),
        ("Acme Holdings", "Acme Hldgs"), ("Globex Pharmaceuticals", "Globex Pharma"), ("Wayne Enterprises", "Wayne Entpr."), ("Jo Li", "Li Jo"), ("Ana Ruiz", "Anna Ruiz"), ("Anna Ng", "A. Ng"), ("Wqkzrom", "Wqkgrom"),
    ]
    apart = [("Peter Hollander", "Simon Hollander"), ("Anna Ng", "Anna Wu"), ("Acme Holdings", "Zenith Holdings"), ("Globex 84", "Globex 85")]
    df = mentions(spark, [(f"c{i}", s, None) for i, pair in enumerate([*pairs, *apart]) for s in pair])
    assert rows(same_name_pairs(df)) == sorted([(2 * i, 2 * i + 1) for i in range(len(pairs))], key=lambda t: [(False, str(x)) for x in t])


def test_nicknames_are_learnt(spark):
    full = "Wilhelmina Ambrosius Petronella Gudrunella Casimirus Leonidas Hortensius Bartholom".split()
    short = "Tootsy Zbiggy Fofo Dudu Kuku Waxi Jojojo Quin".split()
    surnames = [f"{a}{b}son" for a in ("Gram", "Tolk", "Virn", "Zemb", "Pralk", "Drov", "Humb", "Sklen") for b in ("ar", "ip", "ov", "en", "ul")]
    items = [(f"c{i}", s, "person") for i, name in enumerate(surnames) for s in (f"{full[i % 8]} {name}", f"{full[i % 8]} {name}", f"{short[i % 8]} {name}")]
    got = groups_of(spark, [*items, ("c0", f"Gundolf {surnames[0]}", "person")])
    assert all(sorted((f"{full[i % 8]} {name}", f"{short[i % 8]} {name}")) in got for i, name in enumerate(surnames))
    assert [f"Gundolf {surnames[0]}"] in got


def test_names_stay_in_their_context_and_odd_rows_do_no_harm(spark):
    items = [("a", "Zirbus", "place"), ("b", "Zirbus", "place"), ("a", None, None), ("a", "", "org"), ("a", "  ", "org"), (None, "Zirbus", None), ("a", "!!!", None), ("a", "Zirbus", "Place"), ("a", "x" * 5000, None)]
    assert rows(same_name_pairs(mentions(spark, items))) == [(0, 7)]
    assert rows(same_name_pairs(mentions(spark, []))) == []
    assert parse("jürgen.chikwilthan") == ["jurgen", "chikwilthan"] and parse("Girnurhus-Pro-56") == ["girnurhus", "pro", "56"]


# p3: groups -------------------------------------------------------------------------------------------------------------


def test_groups_match_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(80)] + [(7, 7), (9999, 9999), (None, 3), (4, None), (7000, 6999), (7000, 6999)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([("k", a, b, 1) for a, b in pairs] + [(None, 1, 2, 1), (None, 2, 8, 1)], "kind string, src bigint, dst bigint, u int")
    got = rows(connected_groups(df, "src", "dst", ["kind"]))
    assert got == sorted([("k", x, find(x)) for x in parent] + [(None, 1, 1), (None, 2, 1), (None, 8, 1)], key=lambda t: [(x is None, str(x)) for x in t])
    assert rows(connected_groups(df.limit(0), "src", "dst", ["kind"])) == []


def test_heavy_vertices_are_relabelled_by_broadcast(spark, monkeypatch):
    from graphloom.llm import groups

    monkeypatch.setattr(groups, "HEAVY_EDGES", 5)
    monkeypatch.setattr(groups, "HEAVY_SHARE", 1_000_000)
    df = spark.createDataFrame([(1, i) for i in range(2, 60)] + [(59, 60), (60, 61), (70, 71)], "src bigint, dst bigint")
    assert rows(connected_groups(df, "src", "dst")) == sorted([(i, 1) for i in range(1, 62)] + [(70, 70), (71, 70)], key=lambda t: [(False, str(x)) for x in t])


# p6: tokenizer ----------------------------------------------------------------------------------------------------------

TEXTS = ["", None, " ", "The tram to Dremchum leaves at 3:41 p.m.", "naïve café 漢字 かな 👩🏽‍🚀 ​", "<|endoftext|> is text", "a" * 3000, "   \n\n\t x", "don't I'll we've", "𝔊𝔯𝔞𝔭𝔥", "ab" * 700 + "!?" * 300, "सुबह ครับ مرحبا"]


def reference_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    from graphloom.llm.tokenizer import read_ranks

    ranks = read_ranks("/opt/tokenizers/byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_library(spark):
    own = reference_encoding()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in encode_texts(df).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert all(r["same"] for r in round_trip(df.drop("ids")).collect())
    assert rows(encode_texts(df.limit(0))) == []


def test_random_words_and_a_small_state_table(monkeypatch):
    from graphloom.llm import tokenizer

    own = reference_encoding()
    machine = transducer("/opt/tokenizers/byte_bpe_50k.tiktoken")
    monkeypatch.setattr(tokenizer, "MOST_STATES", 50)
    rng = random.Random(4)
    for _ in range(1500):
        word = bytes(rng.choice(b"aabetingrs \xe6\xbc\xa2") for _ in range(rng.randrange(1, 60)))
        assert list(machine.encode_word(word)) == own._encode_single_piece(word)


def test_any_small_vocabulary_agrees_with_plain_merging():
    ranks = {bytes([b]): b for b in range(256)}
    for token in (b"aa", b"ab", b"aab", b"ba", b"aaa", b"bab", b"abab"):
        ranks[token] = len(ranks)
    machine = Transducer(ranks)

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not options:
                return [ranks[p] for p in parts]
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    for _ in range(800):
        word = bytes(rng.choice(b"aab") for _ in range(rng.randrange(1, 25)))
        assert list(machine.encode_word(word)) == plain(word), word


def test_decoding_is_incremental(spark):
    machine = transducer("/opt/tokenizers/byte_bpe_50k.tiktoken")
    ids = [machine.ranks[b] for b in (b"\xe6", b"\xbc", b"\xa2", b"!")]
    assert list(machine.decode(ids)) == ["漢", "!"]
    assert "".join(machine.decode(ids[:2])) == "�"
    df = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    assert rows(decode_texts(df)) == [(1, "漢!"), (2, ""), (3, "")]


# p7: leaks --------------------------------------------------------------------------------------------------------------

ITEM = (
    1, "How many figs was Sikbus hiding from Drarchis near Semprol station?", "They chose Nasnok with 123 plum cake in Drarchel.",
    "Still limping from August, Zamprer carefully wrapped the last heat pump in Vuldril under the stairs of Bukik library. "
    "For reasons Borchis never explained, Fenchisthon auctioned off an atlas signed by Romzuknen without asking Drildril. "
    "After the flood in Wenlur Bay, Chisgrak lent Dasnen 619 foreign coins in exchange for 276 piano lessons. Thanks for letting me know.",
)
OTHER = (2, None, None, "After the flood in Tetik Bay, Grakhol lent Ralmis 305 foreign coins in exchange for 118 piano lessons. Kankumpi keeps the spare key to the Vamtis cabin beside locker 729.")


def leak_pairs(spark, texts):
    items = spark.createDataFrame([(*ITEM, "en"), (*OTHER, "en"), (3, None, None, None, "en"), (4, "", "", "", "en")], "item_id bigint, question string, answer string, evidence string, lang string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    return rows(leaked_items(docs, items))


def test_leaks_in_altered_texts_and_none_in_reparameterised_ones(spark):
    evidence = ITEM[3].split(". ")
    got = leak_pairs(spark, [
        f"Intro. {evidence[1]}. Noise here. {evidence[0]}. The end.",
        "user: " + evidence[2].lower().replace("lent", "gave").replace("Dasnen", "Dasnenn") + "\nbot: " + evidence[1].replace("an atlas", "a rare\natlas").upper(),
        f"{ITEM[1]} Some chat between. {ITEM[2]}",
        ITEM[1],
        "After the flood in Kumlu Bay, Trekbo lent Sormin 417 foreign coins in exchange for 52 piano lessons. For reasons Gundral never explained, Tikwos auctioned off an atlas signed by Helpra without asking Mondro.",
        "Thanks for letting me know.", None, "", " ", OTHER[3], evidence[0].replace("e", "е"), "x " * 30_000,
        f"{evidence[0]}. {evidence[2]}".replace("a", "­a"),
    ])
    assert {(0, 1), (1, 1), (2, 1), (9, 2), (12, 1)} <= set(got)
    assert not {d for d, _ in got} & {3, 4, 5, 6, 7, 8, 11}


def test_leaks_do_not_change_when_items_are_repeated(spark):
    evidence = ITEM[3].split(". ")
    texts = [f"{evidence[0]}. {evidence[1]}.", OTHER[3], f"{ITEM[1]} {ITEM[2]}", "After the flood in Kumlu Bay, Trekbo lent Sormin 417 foreign coins in exchange for 52 piano lessons."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    schema = "item_id bigint, question string, answer string, evidence string"
    once = None
    for times in (1, 4, 40):  # the copies are found, too
        items = spark.createDataFrame([(n * 10 + i[0], *i[1:]) for n in range(times) for i in (ITEM, OTHER)], schema)
        got = rows(leaked_items(docs, items))
        found = {(d, i % 10) for d, i in got}
        assert len(got) == times * len(found)
        once = once or found
        assert found == once == {(0, 1), (1, 2), (2, 1)}


def test_leaks_of_items_without_names_or_numbers(spark):
    items = spark.createDataFrame([(1, "what did the old gardener hide under the stairs", "a small blue bicycle", None), (2, None, None, "the harbour was empty and nobody had swept the narrow quay")], "item_id bigint, question string, answer string, evidence string")
    texts = ["we asked: what did the old gardener hide under the wooden stairs? well, a small blue bicycle.", "what did the old gardener hide under the stairs", "so the harbour was empty, and nobody had swept that narrow quay", "the gardener swept the stairs and nobody was there", "a small blue bicycle"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert rows(leaked_items(docs, items)) == [(0, 1), (2, 2)]


def test_reparameterised_questions_are_reported_apart(spark):
    items = spark.createDataFrame([(*ITEM[:1], *ITEM[1:])] + [(9, None, None, "Kumbo lent Dasnen 619 foreign coins in May."), (10, None, None, "Vamtis lent Bukik 20 foreign coins in May."), (11, None, None, "Grakhol lent Ralmis 305 foreign coins in May.")], "item_id bigint, question string, answer string, evidence string")
    docs = spark.createDataFrame([(1, "Kumbo lent Dasnen 619 foreign coins in May. Other words."), (2, "Tetik lent Sormin 17 foreign coins in May."), (3, None), (4, "")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["sentences"], r["consistent"]) for r in reparameterised(docs, items).collect()}
    assert got == {(1, 1, 1), (2, 1, 0)}


def test_leaks_of_empty_tables(spark):
    assert leak_pairs(spark, []) == []


# p8: sentences ----------------------------------------------------------------------------------------------------------


def sentences(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, start_char string")
    found = {i: [] for i in range(len(texts))}
    for i, a, b in sorted(tuple(r) for r in sentence_units(df).collect()):
        found[i].append(texts[i][a:b])
    return [found[i] for i in range(len(texts))]


def test_sentences(spark):
    texts = [
        'I sold the lamp. Mr. Sumhe called at 3 p.m. on Friday. "Wait! Is it?" asked Tom. It costs $4.23 per bag.',
        None, "", " \n ", "​",
        "# Session 7\n\nThe tram left\nlate. We walked 🎉\n\n- first point\n- second point. And more.",
        "user: Hi there. How are you?\nbot: Fine :)\nuser: Good.",
        "猫叫容宁。真没想到！他说：“这不是真的。”你去吗？",
        "MATCH (a)-[:T]->(b) WHERE a.x = 1. RETURN b\n\nDone. Really.",
        "We moved. He left.\n\n",
    ]
    filler = [f"The shop opens at {n} a.m. We took the train. Mr. Ralchum moved the visit to {n} a.m. on Monday. We took a bus! You told me so. We took it." for n in range(30)]
    got = sentences(spark, [*texts, *filler])
    assert got[0] == ["I sold the lamp.", "Mr. Sumhe called at 3 p.m. on Friday.", '"Wait! Is it?" asked Tom.', "It costs $4.23 per bag."]
    assert got[1:5] == [[], [], [], []]
    assert got[5] == ["# Session 7", "The tram left\nlate.", "We walked 🎉", "- first point", "- second point.", "And more."]
    assert got[6] == ["user: Hi there.", "How are you?", "bot: Fine :)", "user: Good."]
    assert got[7] == ["猫叫容宁。", "真没想到！", "他说：“这不是真的。”", "你去吗？"]
    assert got[8] == ["MATCH (a)-[:T]->(b) WHERE a.x = 1. RETURN b", "Done.", "Really."]
    assert got[9] == ["We moved.", "He left."]
    assert got[10][:2] == ["The shop opens at 0 a.m.", "We took the train."]


def test_sentences_of_an_unpunctuated_script(spark):
    a, b, c = "จักรยานอยู่ที่ไหนครับ", "แมวหนัก 8.48 กิโลกรัมครับ", "เราชอบชามากกว่ากาแฟค่ะ"
    got = sentences(spark, [f"{a} {b} {c}"] * 5)
    assert got[0] == [a, b, c]


def test_unpunctuated_texts_are_cut_by_the_words_alone(spark):
    people, things = ["sister", "brother", "neighbour", "teacher", "uncle"], ["lamp", "kettle", "ladder", "tent", "violin", "camera"]
    rng = random.Random(6)
    english = lambda: rng.choice([f"my {rng.choice(people)} sold the {rng.choice(things)} yesterday", f"we took the {rng.choice(things)} to the garage", f"please ask the {rng.choice(people)} about the {rng.choice(things)}"])
    chinese = lambda: rng.choice([f"我昨天给{rng.choice('容竹岩安')}寄了{rng.choice('一二三四')}封信", f"请把{rng.choice('我你他')}的新地址记下来", f"这只猫叫{rng.choice('容竹岩安')}祁"])
    filler = [" ".join(f"{english().capitalize()}." for _ in range(6)) for _ in range(60)] + ["".join(f"{chinese()}。" for _ in range(6)) for _ in range(60)]
    plain, other = [english() for _ in range(5)], [chinese() for _ in range(4)]
    got = sentences(spark, [" ".join(plain), "".join(other), "we took the lamp to the garage", *filler])
    assert got[0] == plain and got[1] == other and got[2] == ["we took the lamp to the garage"]
    assert len(got[3]) == 6 and len(got[70]) == 6


def test_the_model_overrules_the_seeds(spark):
    # The seeds don't know this abbreviation and take the dot before a capital for an end.
    filler = [f"We read qvx. page {n} at home. The lamp is old." for n in "abcdefghijklmnopqrstuvwxyz"] * 2
    got = sentences(spark, ["They met qvx. Tolma at home. We left.", *filler])
    assert got[0] == ["They met qvx. Tolma at home.", "We left."]


def test_forward_backward_is_exact_and_changes_decisions():
    from itertools import product

    rng = np.random.default_rng(2)
    emit, runs = rng.uniform(0.05, 0.95, 11), np.array([0] * 6 + [1] + [2] * 4)
    link = rng.uniform(0.1, 2.0, (11, 2, 2))
    got = forward_backward(emit, runs, link)
    for run in range(3):
        at = np.flatnonzero(runs == run)
        total, yes = 0.0, np.zeros(len(at))
        for states in product((0, 1), repeat=len(at)):
            w = 1.0
            for k, (i, x) in enumerate(zip(at, states)):
                w *= (emit[i] if x else 1 - emit[i]) * (link[i][states[k - 1], x] if k else 1.0)
            total += w
            yes += w * np.array(states)
        assert np.allclose(got[at], yes / total)
    # Boundaries around one word repel each other: the weaker of two is given up.
    repel = np.tile(np.array([[1.0, 1.0], [1.0, 0.05]]), (2, 1, 1))
    assert (forward_backward(np.array([0.9, 0.6]), np.zeros(2, int), repel) >= 0.5).tolist() == [True, False]


def test_sentences_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert rows(sentence_units(df)) == []
    assert fit_events(gap_table(df)).counts.sum() == 0


def test_prose_is_no_code(spark):
    code = ["f(x);", "int x = 5;", "if (x > 1) {", "} else {", "h = sha256:00068d26", "8310\t0.22\tBortrekrin\tNULL\t\t0x2076", "def f(a, b=None):", '{"a": "We left. He ran."}', "SELECT * FROM t WHERE a = 1", "$ ls -la /tmp"]
    prose = [
        "Πού άφησες το ποδήλατο;", "We met near the allotment last week;", "The\tmarathon\ttook\t172\tminutes.\tWe\tleft.", "> We left the bus. He ran.", "[14:50] user: see [1]",
        "for Mr. Grimvul (ext. 171) at reception. I packed", "from 0.402 to 0.704 after the merge. We took the train (it", "if you want (or not), come: we left;", "RETURN (THE BOOK). WE LEFT THEM.",
    ]
    assert [x for x in code if not code_like(x)] == [] and [x for x in prose if code_like(x)] == []
    filler = [f"We took the train {n} times. He ran home. I packed the lamp. Mr. Ralchum (ext. {n}) moved the visit to Monday." for n in range(30)]
    greek = "Χθες έστειλα 719 γράμματα στην πόλη. Πού άφησες το ποδήλατο;"
    texts = [greek, "We\ttook\tthe\ttrain.\tHe\tran\thome.", "We asked\nfor Mr. Ralchum (ext. 171) at reception. I packed the lamp.", "> We took the train. He ran home."]
    got = sentences(spark, [*texts, *filler])
    assert got[0] == ["Χθες έστειλα 719 γράμματα στην πόλη.", "Πού άφησες το ποδήλατο;"]
    assert got[1] == ["We\ttook\tthe\ttrain.", "He\tran\thome."]
    assert got[2] == ["We asked\nfor Mr. Ralchum (ext. 171) at reception.", "I packed the lamp."]
    assert got[3] == ["> We took the train.", "He ran home."]
