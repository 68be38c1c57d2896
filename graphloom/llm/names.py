"""Variant spellings of names by noisy-channel attribution.

Mentions of a context are reduced to forms (their words in any order, layout, case and script fixed). Within blocks that
share a rare word up to one letter, initials or the joined spelling, fuller and more frequent forms are candidate
canonical forms. A form is attached to the one with the highest posterior: a prior that grows with the candidate's
frequency times the likelihood of the typos, initials, nicknames, abbreviations and left-out words that turn it into the
variant, against the chance that the form is a name of its own. Attached forms and their mentions become one group.

The channel is learnt from the mentions: names that agree in all words but one, a rare word among them, show how often a
word is written with a typo, cut short, squeezed or as an initial, and which words replace one another as often as
nicknames do. Hand-set costs are only the start of these counts. Words of many different names are generic.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.groups import connected_groups
from graphloom.llm.leaks import clean
from graphloom.session import cut, spread

#: Titles, legal forms, and short forms of words in names of organisations and places.
TITLES = set("mr mrs ms miss dr prof sir mx rev".split())
LEGAL = set("sa ag gmbh oy inc ltd llc bv limited incorporated plc corp nv ab spa kg srl".split())
SHORT = {
    short: full
    for full, shorts in {
        "international": "intl int", "manufacturing": "mfg manuf", "institute": "inst", "technical": "tech", "engineering": "eng engrg engg",
        "university": "univ uni", "brothers": "bros", "hospital": "hosp", "department": "dept dep", "general": "gen", "foundation": "found fdn",
        "services": "svcs serv svc", "national": "natl nat", "association": "assn assoc", "laboratories": "lab labs", "northern": "nthn north",
        "company": "co", "partners": "ptnrs", "logistics": "logist", "consulting": "cons", "medical": "med", "digital": "dig",
        "mount": "mt", "saint": "st", "port": "pt", "bridge": "brg br", "upper": "upr", "lower": "lwr", "valley": "vly", "harbour": "hbr harbor", "market": "mkt",
    }.items()
    for short in shorts.split()
}
SHORT_OF: dict[str, list[str]] = {}
for _short, _full in SHORT.items():
    if len(_short) >= 3:
        SHORT_OF.setdefault(_full, []).append(_short)
ORG_WORDS = set(
    "international manufacturing institute technical engineering university brothers hospital department general foundation services national association "
    "laboratories northern company partners logistics consulting bakery".split()
)
ORG_MIDDLE = set("medical digital urban alpine marine".split())
PLACE_WORDS = set("mount saint port bridge upper lower valley harbour market new old lake hills falls".split())
PRODUCT_WORDS = set("mini pro x go one max plus lite".split())
GENERIC = ORG_WORDS | ORG_MIDDLE | PLACE_WORDS | PRODUCT_WORDS
#: Given names and their familiar forms.
NICKNAMES = {
    "susanna": "sue susie suzy", "margaret": "maggie meg peggy", "elizabeth": "beth lizzie liz betty eliza", "patricia": "pat trish patty", "katherine": "kat kate kathy katie",
    "alexander": "alex xander sasha", "aleksandra": "sasha ola alex", "gabriella": "gabby ella", "william": "will billy bill", "joseph": "joe jo joey", "nicholas": "nick nico",
    "charles": "charlie chuck", "benjamin": "ben benny", "theodore": "ted theo teddy", "anastasia": "stacy nastya", "friedrich": "fritz fred", "richard": "rick dick rich",
    "eleanor": "ellie nell nora", "robert": "bob rob bobby", "ekaterina": "katya kate", "francisco": "paco pancho frank", "josefina": "pepa jo fina", "dmitri": "dima mitya",
    "johannes": "hannes hans", "jurgen": "jurg", "tomas": "tom tommy", "viktor": "vik vitya", "nadia": "nadya", "yusuf": "yus joe", "boris": "borya", "andre": "andy",
}
FAMILIAR = {name: set(v.split()) for name, v in NICKNAMES.items()}
GIVEN = set(NICKNAMES) | {n for v in FAMILIAR.values() for n in v} | set(
    "bjorn priya rania lucia elif soren uma lukasz dagny chiara ingrid noemi fatima xenia wanda goran oyvind quentin kenji anna mei helene zoe".split()
)
SPECIES = set("cat dog parrot rabbit tortoise gecko ferret hamster horse bird fish turtle pony goat".split())
KINDS = {
    "person": "person", "per": "person", "people": "person", "user": "person", "human": "person", "org": "org", "organisation": "org", "organization": "org", "company": "org",
    "place": "place", "location": "place", "loc": "place", "city": "place", "product": "product", "device": "product", "animal": "animal", "pet": "animal",
}
STROKES = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})

#: Costs (negative log likelihoods) that the counts start from, and the most that an attachment may cost.
TYPO, TYPO_TWICE, CUT_SHORT, LEFT_OUT, LEFT_OUT_GENERIC, ADDED, OTHER_KIND = 1.8, 4.2, 1.5, 1.6, 0.9, 2.6, 3.0
START = {"initial": 1.0, "nickname": 0.7, "typo": TYPO, "typo twice": TYPO_TWICE, "cut short": CUT_SHORT, "squeezed": 2.0, "familiar": 1.5}
START_WEIGHT = 200.0
OWN_NAME = 5.0
SURE = 0.6
#: A word is generic from this share of all different names on (and a few of them at least).
GENERIC_SHARE, GENERIC_LEAST = 1 / 400, 8
#: A learnt nickname: how many names have it, its share of what stands for the word, how much more often than by chance, and
#: its share of all replacements.
NICKNAME_LEAST, NICKNAME_SHARE, NICKNAME_LIFT, NICKNAME_OF_ALL = 4, 0.25, 6, 1 / 10_000
#: Pairs of a block are compared in squares of this many forms.
SQUARE = 512
FOLDED = [("ck", "k"), ("ch", "k"), ("ph", "f"), ("th", "t"), ("c", "k"), ("q", "k"), ("v", "f"), ("z", "s"), ("y", "i"), ("j", "i")]


def kind_of(hint: str | None) -> str | None:
    """person, org, place, product or animal from a free-form hint; null for unknown ones."""
    return KINDS.get((hint or "").strip().lower())


def parse(surface: str | None) -> list[str]:
    """Lower-case words of a name: fixed scripts, no accents, titles and legal forms, known short forms spelled out."""
    text = clean(surface or "").translate(STROKES)
    text = regex.sub(r"['’`´]s?(?=\s|$|[.,)])", "", text)
    text = regex.sub(r"['’`´]", "", text)
    if not text.isupper():
        text = regex.sub(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll}|\p{Lu}$)", " ", text)
    text = regex.sub(r"\b(?:\p{L}\.){2,}(?:\p{L}\b\.?)?|\b\p{L}\.\p{L}\b", lambda m: m[0].replace(".", "") + " ", text)
    words = [SHORT.get(w, w) for w in regex.findall(r"\p{L}+|\p{N}+", text.lower())]
    kept = [w for w in words if w not in TITLES and w not in LEGAL and w not in SPECIES and w not in ("the", "and", "of")]
    return kept or words


def guessed_kind(words: list[str], kind: str | None) -> str | None:
    """The kind that the words themselves show, else the hint."""
    have = set(words)
    if have & ORG_WORDS:
        return "org"
    if have & PLACE_WORDS and len(words) > 1:
        return "place"
    if any(w.isdigit() for w in words) and len(words) > 1:
        return "product"
    return kind


@lru_cache(maxsize=200_000)
def typos(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours counting once; 3 for more than two."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if older and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        older, old = old, row
        if min(row) > 2:
            return 3
    return min(3, old[-1])


@lru_cache(maxsize=200_000)
def sounds(word: str) -> str:
    for a, b in FOLDED:
        word = word.replace(a, b)
    return regex.sub(r"(.)\1+", r"\1", word)


def squeezed(seen: str, meant: str) -> bool:
    """Whether seen is meant with letters left out: the first letter stays, most of what is left are consonants."""
    if len(seen) < 3 or seen[0] != meant[0] or not len(seen) <= 0.75 * len(meant) or sum(c in "aeiou" for c in seen[1:]) > len(seen) // 3:
        return False
    rest = iter(meant)
    return all(c in rest for c in seen)


@lru_cache(maxsize=200_000)
def operation(seen: str, meant: str) -> str | None:
    """How `seen` may stand for `meant` by its letters alone; none if it can't."""
    if seen == meant:
        return "same"
    if seen.isdigit() or meant.isdigit():
        return None
    if len(seen) == 1 or len(meant) == 1:
        return "initial" if seen[0] == meant[0] else None
    if seen in FAMILIAR.get(meant, ()) or meant in FAMILIAR.get(seen, ()) or (seen in GIVEN and meant in GIVEN and any({seen, meant} <= f for f in FAMILIAR.values())):
        return "nickname"
    if seen in GIVEN and meant in GIVEN or seen in GENERIC and meant in GENERIC:
        return None
    d = typos(seen, meant)
    if d == 1 and min(len(seen), len(meant)) >= 3:
        return "typo"
    if d == 2 and min(len(seen), len(meant)) >= 7:
        return "typo twice"
    if len(seen) >= 3 and len(meant) - len(seen) >= 2 and (meant.startswith(seen) or (meant in GENERIC and any(typos(seen, s) <= 1 for s in SHORT_OF.get(meant, ())))):
        return "cut short"
    if squeezed(seen, meant):
        return "squeezed"
    stem = sounds(seen).rstrip("aeiou")
    if len(stem) >= 3 and len(seen) < len(meant) and len(seen) - len(stem) <= 2 and sounds(meant).startswith(stem):
        return "familiar"
    return None


class Channel:
    """Costs of what happens to a word, learnt nicknames and generic words; all of bounded size."""

    def __init__(self, costs: dict[str, float] = START, nicknames: dict[tuple[str, str], float] | None = None, generic: frozenset = frozenset()):
        self.costs, self.nicknames, self.generic = costs, nicknames or {}, GENERIC | generic

    def is_core(self, word: str) -> bool:
        return len(word) >= 4 and word not in self.generic and word not in GIVEN and not word.isdigit()

    def word_cost(self, seen: str, meant: str) -> tuple[float, bool] | None:
        """(cost of writing `seen` for `meant`, whether they are spellings of one another); none if it can't be."""
        op = operation(seen, meant)
        if op == "same":
            return 0.0, True
        learnt = self.nicknames.get((seen, meant), self.nicknames.get((meant, seen)))
        if op is None:
            return None if learnt is None else (learnt, False)
        cost = self.costs[op]
        return (cost if learnt is None else min(cost, learnt)), op in ("typo", "typo twice")

    def cost(self, variant: list[str], canonical: list[str]) -> float | None:
        """Negative log likelihood that the canonical words come out as the variant's; none if they can't."""
        v_all, c_all = "".join(variant), "".join(canonical)
        joined = typos(v_all, c_all)
        if joined <= 1 and min(len(v_all), len(c_all)) >= 6 and [w for w in variant if w.isdigit()] == [w for w in canonical if w.isdigit()]:
            return 0.3 + self.costs["typo"] * joined
        if len(variant) == 1 and 2 <= len(variant[0]) <= 5 and len(canonical) >= 2 and variant[0] == "".join(w[0] for w in canonical):
            return 1.0
        options = sorted((got[0], i, j, got[1]) for i, v in enumerate(variant) for j, w in enumerate(canonical) if (got := self.word_cost(v, w)) is not None)
        used_v: dict[int, int] = {}
        used_c: set[int] = set()
        cost, core = 0.0, False
        alone = len(variant) == len(canonical) == 1
        # Short names count where all other words agree to the letter.
        whole = len(variant) == len(canonical) >= 2
        for c, i, j, spelling in options:
            if i not in used_v and j not in used_c:
                used_v[i] = j
                used_c.add(j)
                cost += c
                if spelling and (self.is_core(variant[i]) and self.is_core(canonical[j]) or (len(variant[i]) >= 4 and alone) or (whole and c == 0 and len(variant[i]) >= 2 and variant[i] not in self.generic and not variant[i].isdigit())):
                    core = True
        if not core:
            return None
        extra = [v for i, v in enumerate(variant) if i not in used_v]
        missing = [w for j, w in enumerate(canonical) if j not in used_c]
        if extra and missing:
            return None
        if any(w.isdigit() for w in extra) or any(w.isdigit() for w in missing):
            return None
        return cost + ADDED * len(extra) + sum(LEFT_OUT_GENERIC if w in self.generic else LEFT_OUT for w in missing)


def block_keys(words: list[str], channel: Channel) -> set[str]:
    """Keys by which forms meet: rare words up to one left-out letter, the joined spelling, and initials."""
    keys: set[str] = set()
    cores = [w for w in words if channel.is_core(w)] or sorted((w for w in words if len(w) >= 2 and not w.isdigit() and w not in channel.generic), key=len, reverse=True)[:2]
    joined = "".join(sorted(words)) if len(words) > 1 else "".join(words)
    for word in {*cores, "".join(words)}:
        keys |= {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) >= 4 else {word}
    # Two typos in a word mostly leave one of its ends.
    keys |= {k for w in cores if len(w) >= 7 for k in (("^" + w[:6], "$" + w[-6:]) if len(w) >= 9 else ("^" + w[:5], "$" + w[-5:]))}
    keys.add(joined)
    if len(words) >= 2:
        keys.add("." + "".join(w[0] for w in words))
    elif len(words[0]) <= 5:
        keys.add("." + words[0])
    return keys


def fullness(words: list[str]) -> int:
    return sum(len(w) > 1 for w in words)


def forms_of(mentions: DataFrame) -> DataFrame:
    """mention_id, context_id, form (words joined by blanks, sorted), ordered (as written), kind of each usable mention."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for m, c, s, t in zip(frame["mention_id"], frame["context_id"], frame["surface"], frame["entity_type"]):
                words = parse(s)
                if words:
                    rows.append((m, c, " ".join(sorted(words)), " ".join(words), guessed_kind(words, kind_of(t))))
            yield pd.DataFrame(rows, columns=["mention_id", "context_id", "form", "ordered", "kind"])

    usable = mentions.where("mention_id is not null and context_id is not null and surface is not null")
    return spread(usable.select("mention_id", "context_id", "surface", "entity_type"), "mention_id").mapInPandas(
        run, "mention_id bigint, context_id string, form string, ordered string, kind string"
    )


def fit_channel(forms: DataFrame) -> Channel:
    """The channel from all forms; what reaches the driver is bounded: a row an operation, nicknames and generic words by share.

    Forms of a context that agree in all words but one are compared with the most frequent of them, never with each other.
    """
    words = forms.select("context_id", "n", F.explode(F.array_distinct(F.split("ordered", " "))).alias("word"))
    total = forms.count()
    least = max(GENERIC_LEAST, int(total * GENERIC_SHARE))
    generic = frozenset(r[0] for r in words.groupBy("word").count().where(F.col("count") >= least).select("word").collect())
    shared = forms.sparkSession.sparkContext.broadcast(Channel(generic=generic))

    def rests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for context, ordered, n in zip(frame["context_id"], frame["ordered"], frame["n"]):
                own = ordered.split()
                for i, word in enumerate(own):
                    rest = own[:i] + own[i + 1 :]
                    if not word.isdigit() and any(map(shared.value.is_core, rest)):
                        rows.append((" ".join([context, *sorted(rest)]), word, n))
            yield pd.DataFrame(rows, columns=["rest", "word", "n"])

    per = forms.select("context_id", "ordered", "n").mapInPandas(rests, "rest string, word string, n bigint").groupBy("rest", "word").agg(F.sum("n").alias("n"))
    per = cut(per)
    top = per.groupBy("rest").agg(F.max(F.struct(F.length("word").alias("l"), F.col("n"), F.col("word")))["word"].alias("meant"))
    seen = per.join(top, "rest").groupBy("word", "meant").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("n"))
    seen = cut(seen)

    def operations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ops = [operation(a, b) or ("differs" if a in GENERIC and b in GENERIC else "other") for a, b in zip(frame["word"], frame["meant"])]
            yield frame.assign(op=ops)

    named = cut(seen.mapInPandas(operations, "word string, meant string, names bigint, n bigint, op string"))
    counts = {r["op"]: r["n"] for r in named.groupBy("op").agg(F.sum("n").alias("n")).collect()}
    mentions = sum(counts.get(op, 0) for op in START)
    costs = {op: -math.log((counts.get(op, 0) + START_WEIGHT * math.exp(-start)) / (mentions + START_WEIGHT)) for op, start in START.items()}
    costs = {op: min(max(cost, 0.5 * START[op]), START[op] + 1.0) for op, cost in costs.items()}
    other = named.where("op = 'other' and length(word) > 1 and length(meant) > 1")
    of_word = named.where("word <> meant").groupBy("word").agg(F.sum("names").alias("all"))
    replaced = other.join(of_word, "word").where((F.col("names") >= NICKNAME_LEAST) & (F.col("names") >= NICKNAME_SHARE * F.col("all")))
    # Some word stands beside many others by chance: a nickname must do so several times as often as the word meant does at all.
    every = named.where("word <> meant").agg(F.coalesce(F.sum("names"), F.lit(0))).first()[0]
    of_meant = named.where("word <> meant").groupBy("meant").agg(F.sum("names").alias("of_meant"))
    replaced = replaced.join(of_meant, "meant").where((F.col("names") / F.col("all") >= NICKNAME_LIFT * F.col("of_meant") / every) & (F.col("names") >= NICKNAME_OF_ALL * every))
    nicknames = {(r["word"], r["meant"]): START["nickname"] - math.log(r["names"] / r["all"]) for r in replaced.collect()}
    return Channel(costs, nicknames, generic)


def name_groups(mentions: DataFrame) -> DataFrame:
    """mention_id, context_id, group_id: mentions of a context with the same group mean the same entity.

    Null and blank surfaces and rows without context are left out; equal spellings are always together. Empty input
    gives no rows; extra columns are ignored.
    """
    parsed = cut(forms_of(mentions))
    kinds = parsed.groupBy("context_id", "form", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ordered").alias("ordered"))
    votes = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind")))["kind"]
    forms = kinds.groupBy("context_id", "form").agg(F.sum("n").alias("n"), F.max(F.struct("n", "ordered"))["ordered"].alias("ordered"), votes.alias("kind"))
    forms = cut(forms.withColumn("id", F.xxhash64("context_id", "form")))
    channel = forms.sparkSession.sparkContext.broadcast(fit_channel(forms))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                words = row.ordered.split()
                rows += [(xxhash.xxh64_intdigest(f"{row.context_id}\x1f{k}") - 2**63, row.id, fullness(words), row.n) for k in block_keys(words, channel.value)]
            yield pd.DataFrame(rows, columns=["key", "id", "full", "n"])

    keys = spread(forms, "id").mapInPandas(keyed, "key bigint, id bigint, full int, n bigint")
    # A block is compared in squares of bounded size, so that one rare word in very many forms is many tasks.
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keys = keys.join(sizes.select("key", F.ceil(F.col("size") / SQUARE).cast("int").alias("g")), "key")
    keys = cut(keys.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("g")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    fuller = keys.select("key", F.col("id").alias("c"), F.col("full").alias("c_full"), F.col("n").alias("c_n"), F.col("part").alias("c_part"), every.alias("part"))
    later = F.struct("c_full", "c_n", "c") > F.struct("full", "n", "id")
    own = keys.select("key", "id", "full", "n", "part", every.alias("c_part"))
    pairs = own.join(fuller, ["key", "part", "c_part"]).where(later).select(F.col("id").alias("v"), "c").distinct()
    side = lambda p: forms.select("context_id", F.col("id").alias(p), F.col("ordered").alias(f"{p}_words"), F.col("kind").alias(f"{p}_kind"), F.col("n").alias(f"{p}_n"))
    pairs = pairs.join(side("v"), "v").join(side("c"), ["context_id", "c"])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cost_of = channel.value.cost
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                v_words, c_words = r.v_words.split(), r.c_words.split()
                cost = cost_of(v_words, c_words)
                if cost is None or cost > CUT_SHORT:
                    # Of two about equally full forms, either may be the one that was meant.
                    costs = [c for c in (cost, cost_of(c_words, v_words)) if c is not None]
                    if not costs:
                        continue
                    cost = min(costs)
                if r.v_kind and r.c_kind and r.v_kind != r.c_kind:
                    cost += OTHER_KIND
                cost -= 0.5 * math.log(r.c_n)
                if cost < OWN_NAME:
                    # Other layouts of the same letters are certain; they don't settle which fuller name is meant.
                    sure = cost < SURE and sorted("".join(c_words)) == sorted("".join(v_words))
                    rows.append((r.context_id, r.v, r.v_words, r.c, r.c_words, cost, sure))
            yield pd.DataFrame(rows, columns=["context_id", "v", "v_words", "c", "c_words", "cost", "sure"])

    scored = cut(pairs.mapInPandas(score, "context_id string, v bigint, v_words string, c bigint, c_words string, cost double, sure boolean"))
    open_ = scored.where(~F.col("sure"))
    best = open_.groupBy("context_id", "v").agg(F.min(F.struct("cost", "c", "c_words")).alias("best"))

    def rival(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The weights of candidates that can't be the same name as the best one."""
        cost_of = channel.value.cost
        for frame in frames:
            weights = []
            for best_words, words, cost in zip(frame["best_words"], frame["c_words"], frame["cost"]):
                a, b = best_words.split(), words.split()
                weights.append(math.exp(-cost) if a != b and cost_of(a, b) is None and cost_of(b, a) is None else 0.0)
            yield pd.DataFrame({"context_id": frame["context_id"], "v": frame["v"], "weight": weights})

    against = open_.join(best.select("context_id", "v", F.col("best.c_words").alias("best_words")), ["context_id", "v"])
    against = against.select("context_id", "v", "c_words", "cost", "best_words").mapInPandas(rival, "context_id string, v bigint, weight double")
    # These and a name of its own share the posterior with the best candidate.
    rivals = against.groupBy("context_id", "v").agg(F.sum("weight").alias("others"))
    won = best.join(rivals, ["context_id", "v"]).where(F.exp(-F.col("best.cost")) >= F.col("others") + math.exp(-OWN_NAME))
    links = scored.where("sure").select("context_id", "v", "c").unionByName(won.select("context_id", "v", F.col("best.c").alias("c")))
    groups = connected_groups(links, "v", "c", by=["context_id"]).select("context_id", F.col("vertex_id").alias("id"), "group_id")
    mine = parsed.withColumn("id", F.xxhash64("context_id", "form")).select("mention_id", "context_id", "id")
    return mine.join(groups, ["context_id", "id"], "left").select("mention_id", "context_id", F.coalesce("group_id", "id").alias("group_id"))


def same_name_pairs(mentions: DataFrame) -> DataFrame:
    """mention_id_a < mention_id_b of one context that mean the same entity, all pairs of a group.

    Very large groups are paired in squares of bounded size.
    """
    grouped = cut(name_groups(mentions).distinct())
    sizes = grouped.groupBy("context_id", "group_id").agg(F.ceil(F.count(F.lit(1)) / SQUARE).cast("int").alias("g"))
    grouped = grouped.join(sizes, ["context_id", "group_id"]).withColumn("part", F.pmod(F.xxhash64("mention_id"), F.col("g")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    a = grouped.select("context_id", "group_id", F.col("mention_id").alias("mention_id_a"), F.col("part").alias("a"), every.alias("b"))
    b = grouped.select("context_id", "group_id", F.col("mention_id").alias("mention_id_b"), F.col("part").alias("b"), every.alias("a"))
    return a.join(b, ["context_id", "group_id", "a", "b"]).where("mention_id_a < mention_id_b").select("mention_id_a", "mention_id_b")
