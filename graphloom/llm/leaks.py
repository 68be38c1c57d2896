"""Evaluation items that leak into documents.

Texts are canonicalised to templates: numbers, units and names become typed placeholders, each with a slot value. A word is
template vocabulary where more than a hundred-and-twentieth of the different items has it, otherwise it fills a slot, so
the vocabulary neither grows with the items nor changes when items are repeated. The template windows of a slot (its
placeholder with the word or placeholder before or after it) are hash-joined with those of the items' sentences, the
slots that are rarest in the corpus first. Slot consistency is then checked: the same sentence pattern with other names
and numbers is a re-parameterised question or a distractor and no leak. Sentences with fewer than two slots have windows
of rare words or, where they have none either, of neighbouring words instead.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut, spread

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝвкмнтАЕОРСУХІЈЅВКМНТαοενιρτυκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijshdqwbkmhtAEOPCYXIJSBKMHTaoeviptukxABEZHIKMNOPTYX",
)
MIXED = regex.compile(r"[\p{Latin}]")
FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}--[ऀ-෿฀-๿]]", regex.V1)
TOKEN = regex.compile(r"\p{N}+|[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{M}]+")
PLAIN_TOKEN = re.compile(r"[0-9]+|[a-z]+")
WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
SENTENCE = regex.compile(r"(?<=[.!?।])\s+|(?<=[。！？])")

#: Words for units of measure, money and time.
UNITS = set(
    "mm cm m km g kg mg l ml h min s gram grams kilo kilos metre metres meter meters mile miles litre litres liter liters minute minutes hour hours day days week weeks month months "
    "year years coins euro euros dollar dollars percent am pm uhr minuten stunden wochen tage gramm taler минут часов граммов рублей недель дней 分钟 小时 克 元".split()
)

#: The template vocabulary: words in more than this share of the different items (and in two of them at least).
COMMON_SHARE = 1 / 120
#: Characters of names in scripts without spaces: their share of the items of such scripts, and the most chance that two of
#: their occurrences have both neighbours alike, and the one before or the one after. Chances don't change with the number of items.
NAMED_ITEMS = 0.35
NAMED_ALIKE = 0.01
NAMED_SIDE_ALIKE = 0.055
#: Share of an item's evidence, of a sentence's slots and of its words that must be found.
EVIDENCE_SHARE = 0.30
SLOT_SHARE = 0.6
#: Evidence may be cut inside a sentence, so its parts need fewer of the slots.
PART_SLOT_SHARE = 0.5
WORD_SHARE = 0.4
#: A sentence is a candidate where this share of its slots, rounded up, meets in template windows.
MEETING_SHARE = 0.4
#: A document is checked for an item where such sentences are this share of its evidence (in words), or its question and answer.
MEETING_EVIDENCE = 0.15
#: Bits of the filter on the items' windows that documents are read with; a fixed size, and only a filter before the join.
FILTER_BITS = 1 << 22


def clean(text: str) -> str:
    """NFKC without invisible characters and accents, look-alike letters of mixed words made Latin, line hyphens joined."""
    if text.isascii():
        return re.sub(r"(\w)-\r?\n(\w)", r"\1\2", text) if "-" in text else text
    text = unicodedata.normalize("NFKC", text)
    text = HIDDEN.sub("", unicodedata.normalize("NFD", text))
    text = unicodedata.normalize("NFC", text)
    text = re.sub(r"(\w)-\r?\n(\w)", r"\1\2", text)
    if FOREIGN.search(text) and len(MIXED.findall(text)) > len(FOREIGN.findall(text)):
        text = regex.sub(r"[\p{L}]+", lambda m: _latin(m[0]), text)
    return text


def _latin(word: str) -> str:
    if not FOREIGN.search(word):
        return word
    swapped = word.translate(LOOKALIKES)
    return word if FOREIGN.search(swapped) else swapped


def words(text: str) -> list[str]:
    """Lower-case words, numbers, and single characters of scripts without spaces."""
    text = clean(text).lower()
    return PLAIN_TOKEN.findall(text) if text.isascii() else TOKEN.findall(text)



@lru_cache(maxsize=1 << 18)
def alike(a: str, b: str) -> bool:
    """Equal, or words with one edit up to six letters and two beyond; numbers must be equal."""
    if a == b:
        return True
    if a.isdigit() or b.isdigit() or min(len(a), len(b)) < 4:
        return False
    most = 1 if max(len(a), len(b)) < 7 else 2
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


WORD, NUMBER, UNIT, NAME = range(4)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
PLACE = np.array([0x11, 0x2B5D, 0x3F17, 0x5AC3], dtype=np.uint64)
EDGE = np.uint64(0x77 << 2)
#: Stands between texts that are canonicalised together.
BETWEEN = ""


def _mixed(a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
    h = (a * MIX[0]) ^ (b * MIX[1]) ^ np.uint64(side * 0x51ED)
    h = (h ^ (h >> np.uint64(29))) * MIX[2]
    return h ^ (h >> np.uint64(32))


class Codes(dict):
    """The code of each unit: its hash with its kind in the last two bits; filled as units are met."""

    def __init__(self, common: set[str], named: set[str]):
        self.common, self.named = common, named

    def __missing__(self, unit: str) -> int:
        if unit == BETWEEN:
            return int(EDGE)
        if unit.isdigit():
            kind = NUMBER
        elif unit in UNITS:
            kind = UNIT
        elif WIDE.match(unit):
            kind = NAME if unit[0] in self.named else WORD
        else:
            kind = WORD if unit in self.common else NAME
        code = self[unit] = xxhash.xxh64_intdigest(unit) & ~3 | kind
        return code


class Lexicon:
    """The template vocabulary and the characters of names: what canonicalising a text needs. Both are shares of the
    items, so at most 120 times an item's average number of different words, whatever their number."""

    def __init__(self, common: set[str], named: set[str]):
        self.common, self.named = common, named
        self.codes = Codes(common, named)

    def __reduce__(self):
        return Lexicon, (self.common, self.named)

    def units(self, text: str) -> list[str]:
        """Lower-case words and numbers; runs of name characters are joined."""
        out: list[str] = []
        if text.isascii() or not WIDE.search(text):
            return words(text)
        joins = False
        for t in words(text):
            is_named = t in self.named
            if is_named and joins:
                out[-1] += t
            else:
                out.append(t)
            joins = is_named
        return out

    def canonical(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each unit, its kind, code of the unit or of its placeholder). A unit of measure follows a number."""
        if len(self.codes) > 400_000:
            self.codes.clear()
        value = np.fromiter(map(self.codes.__getitem__, units), np.uint64, len(units))
        kind = (value & np.uint64(3)).astype(np.int8)
        lone = kind == UNIT
        lone[1:] &= kind[:-1] != NUMBER
        kind[lone] = WORD
        return value, kind, np.where(kind == WORD, value, PLACE[kind])

    def windows(self, units: list[str], slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template windows with their slot's value, slot values, places): two windows for each slot, by default each number and name."""
        value, kind, canon = self.canonical(units)
        at = np.flatnonzero((kind == NUMBER) | (kind == NAME)) if slots is None else slots
        around = np.concatenate([[EDGE], canon, [EDGE]])
        own = value[at] + PLACE[kind[at]]
        return np.concatenate([_mixed(around[at], own, 1), _mixed(around[at + 2], own, 2)]), np.tile(value[at], 2), np.tile(at, 2)

    def plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(windows of two neighbouring words, places) for sentences that have no slots, for a single word with nothing."""
        value = self.canonical([*units, BETWEEN])[0]
        at = np.flatnonzero(value[:-1] != EDGE)
        inside = at[value[at + 1] != EDGE] if len(at) > 1 else at
        return _mixed(value[inside], value[inside + 1], 3), inside


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Document:
    """A document's units with an index by unit for looking up an item's sentences."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self.at: dict[str, list[int]] = defaultdict(list)
        for i, t in enumerate(tokens):
            self.at[t].append(i)
        self.by_side: dict[tuple[str, str], list[str]] | None = None
        self.near: dict[str, list[int]] = {}

    def places(self, token: str, slot: bool) -> list[int]:
        if not slot or token.isdigit() or len(token) < 4:
            return self.at.get(token, [])
        known = self.near.get(token)
        if known is None:
            if self.by_side is None:
                self.by_side = defaultdict(list)
                for t in self.at:
                    if len(t) >= 4 and not t.isdigit():
                        self.by_side["a", t[:2]].append(t)
                        self.by_side["z", t[-2:]].append(t)
            options = {*self.by_side.get(("a", token[:2]), []), *self.by_side.get(("z", token[-2:]), [])}
            known = self.near[token] = sorted({i for o in options if alike(token, o) for i in self.at[o]})
        return known

    def carries(self, tokens: list[str], flags: list[bool]) -> tuple[float, float]:
        """(share of slots, share of all words) of a sentence found in order-free places close together.

        In a sentence without slots every word is one.
        """
        if not tokens:
            return 0.0, 0.0
        slots = sum(flags)
        if not slots:
            slots, flags = len(tokens), [True] * len(tokens)
        reach = int(1.6 * len(tokens)) + 6
        found = [(p, i) for i, (t, s) in enumerate(zip(tokens, flags)) for p in (self.places(t, s) if s else self.at.get(t, []))]
        if not found:
            return 0.0, 0.0
        found.sort()
        best = (0.0, 0.0)
        positions = [p for p, _ in found]
        for start in sorted({p for p, i in found if flags[i]}):
            low = bisect_left(positions, start - reach // 3)
            high = bisect_left(positions, start + reach)
            hit: set[int] = set()
            used: set[int] = set()
            for p, i in found[low:high]:
                if i not in hit and p not in used:
                    hit.add(i)
                    used.add(p)
            share = (sum(flags[i] for i in hit) / slots, len(hit) / len(tokens))
            best = max(best, share, key=sum)
        return best


#: A sentence of an item: which part it is of, its units, which of them are slots.
Sentence = tuple[str, list[str], list[bool]]


def evidence_share(document: Document, sentences: list[Sentence]) -> float:
    """Share of the words of the item's evidence that the document has in sentences whose slots agree with it."""
    found, length = 0.0, 0
    for part, tokens, flags in sentences:
        if part == "e":
            length += len(tokens)
            slot_share, word_share = document.carries(tokens, flags)
            if slot_share >= PART_SLOT_SHARE and word_share >= WORD_SHARE:
                found += word_share * len(tokens)
    return found / length if length else 0.0


def leaks(document: Document, sentences: list[Sentence]) -> bool:
    if evidence_share(document, sentences) >= EVIDENCE_SHARE:
        return True
    held = {}
    for part, tokens, flags in sentences:
        if part != "e":
            slot_share, word_share = document.carries(tokens, flags)
            held[part] = slot_share >= SLOT_SHARE and word_share >= WORD_SHARE
    return held.get("q", False) and held.get("a", False)


SEPARATOR = "\x1f"


def item_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """item, word, inside, capital, caseless: each different word of an item, how often it is not the first of its
    sentence, and how often it is written with a capital then."""
    for frame in frames:
        rows = []
        for item, *parts in zip(frame["item"], frame["question"], frame["answer"], frame["evidence"]):
            inside: Counter = Counter()
            capital: Counter = Counter()
            for sentence in (s for part in parts for s in SENTENCE.split(clean(part or ""))):
                cased = TOKEN.findall(sentence)
                inside.update({t.lower(): 0 for t in cased[:1]})
                inside.update(t.lower() for t in cased[1:])
                capital.update(t.lower() for t in cased[1:] if t[:1].isupper())
            rows += [(item, w, n, capital[w], w.upper() == w and not w.isdigit() and not WIDE.match(w)) for w, n in inside.items()]
        yield pd.DataFrame(rows, columns=["item", "word", "inside", "capital", "caseless"])


def item_characters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """item, character, before, after, n: characters of scripts without spaces with their neighbours."""
    for frame in frames:
        rows = []
        for item, *parts in zip(frame["item"], frame["question"], frame["answer"], frame["evidence"]):
            mine = [t for part in parts for t in words(part or "") if WIDE.match(t)]
            if len(mine) > 10:
                rows += [(item, t, a, b, n) for (a, t, b), n in Counter(zip(["", *mine], mine, [*mine[1:], ""])).items()]
        yield pd.DataFrame(rows, columns=["item", "character", "before", "after", "n"])


def fit_lexicon(items: DataFrame) -> tuple[Lexicon, DataFrame, int]:
    """(lexicon, item with its names, most items that a name is in) from counts over all different items.

    Names are words outside the vocabulary that are always capitalised inside sentences, or any in scripts without case.
    """
    count = items.count()
    most = max(1, int(count * COMMON_SHARE))
    found = cut(items.mapInPandas(item_words, "item bigint, word string, inside bigint, capital bigint, caseless boolean"))
    stats = found.groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.sum("inside").alias("in"), F.sum("capital").alias("up"), F.max("caseless").alias("caseless"))
    common = {r["word"] for r in stats.where(F.col("seen") > most).select("word").collect()}
    names = stats.where((F.col("seen") <= most) & (F.col("caseless") | ((F.col("in") > 0) & (F.col("up") == F.col("in"))))).select("word")
    names = found.join(names, "word").groupBy("item").agg(F.collect_set("word").alias("names"))
    characters = cut(items.mapInPandas(item_characters, "item bigint, character string, before string, after string, n bigint"))
    wide = characters.select("item").distinct().count()
    named = characters.groupBy("character").agg(F.count_distinct("item").alias("seen"), F.sum("n").alias("total")).where(F.col("seen") >= NAMED_ITEMS * wide)
    for sides, most_alike in ((("before", "after"), NAMED_ALIKE), (("before",), NAMED_SIDE_ALIKE), (("after",), NAMED_SIDE_ALIKE)):
        alike_pairs = characters.groupBy("character", *sides).agg(F.sum("n").alias("n")).groupBy("character").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
        named = named.join(alike_pairs, "character").where(F.col("same") < most_alike * F.col("total") * (F.col("total") - 1)).drop("same")
    return Lexicon(common, {r["character"] for r in named.select("character").collect()}), names, most


def sentences_of(frame: pd.DataFrame, lexicon: Lexicon) -> pd.DataFrame:
    """item, part, units, flags, slots, windows, slot_values: the canonical sentences of items (question and answer are one each)."""
    rows = []
    for item, question, answer, evidence, names in zip(frame["item"], frame["question"], frame["answer"], frame["evidence"], frame["names"]):
        own = set(names) if names is not None else set()
        cutup = [("q", question), ("a", answer), *(("e", s) for s in SENTENCE.split(clean(evidence or "")))]
        for part, text in cutup:
            units = lexicon.units(text or "")
            if not units:
                continue
            kind = lexicon.canonical(units)[1]
            flags = np.array([k == NUMBER or (u[0] in lexicon.named if WIDE.match(u) else u in own) for u, k in zip(units, kind)])
            slots = int(flags.sum())
            if not slots and (kind == NAME).sum() >= 2:
                flags = kind == NAME
            windows, values, _ = lexicon.windows(units, np.flatnonzero(flags))
            if not flags.any():
                windows = values = lexicon.plain(units)[0]
            rows.append((item, part, SEPARATOR.join(units), "".join("01"[int(f)] for f in flags), slots, signed(windows).tolist(), signed(values).tolist()))
    return pd.DataFrame(rows, columns=["item", "part", "units", "flags", "slots", "windows", "slot_values"])


def read_documents(frames: Iterator[pd.DataFrame], lexicon: Lexicon, known: np.ndarray) -> Iterator[pd.DataFrame]:
    """doc_id, units, windows, slot_values: texts are tokenised once; only windows that may be an item's are kept."""
    for frame in frames:
        texts = [lexicon.units(text) for text in frame["text"]]
        ends = np.cumsum([len(units) + 1 for units in texts], dtype=np.int64)
        joined = [u for units in texts for u in (*units, BETWEEN)]
        windows, values, places = lexicon.windows(joined)
        plain, plain_places = lexicon.plain(joined)
        windows, values, places = np.concatenate([windows, plain]), np.concatenate([values, plain]), np.concatenate([places, plain_places])
        hit = np.flatnonzero(known[windows % np.uint64(FILTER_BITS)])
        if not len(hit):
            continue
        owner = np.searchsorted(ends, places[hit], side="right")
        order = np.argsort(owner, kind="stable")
        owner, hit = owner[order], hit[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        mine, parts = owner[[0, *cuts]], np.split(hit, cuts)
        yield pd.DataFrame({
            "doc_id": frame["doc_id"].to_numpy()[mine], "units": [SEPARATOR.join(texts[i]) for i in mine],
            "windows": [np.unique(signed(windows[p])) for p in parts], "slot_values": [np.unique(signed(values[p])) for p in parts],
        })


#: Parts that a window's rows are spread over in the join, so that one which a third of the corpus has isn't one task.
SALTS = 8


def item_sentences(items: DataFrame) -> tuple[Lexicon, DataFrame, DataFrame]:
    """(lexicon, sentences with `sid`, members): the canonical sentences of the different items, and which ids share an item.

    Evidence without any slot that more items have than a name may is a stock phrase and left out.
    """
    slim = items.where("item_id is not null").select("item_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer", "evidence")])
    same = F.sha2(F.concat_ws("\x1e", "question", "answer", "evidence"), 256)
    members = slim.select("item_id", same.alias("same"), "question", "answer", "evidence")
    different = cut(members.groupBy("same").agg(F.min("item_id").alias("item"), *[F.first(c).alias(c) for c in ("question", "answer", "evidence")]))
    lexicon, names, most = fit_lexicon(different)
    shared = items.sparkSession.sparkContext.broadcast(lexicon)
    schema = "item bigint, part string, units string, flags string, slots int, windows array<bigint>, slot_values array<bigint>"
    made = different.join(names, "item", "left").mapInPandas(lambda frames: (sentences_of(f, shared.value) for f in frames), schema)
    made = cut(made.withColumn("sid", F.xxhash64("item", "part", "units")).dropDuplicates(["sid"]))
    stock = made.where("slots = 0 and part = 'e'").groupBy("units").agg(F.count_distinct("item").alias("n")).where(F.col("n") > most)
    stock = made.where("slots = 0 and part = 'e'").join(stock, "units").select("sid")
    return lexicon, made.join(stock, "sid", "left_anti"), members.join(different.select("same", "item"), "same").select("item_id", "item")


def document_windows(documents: DataFrame, lexicon: Lexicon, sentences: DataFrame) -> DataFrame:
    """doc_id, units, windows, slot_values of the documents that have a window of an item."""
    spark = documents.sparkSession
    bits = sentences.select(F.explode("windows").alias("w")).select(F.expr(f"pmod(w, {FILTER_BITS})").cast("int").alias("b")).distinct().toPandas()["b"]
    known = np.zeros(FILTER_BITS, bool)
    known[bits.to_numpy(np.int64)] = True
    shared = spark.sparkContext.broadcast((lexicon, known))
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id")
    return docs.mapInPandas(lambda frames: read_documents(frames, *shared.value), "doc_id bigint, units string, windows array<bigint>, slot_values array<bigint>")


def candidates(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, item: documents in which enough sentences of the item have 40 % of their slots, rounded up, in template windows.

    A sentence with s slots of which n must meet has one of its s - n + 1 rarest slots in every such document, so only
    these are joined; the number of slots that meet is counted on the pairs found.
    """
    needed = F.greatest(F.lit(1), F.ceil(F.size(F.array_distinct("slot_values")) * MEETING_SHARE).cast("int"))
    sents = sentences.withColumn("need", needed)
    in_docs = docs.select("doc_id", F.explode("windows").alias("window"))
    counts = in_docs.groupBy("window").agg(F.count(F.lit(1)).alias("df"))
    pairs = sents.select("sid", "need", F.explode(F.arrays_zip("windows", "slot_values")).alias("z"))
    pairs = pairs.select("sid", "need", F.col("z.windows").alias("window"), F.col("z.slot_values").alias("slot_value"))
    known = pairs.join(counts, "window", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    per_slot = known.groupBy("sid", "need", "slot_value").agg(F.sum("df").alias("df"), F.collect_set("window").alias("windows"))
    by_rarity = Window.partitionBy("sid").orderBy("df", "slot_value")
    ranked = per_slot.withColumn("rank", F.row_number().over(by_rarity)).withColumn("slots", F.count(F.lit(1)).over(Window.partitionBy("sid")))
    anchors = ranked.where("rank <= slots - need + 1 and df > 0").select("sid", F.explode("windows").alias("window"))
    salted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = in_docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["window", "salt"]).select("doc_id", "sid").distinct()
    mine = sents.select("sid", "item", "part", F.length("flags").alias("n"), "need", F.col("slot_values").alias("wanted"))
    agreeing = met.join(docs.select("doc_id", "slot_values"), "doc_id").join(mine, "sid").where(F.size(F.array_intersect("slot_values", "wanted")) >= F.col("need"))
    of = lambda part, value: F.sum(F.when(F.col("part") == part, value).otherwise(0))
    found = agreeing.groupBy("doc_id", "item").agg(of("e", F.col("n")).alias("found"), of("q", 1).alias("q"), of("a", 1).alias("a"))
    lengths = sents.groupBy("item").agg(of("e", F.length("flags")).alias("all"))
    enough = (F.col("found") > 0) & (F.col("found") >= MEETING_EVIDENCE * F.col("all"))
    return found.join(lengths, "item").where(enough | ((F.col("q") > 0) & (F.col("a") > 0))).select("doc_id", "item")


@lru_cache(maxsize=4_000)
def _opened(packed: str) -> list[Sentence]:
    return [(part, units.split(SEPARATOR), [f == "1" for f in flags]) for part, units, flags in json.loads(packed)]


def check_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of a document and an item that are leaks; rows of one document mostly follow one another."""
    last, document = None, None
    for frame in frames:
        hits = []
        for doc_id, units, packed in zip(frame["doc_id"], frame["units"], frame["sentences"]):
            if last != doc_id or document is None:
                last, document = doc_id, Document(units.split(SEPARATOR))
            hits.append(leaks(document, _opened(packed)))
        yield frame.loc[hits, ["doc_id", "item"]]


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: every document that holds an item's question with its answer or a third of its evidence.

    Items of equal texts are one item for all counts. Null and empty texts hold nothing; an item without evidence and without
    question or answer is in no document. Extra columns are ignored; rows with a null id are left out. Empty tables give no
    rows.
    """
    lexicon, sentences, members = item_sentences(items)
    docs = cut(document_windows(documents, lexicon, sentences))
    pairs = cut(candidates(docs, sentences))
    packed = sentences.groupBy("item").agg(F.to_json(F.sort_array(F.collect_list(F.array("part", "units", "flags")))).alias("sentences"))
    rows = docs.select("doc_id", "units").join(pairs, "doc_id").join(packed, "item").select("doc_id", "item", "units", "sentences")
    found = rows.mapInPandas(check_pairs, "doc_id bigint, item bigint")
    return found.join(members, "item").select("doc_id", "item_id")


def reparameterised(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, template, sentences, consistent: documents with a sentence of an item's template in other words, pre-aggregated.

    template: a hash of the canonical sentence with at least two placeholders; sentences: how many of the document's have
    it; consistent: how many of these have all slot values of some item, too. Rows with fewer consistent sentences than
    sentences hold a re-parameterised question. One row for each document and template, never one for each item.
    """
    lexicon, sentences, _ = item_sentences(items)
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def canon(units: list[str]) -> tuple[int, int] | None:
        value, kind, places = shared.value.canonical(units)
        slots = (kind == NUMBER) | (kind == NAME)
        return (_digest(places), _digest(value[slots])) if slots.sum() >= 2 and (kind == WORD).sum() >= 2 else None

    def of_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                for sentence in SENTENCE.split(clean(text)):
                    units = shared.value.units(sentence)
                    got = canon(units) if units else None
                    if got:
                        rows.append((doc_id, *got))
            yield pd.DataFrame(rows, columns=["doc_id", "template", "slot_values"])

    def of_items(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [c for c in (canon(u.split(SEPARATOR)) for u in frame["units"]) if c]
            yield pd.DataFrame(got, columns=["template", "slot_values"])

    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id")
    asked = cut(sentences.select("units").mapInPandas(of_items, "template bigint, slot_values bigint").distinct())
    found = docs.mapInPandas(of_texts, "doc_id bigint, template bigint, slot_values bigint")
    found = found.join(asked.select("template").distinct(), "template", "left_semi")
    found = found.join(asked.withColumn("agrees", F.lit(1)), ["template", "slot_values"], "left")
    return found.groupBy("doc_id", "template").agg(F.count(F.lit(1)).alias("sentences"), F.count("agrees").alias("consistent"))


def _digest(values: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(values.tobytes()) - 2**63
