"""Sentence units of texts in any script by a hidden-event n-gram language model.

Between words lies a hidden event: a boundary token or none. The model gives the odds of the event from n-grams: how
often a boundary follows the left word and its punctuation, how often the right word begins a sentence against following
that left word inside one, and the same for word shapes as the back-off. Where a paragraph has no sentence marks at all,
every gap between its words (or characters, in scripts without spaces) is a candidate, and the odds come from the same
words with the marks left out: bigrams across and without a boundary token, backing off to single words. How often
boundaries follow one another after a single word is counted too and links such gaps, so the posteriors come from a forward-backward pass over each paragraph.

The n-grams are counted over all documents, first with the events that seed rules suggest, then with the posteriors of
that first model (expectation maximisation). Counts are hashed into a fixed number of buckets, so the model's size does
not grow with the corpus (16 MB at most).
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame

from graphloom.session import cut, spread


BUCKETS = 1 << 19
#: Buckets of word n-grams without marks; they follow the two halves of the others.
WORD_BUCKETS = 1 << 20
#: A paragraph without marks is taken for several sentences only from so many words (or characters without spaces) on.
LEAST_WORDS, LEAST_CHARACTERS = 6, 10
ROUNDS = 1
THRESHOLD = 0.5

#: Abbreviations that seed the first counts. The model learns others and unlearns these from the corpus.
SEED_ABBREVIATIONS = set(
    "mr mrs ms dr prof st sr jr vs etc e.g i.e approx no fig ext inc ltd co univ jan feb mar apr jun jul aug sep sept oct nov dec a.m p.m u.s ph.d "
    "z b d h ca nr fa str hr fr usw bzw u.a geb tel sra dra av p ej pág n.º ee uu a m mme mlle env ex chap cf "
    "ул д т е г проф им стр рис κ κα π.χ δηλ د أ डॉ श्री पं".split()
)
#: Abbreviations among them that often end a sentence.
SEED_ENDERS = set("inc ltd co etc a.m p.m ph.d u.s jr usw ee uu m".split())
#: Words after a day's number with a full stop: months and the like where ordinals are written so.
SEED_AFTER_ORDINAL = set("januar februar märz april mai juni juli august september oktober november dezember tag jahrhundert und bis".split())
#: Polite particles that end a sentence where a script has no sentence marks.
SEED_FINALS = ("ครับ", "ค่ะ", "คะ", "จ้ะ")

WORD = r"[\p{L}\p{M}\p{N}_&'’º@/-]"
CLOSERS = "\"'”’»›)]}」』】》〉“"
OPENERS = "\"'“‘„«‹([{「『【《〈¿¡—–-*_ "
EMOJI = r"(?:[\p{So}\U0001F3FB-\U0001F3FF️‍⃣]+|[:;=][-']?[)(DPp/|]+|<3)"
END = regex.compile(
    rf"(?P<mark>[.!?…]+|[。！？｡؟۔।॥;]+)(?P<close>[{regex.escape(CLOSERS)}]*(?:\s?[»”])?[{regex.escape(CLOSERS)}]*)(?P<emoji>(?:[^\S\n]*{EMOJI}(?![\p{{L}}\p{{N}}]))*)"
    rf"|(?<=\s)(?P<only>{EMOJI}(?:[^\S\n]*{EMOJI})*)(?![\p{{L}}\p{{N}}])"
)
#: END for texts of ASCII alone.
_PLAIN_EMOJI = r"(?:[:;=][-']?[)(DPp/|]+|<3)"
PLAIN_END = re.compile(
    rf"(?P<mark>[.!?]+|;+)(?P<close>[\"')\]}}]*)(?P<emoji>(?:[^\S\n]*{_PLAIN_EMOJI}(?![A-Za-z0-9]))*)|(?<=\s)(?P<only>{_PLAIN_EMOJI}(?:[^\S\n]*{_PLAIN_EMOJI})*)(?![A-Za-z0-9])"
)
SPACE_SCRIPT = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{N}\p{Latin}])[^\S\n]+(?=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{N}\p{Latin}])")
UNSPACED = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
#: The word that ends at a place, matched backwards from there.
LEFT = regex.compile(rf"(?r)(?:{WORD}|(?<=\p{{L}})\.(?=\p{{L}}))+")
RIGHT = regex.compile(rf"[^\S\n]*[{regex.escape(OPENERS)}]*((?:{WORD}|(?<=\p{{L}})\.(?=\p{{L}}))+)")
LABEL = regex.compile(r"^[^\S\n]*(?:\[\d{1,2}:\d{2}(?::\d{2})?\][^\S\n]*)?(?:[\p{L}\p{M}\p{N}_.'-]{1,30}(?:[^\S\n][\p{L}\p{M}\p{N}_.'-]{1,20})?(?::|>)(?=\s|$)[^\S\n]*|(?<=\])(?=\s))")
MARKER = regex.compile(r"^[^\S\n]*(?:[-*•‣·+–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\))[^\S\n]+")
BLANK = regex.compile(r"\r?\n(?:[^\S\n]*\r?\n)+")
#: Lines of code or data whatever words they hold: keyed brackets, queries, definitions, imports, assignments, special tokens alone, rulers, addresses, prompts.
CODE = regex.compile(
    r"^[^\S\n]*(?:\{[^\S\n]*(?:\}|([\"']?)[\w$-]+\1\s*:.*\})[,;]?|\[\s*(?:-?\d[\d.eE+-]*(?:\s*,\s*-?\d[\d.eE+-]*)+|([\"'])[^\"']*\2(?:\s*,\s*([\"'])[^\"']*\3)*|\{.*\})\s*\][,;]?"
    r"|(?:MATCH|CREATE|MERGE)\s+\(\w*(?::.*|\)\s*(?:[-<,;].*|(?:SET|RETURN|WHERE|DELETE)\b.*)?)"
    r"|(?:MATCH|SELECT|CREATE|RETURN|INSERT|UPDATE|DELETE|MERGE|WITH)\s(?=.*(?:\(\w*:|->|<-|\w\s*(?:[<>!]?=|<>)\s*[\w'\"$(]|\w\(|\{\s*\w+\s*:|(?<![^\s(])\*|\bFROM\s|\bAS\s*\()).*"
    r"|(?:async\s+)?(?:def|fn|func|function)\s+\w+\s*[(<].*|class\s+[A-Z_]\w*\s*(?:\(.*\)|extends\s.*)?\s*[:{]"
    r"|from\s+[\w.]+\s+import\s+(?:\*|\(?\w+(?:\s+as\s+\w+)?(?:\s*,\s*\w+(?:\s+as\s+\w+)?)*\)?);?|import\s+(?:\w+(?:\.\w+)+(?:\.\*)?|[\w{}*, ]+\sfrom\s+[\"'][^\"']+[\"']);?"
    r"|(?:let|const|var)\s+[\w{}\[\], ]+\s*(?::\s*\w+\s*)?=.*|for\s+\w+(?:\s*,\s*\w+)*\s+in\s+[\w.]*[(\[.].*:|for\s+\w{1,2}\s+in\s+\w+:"
    r"|(?:if|elif|while|return|for|switch)\b(?=.*(?:\w\s*[=!<>]=\s*\S|\w\s[<>]\s\w|&&|\|\||\w\([^()]*\)\s*[:;{]|\w\[\w+\]|\w\s[-+*/]\s\w)).*[:;{]"
    r"|\S+\s=\s\S+|```.*|(?:[^<\s]*<\|\S+\|>\S*\s*)+|(?:https?://\S+\s*)+|>>>\s.*|\$\s+[\w./-]+(?:\s.*)?\s(?:--?\w|[|>&]).*)$"
)
#: Lines that look like code by their layout, unless they hold sentences.
LAYOUT = regex.compile(r"^[^\S\n]*(?:\{.*\}[,;]?|\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\][,;]?|.*(?:[=~*#_+-]{3,}\s*){2,}.*|.*<\|\S+\|>.*|\$\s.*|.*\{\s*|\}.*)$")
#: What a statement holds before its final semicolon: an assignment, or a call that the line begins with.
STATEMENT = regex.compile(r"^[^\S\n]*(?:(?:[\w.:<>*&\[\]]+\s+){0,3}[\w.\[\]>-]+\s*[-+*/%&|^]?=\s*\S.*|[a-z-]+:\s*[\w#.%(), -]*\d(?:px|em|rem|pt|%|v[hw])[\w#.%(), -]*|(?:return|await|new|throw)?\s*[\w.:>-]+\(.*\)\s*|(?:return|break|continue)(?:\s+-?[\d.]+)?\s*|\}.*);\s*$")
#: Three natural words or more (one stretch of an unspaced script) before a sentence mark.
PROSE = regex.compile(
    r"(?:(?<![\p{L}\p{N}_])[\p{L}\p{M}\p{N}’'\u00ad\u200b\u2060-]+,?[\s\u200b]+){2,}[\p{L}\p{M}’'\u00ad\u200b\u2060-]+[.!?…।؟]+[\"'”’»)\]]*(?=\s|$)|[\p{Han}\p{Hiragana}\p{Katakana}]{3,}[。！？]"
)
#: A cell of a table: empty, a number, a constant, or an identifier with digits.
CELL = regex.compile(r"^\s*(?:|[-+]?[\d.,]+(?:[eE][-+]?\d+)?%?|0x[0-9A-Fa-f]+|(?i:null|none|nan|true|false)|(?=\S*\d)[\w:./+-]+)\s*$")
QUOTES = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "‘": "’"}


QUOTING = regex.compile("[" + regex.escape("".join({*QUOTES, *QUOTES.values(), '"', "'"})) + "]")


GREEK = regex.compile(r"\p{Greek}")
TIGHT = regex.compile(rf"[{regex.escape(OPENERS)}]*\p{{L}}")
LOWER, UPPER = regex.compile(r"\p{Ll}+"), regex.compile(r"\p{Lu}+")
ASCII_LOWER, ASCII_UPPER = string.ascii_lowercase.encode(), string.ascii_uppercase.encode()
MARKS = regex.compile(r"[{}\[\]<>=|\\~^$#@_*/]")
LINES = regex.compile(r"(?<=\n)")
BREAK = regex.compile(r"\r?\n")


@dataclass
class Gap:
    """A place where a sentence may end: after `end`, with its n-gram features."""

    end: int
    left: str
    right: str
    kind: str
    shape: str
    seed: float
    words: int = 0


def tabular(line: str) -> bool:
    """Whether a line is a row of three cells or more, at least half of them values; tabs between words are layout."""
    cells = line.strip(" ").split("\t")
    return len(cells) > 2 and any(c.strip() for c in cells) and 2 * sum(bool(CELL.match(c)) for c in cells) >= len(cells)


def code_like(line: str) -> bool:
    """Whether a line is code or data rather than prose: by evidence of the whole line, never by its last mark or first word."""
    if CODE.match(line) or ("\t" in line and tabular(line)):
        return True
    marks = len(MARKS.findall(line))
    if not (LAYOUT.match(line) or (line.rstrip().endswith(";") and STATEMENT.match(line)) or (marks >= 6 and marks > 0.12 * len(line))):
        return False
    return not PROSE.search(line)


def paragraphs(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the stretches that no sentence crosses; `whole` ones are one unit."""
    out: list[tuple[int, int, bool]] = []
    at = 0
    for gap in [*BLANK.finditer(text), None]:
        stop = gap.start() if gap else len(text)
        start, line_at = at, at
        for line in LINES.split(text[at:stop]):
            here = line_at
            line_at += len(line)
            bare = line.rstrip("\r\n")
            if not bare.strip():
                continue
            if code_like(bare):
                out += [(start, here, False), (here, here + len(bare), True)]
                start = line_at
            elif here > start and (LABEL.match(bare) or MARKER.match(bare)):
                out.append((start, here, False))
                start = here
        out.append((start, stop, False))
        at = gap.end() if gap else stop
    return [p for p in out if p[0] < p[1] and text[p[0] : p[1]].strip()]


def quoted(text: str, prefix: int = 0) -> list[tuple[int, int, bool]]:
    """(start, end, first) of quotations and brackets; `first` if one opens a sentence."""
    spans, stack, straight = [], [], {}

    def opens(i: int) -> bool:
        """Whether position i begins a sentence: after the label, or after a sentence mark with or without a closer."""
        earlier = text[max(prefix, i - 12) : i].rstrip()
        if not earlier:
            return not text[prefix:i].strip()
        return earlier[-1] in ".!?…。！？।؟>" or (earlier[-1] in CLOSERS and earlier[-2:-1] in tuple(".!?…。！？।؟"))

    for m in QUOTING.finditer(text):
        i, c = m.start(), m[0]
        if c == '"' or (c == "'" and (i == 0 or not text[i - 1].isalnum() or c in straight) and not (i and i + 1 < len(text) and text[i - 1].isalnum() and text[i + 1].isalnum())):
            if c in straight:
                j = straight.pop(c)
                if i - j > 1:
                    spans.append((j, i + 1, opens(j)))
            elif i + 1 < len(text) and not text[i + 1].isspace():
                straight[c] = i
        elif stack and c == QUOTES[stack[-1][0]]:
            j = stack.pop()[1]
            spans.append((j, i + 1, opens(j)))
        elif c in QUOTES:
            if c == "‘" and i and text[i - 1].isalnum():
                continue
            stack.append((c, i))
    return spans


def _prefix(text: str) -> int:
    """Length of the speaker label or list marker that a paragraph begins with."""
    at = 0
    for pattern in (LABEL, MARKER):
        m = pattern.match(text[at:])
        if m:
            at += m.end()
    return at


def _left(text: str):
    return LEFT.match(text)


def gaps(text: str, cased: bool) -> list[Gap]:
    """Candidate gaps of one paragraph in order."""
    prefix = _prefix(text)
    spans = sorted(quoted(text, prefix))
    out: list[Gap] = []
    plain = text.isascii()
    marks = list((PLAIN_END if plain else END).finditer(text, prefix))
    greek = not plain and bool(GREEK.search(text))
    for m in marks:
        mark = m["mark"] or ""
        if ";" in mark and not greek:
            continue
        if set(mark) == {";"} and greek and m.start() and not GREEK.match(text[m.start() - 1]):
            continue
        end = m.end()
        inside = any(a < m.start() and end < b for a, b, _ in spans) if spans else False
        if inside:
            continue
        closed = next(((a, first) for a, b, first in spans if a < m.start() < b <= end + 1), None)
        spaced = end >= len(text) or text[end].isspace()
        after = text[end : end + 80].lstrip("\r\n") if text[end : end + 80].strip() else text[end:]
        raw = text[end : end + 4]
        wide = not plain and (bool(mark and mark[0] in "。！？｡") or bool(WIDE.match(raw[:1])))
        if not after.strip():
            continue
        if not spaced and not wide:
            if m["only"] or not TIGHT.match(after):
                continue
            left_word = _left(text[max(0, m.start() - 40) : m.start()])
            if not left_word or len(left_word[0]) < 3 or "." in left_word[0] or after[0] in CLOSERS:
                continue
        here = text[max(0, m.start() - 40) : m.start()]
        left = _left(here if mark else here.rstrip())
        a = left[0].lower() if left else ""
        r = RIGHT.match(after)
        b = r[1] if r else after.strip()[:1]
        if not plain:
            a = a[-2:] if WIDE.search(a) else a
            b = b[:2] if WIDE.match(b) else b
        b = "#" if b[:1].isdigit() else b
        if a.isdigit():
            earlier = _left(here[: left.start()].rstrip(" .\xa0"))
            a = f"{earlier[0].lower() if earlier else ''} #"
        shape = "digit" if b == "#" else "lower" if b[:1].islower() else "upper" if b[:1].isupper() else "other"
        if not cased and shape in ("lower", "upper"):
            shape = "any"
        if not spaced:
            shape += "-tight"
        kind = ("emoji" if not mark or m["emoji"] else "dots" if mark[0] == "…" or mark.startswith("..") else mark[0])
        if closed:
            kind += ("(" if text[closed[0]] in "([（" else "q") + ("1" if closed[1] else "0")
        out.append(Gap(end, a, b.lower(), kind, shape, _seed(a, b, kind, shape, after)))
    if not plain and UNSPACED.search(text):
        for m in SPACE_SCRIPT.finditer(text, prefix):
            left, right = text[max(0, m.start() - 12) : m.start()], text[m.end() : m.end() + 4]
            if not (UNSPACED.search(left[-3:]) or UNSPACED.match(right)) or any(a < m.start() < b for a, b, _ in spans):
                continue
            a = left[-4:] if UNSPACED.match(left[-1:]) else ("#" if left[-1:].isdigit() else "latin")
            b = right if UNSPACED.match(right) else ("#" if right[:1].isdigit() else "latin")
            out.append(Gap(m.start(), a, b, "space", "other", 0.9 if left.endswith(SEED_FINALS) and UNSPACED.match(right) else 0.05))
        for m in BREAK.finditer(text):
            left, right = text[max(prefix, m.start() - 12) : m.start()], text[m.end() : m.end() + 4]
            if UNSPACED.match(left[-1:]) and right:
                b = right if UNSPACED.match(right) else ("#" if right[:1].isdigit() else "latin")
                out.append(Gap(m.start(), left[-4:], b, "space", "other", 0.9 if left.endswith(SEED_FINALS) and UNSPACED.match(right) else 0.05))
        out.sort(key=lambda g: g.end)
    last = prefix
    for g in out:
        g.words = len(text[last : g.end].split()) if plain or not WIDE.search(text[last : g.end]) else (g.end - last + 1) // 2
        last = g.end
    return out


def _seed(a: str, b: str, kind: str, shape: str, after: str) -> float:
    """The chance of a boundary by plain rules, for the first counts."""
    if kind.endswith("1") and kind[-2] == "q":
        return 0.15 if not shape.startswith("lower") else 0.03
    if WIDE.match(b):
        return 0.02 if after[:1] in "とって" else 0.2 if kind.startswith("dots") else 0.95
    if shape.startswith("lower"):
        return 0.03 if kind[0] != "।" else 0.9
    if kind.startswith("emoji"):
        return 0.9
    if kind[0] == "." and (a in SEED_ABBREVIATIONS or (len(a) == 1 and a.isalpha())):
        return (0.7 if shape == "upper" else 0.4) if a in SEED_ENDERS and len(a) > 1 else 0.05
    if kind[0] == "." and a.endswith(" #"):
        return 0.03 if b.lower() in SEED_AFTER_ORDINAL else 0.7
    if kind.startswith("dots"):
        return 0.4 if shape == "any" else 0.6
    return 0.75 if shape.startswith("any") else 0.93


def _bucket(*parts: str) -> tuple[int, int]:
    """The n-gram's place in each of the two halves of the table; the one with the smaller count is the less collided."""
    digest = xxhash.xxh64_intdigest("\x1f".join(parts))
    return digest % BUCKETS, BUCKETS + (digest >> 32) % BUCKETS


def _features(g: Gap) -> tuple[int, ...]:
    """Places of: kind, left word with kind, right word, left word with the right one's shape, both words, shape with kind."""
    mark = g.kind[0]
    return (
        *_bucket("k", g.kind),
        *_bucket("l", g.left, mark),
        *_bucket("r", g.right, g.shape[-5:], "." if mark == "." else "!"),
        *_bucket("ls", g.left, mark, g.shape),
        *_bucket("p", g.left, g.right, g.kind, g.shape[-5:]),
        *_bucket("s", g.kind, g.shape),
    )


#: Columns of a gap's numbers: paragraph, end of the text before it, start of the text after it, its link class, whether
#: its right word and shape are counted, seed chance, twelve places.
PARAGRAPH, BEFORE, AFTER, LINK, OWN, SEED, PLACES = 0, 1, 2, 3, 4, 5, 6
#: Link classes: how many words lie between a gap and the one before; the last one is a gap without any mark.
ONE_WORD, MORE_WORDS, UNMARKED = range(3)
WIDTH = PLACES + 12
KIND, LEFT_WORD, RIGHT_WORD, LEFT_SHAPE, PAIR, SHAPE = range(0, 12, 2)
TOTAL = _bucket("t")
#: Places of pairs of neighbouring events by link class: none none, none boundary, boundary none, boundary boundary.
LINKS = np.array([[_bucket("link", str(c), str(k))[0] for k in range(4)] for c in range(3)])
WORD_TOTAL = 2 * BUCKETS
TABLE = 2 * BUCKETS + WORD_BUCKETS

#: Words of the unmarked model; characters of scripts without spaces are words of their own.
TOKENS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*|[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*")
PLAIN_TOKENS = re.compile(r"[a-z0-9]+(?:'[a-z]+)*")
PARAGRAPH_END, FIRST_GAP = -1, -2


class _Codes(dict):
    """31-bit codes of words; all numbers are one."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh64_intdigest("#" if word[0].isdigit() else word) & 0x7FFFFFFF
        return code


CODES = _Codes()


def word_codes(text: str) -> list[int]:
    text = text.lower()
    if len(CODES) > 300_000:
        CODES.clear()
    return list(map(CODES.__getitem__, PLAIN_TOKENS.findall(text) if text.isascii() else TOKENS.findall(text)))


def _word_place(kind: int, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    h = (np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(b, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(kind * 0x51ED27)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (2 * BUCKETS + 1 + ((h ^ (h >> np.uint64(33))) % np.uint64(WORD_BUCKETS - 1))).astype(np.int64)


def unmarked_gaps(part: str) -> list[tuple[int, int, list[int]]]:
    """(end of the left word, start of the right one, places of left word, right word, both) in a paragraph without marks."""
    at = _prefix(part)
    found = list(TOKENS.finditer(part, at))
    if len(found) < LEAST_WORDS or (len(found) < LEAST_CHARACTERS and any(WIDE.match(m[0]) or UNSPACED.match(m[0]) for m in found)):
        return []
    codes = np.array(word_codes(part[at:]), dtype=np.int64)
    if len(codes) != len(found):
        codes = np.array([CODES[m[0].lower()] for m in found], dtype=np.int64)
    places = np.column_stack([_word_place(1, codes[:-1]), _word_place(2, codes[1:]), _word_place(3, codes[:-1], codes[1:])])
    # No boundary inside a word's punctuation, nor between letters of a script whose words aren't marked.
    keep = [i for i, (a, b) in enumerate(zip(found, found[1:])) if (part[a.end() : b.start()].strip(" \r\n\t") == "") and not (UNSPACED.match(a[0]) and a.end() == b.start())]
    return [(found[i].end(), found[i + 1].start(), places[i].tolist()) for i in keep]


def _cased(text: str) -> bool:
    """Whether letter case tells anything in this text."""
    bare = text[_prefix(text) :]
    if bare.isascii():
        raw = bare.encode()
        low, up = (len(raw) - len(raw.translate(None, letters)) for letters in (ASCII_LOWER, ASCII_UPPER))
    else:
        low, up = len(bare) - len(LOWER.sub("", bare)), len(bare) - len(UPPER.sub("", bare))
    return low > 0 and 0.005 * low < up < low


def _hidden(c: str) -> bool:
    return c.isspace() or c in "\u200b\u200c\u2060\ufeff\xad\x00"


def numbers_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of each paragraph's visible text, the gaps' numbers, the words with their gaps) of a text.

    Words are a stream of codes in which PARAGRAPH_END and FIRST_GAP - number of the gap stand between words.
    """
    spans: list[tuple[int, int]] = []
    found: list[tuple[int, ...]] = []
    stream: list[int] = []
    for start, end, whole in paragraphs(text or ""):
        part = text[start:end]
        first, last = 0, len(part)
        while first < last and _hidden(part[first]):
            first += 1
        while last > first and _hidden(part[last - 1]):
            last -= 1
        if first == last:
            continue
        reached, read = start + first, first
        marked = [] if whole else gaps(part, _cased(part) if len(part) > 40 else _cased(text))
        words = 0
        for g in marked:
            before, after = g.end, g.end
            while before and _hidden(part[before - 1]):
                before -= 1
            while after < last and _hidden(part[after]):
                after += 1
            words += g.words
            if after >= last or start + before <= reached:
                continue
            reached = start + after
            link = ONE_WORD if words <= 1 else MORE_WORDS
            words = 0
            # A number after an abbreviation is explained by it; the odds of numbers are learnt elsewhere.
            own = not (g.shape.startswith("digit") and (g.left in SEED_ABBREVIATIONS or len(g.left) == 1))
            stream += word_codes(part[read:before])
            stream.append(FIRST_GAP - len(found))
            read = before
            found.append((len(spans), start + before, start + after, link, own, round(g.seed * 1000), *_features(g)))
        if not whole:
            if not marked and not END.search(part):
                for before, after, places in unmarked_gaps(part):
                    stream += word_codes(part[read:before])
                    stream.append(FIRST_GAP - len(found))
                    read = before
                    found.append((len(spans), start + before, start + after, UNMARKED, 0, 0, *places, *[0] * 9))
            stream += word_codes(part[read:last])
            stream.append(PARAGRAPH_END)
        spans.append((start + first, start + last))
    return np.array(spans, dtype=np.int32).reshape(-1, 2), np.array(found, dtype=np.int32).reshape(-1, WIDTH), np.array(stream, dtype=np.int32)


def word_pairs(stream: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left word, right word, chance of a boundary between) of a stream; words at the ends of paragraphs pair with -1."""
    is_word = stream >= 0
    at = np.flatnonzero(is_word)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    # The strongest event between two words is the one that counts.
    event = np.zeros(len(stream))
    event[stream == PARAGRAPH_END] = 2.0
    gap = stream <= FIRST_GAP
    event[gap] = chances[FIRST_GAP - stream[gap]]
    between = np.maximum.reduceat(np.append(event, 0.0), at)
    left = stream[at].astype(np.int64)
    right = np.append(left[1:], -1)
    ends = between >= 2.0
    ends[-1] = True
    return left, np.where(ends, -1 - right, right), np.where(ends, 1.0, between)


class EventModel:
    """Event chances of gaps from bucketed counts (columns: boundary, none)."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        yes, no = counts[TOTAL[0]] + 1.0
        self.base = math.log(yes / no)
        self.links = self._links()

    def _links(self) -> np.ndarray:
        """How much likelier than by chance each pair of neighbouring events is, by link class; 1 where nothing was seen."""
        seen = self.counts[LINKS, 0].astype(np.float64).reshape(3, 2, 2)
        smooth = seen + 5 * seen.sum(axis=2, keepdims=True) * seen.sum(axis=1, keepdims=True) / np.maximum(seen.sum(axis=(1, 2), keepdims=True), 1e-9) ** 2
        total = smooth.sum(axis=(1, 2), keepdims=True)
        expected = smooth.sum(axis=2, keepdims=True) * smooth.sum(axis=1, keepdims=True) / np.maximum(total, 1e-9)
        link = np.where(expected > 0, smooth / np.maximum(expected, 1e-9), 1.0)
        # Farther apart, what two marks have in common comes from the kind of text and not from each other.
        link[MORE_WORDS] = 1.0
        return link

    def _odds(self, places: np.ndarray, prior: np.ndarray | float, weight: float) -> np.ndarray:
        """log P(boundary)/P(none) of features with `weight` pseudo counts at the prior log odds."""
        one, two = self.counts[places[:, 0]], self.counts[places[:, 1]]
        seen = np.where((two.sum(1) < one.sum(1))[:, None], two, one).astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(prior, -20, 20)))
        return np.log((seen[:, 0] + weight * p + 1e-6) / (seen[:, 1] + weight * (1 - p) + 1e-6))

    def log_odds(self, gap_numbers: np.ndarray) -> np.ndarray:
        at = lambda f: gap_numbers[:, PLACES + f : PLACES + f + 2]
        by_kind = self._odds(at(KIND), self.base, 2)
        # P(event | left word) backs off to the kind of mark; the right word's ratio backs off to its shape.
        by_left = self._odds(at(LEFT_WORD), by_kind, 4)
        by_shape = self._odds(at(SHAPE), by_kind, 2) - by_kind
        by_right = self._odds(at(RIGHT_WORD), self.base + by_shape, 4) - self.base
        joint = by_left + np.clip(by_right, -1.5, 6.0)
        # The left word before such a shape, then before this very word, where they were seen often enough.
        return self._odds(at(PAIR), self._odds(at(LEFT_SHAPE), joint, 8), 6)

    def unmarked_log_odds(self, places: np.ndarray) -> np.ndarray:
        """log odds of boundary tokens between words alone; places: left word, right word, both."""
        total = self.counts[WORD_TOTAL].astype(np.float64) + 1.0
        base = math.log(total[0] / total[1])
        seen = self.counts[places].astype(np.float64)
        share = total / total.sum()
        by = lambda i, weight: np.log((seen[:, i, 0] + weight * share[0]) / (seen[:, i, 1] + weight * share[1]))
        # P(right | left) inside a sentence against P(right): a pair never seen after a frequent word speaks for a boundary.
        left, right, both = seen[:, 0, 1], seen[:, 1, 1], seen[:, 2, 1]
        right_share = (right + 1) / (total[1] + 1)
        inside = (np.maximum(both - 0.5, 0) + 2 * right_share) / (left + 2) / right_share
        return by(0, 4) + (by(1, 4) - base) - np.log(np.clip(inside, 1e-3, 1e3))

    def chances(self, gap_numbers: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Posterior chance of a boundary at each gap; `runs` numbers the paragraph of each gap, in order."""
        plain = gap_numbers[:, LINK] == UNMARKED
        odds = np.empty(len(gap_numbers))
        odds[~plain] = self.log_odds(gap_numbers[~plain])
        odds[plain] = self.unmarked_log_odds(gap_numbers[plain, PLACES : PLACES + 3])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return forward_backward(p, runs, self.links[gap_numbers[:, LINK]])


def forward_backward(emit: np.ndarray, runs: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Posteriors of chains of two-state events: emit is each gap's own chance, link[i] (2 x 2) weighs the states of gaps
    i - 1 and i of one run. All runs go forward together, longest first."""
    if not len(emit):
        return emit
    starts = np.flatnonzero(np.append(True, np.diff(runs) != 0))
    lengths = np.diff(np.append(starts, len(runs)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    own = np.column_stack([1 - emit, emit])
    forward, back = own.copy(), np.ones((len(emit), 2))
    steps = range(1, int(lengths[0]))
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]) + 1)]
    for t in steps:
        i = starts[: active[t]] + t
        f = own[i] * np.einsum("ns,nst->nt", forward[i - 1], link[i])
        forward[i] = f / np.maximum(f.sum(1, keepdims=True), 1e-300)
    for t in reversed(steps):
        i = starts[: active[t]] + t
        b = np.einsum("nst,nt->ns", link[i], own[i] * back[i])
        back[i - 1] = b / np.maximum(b.sum(1, keepdims=True), 1e-300)
    both = forward * back
    return both[:, 1] / np.maximum(both.sum(1), 1e-300)


def _gathered(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(paragraphs, their document's row, gaps, their document's row, their run) of a batch."""
    spans = [np.frombuffer(b, dtype=np.int32).reshape(-1, 2) for b in frame["spans"]]
    gaps_of = [np.frombuffer(b, dtype=np.int32).reshape(-1, WIDTH) for b in frame["gaps"]]
    all_spans = np.concatenate([np.empty((0, 2), np.int32), *spans])
    all_gaps = np.concatenate([np.empty((0, WIDTH), np.int32), *gaps_of])
    span_rows = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
    gap_rows = np.repeat(np.arange(len(gaps_of)), [len(x) for x in gaps_of])
    firsts = np.concatenate([[0], np.cumsum([len(x) for x in spans])])[:-1]
    runs = firsts[gap_rows] + all_gaps[:, PARAGRAPH] if len(all_gaps) else np.empty(0, np.int64)
    return all_spans, span_rows, all_gaps, gap_rows, runs


def _streams(frame: pd.DataFrame) -> np.ndarray:
    """The word streams of a batch as one, gaps numbered through."""
    out, before = [np.empty(0, np.int64)], 0
    for words, numbers in zip(frame["words"], frame["gaps"]):
        stream = np.frombuffer(words, dtype=np.int32).astype(np.int64)
        stream[stream <= FIRST_GAP] -= before
        out.append(stream)
        before += len(numbers) // (4 * WIDTH)
    return np.concatenate(out)


def add_counts(table: np.ndarray, gap_numbers: np.ndarray, chances: np.ndarray, runs: np.ndarray, stream: np.ndarray) -> None:
    """Add what gaps with these chances of a boundary, and the words around them, give to a count table."""
    marked = gap_numbers[:, LINK] != UNMARKED
    places, p = gap_numbers[marked, PLACES:], chances[marked]
    use = np.ones(places.shape)
    for f in (RIGHT_WORD, SHAPE):
        use[:, f : f + 2] = gap_numbers[marked, OWN, None]
    left, right, event = word_pairs(stream, chances)
    inner = right >= 0
    word_places = [_word_place(1, left), _word_place(2, np.where(right >= 0, right, np.maximum(-1 - right, 0))), _word_place(3, left[inner], right[inner])]
    word_chances = [event, event, event[inner]]
    for column in (0, 1):
        side = lambda x: x if column == 0 else 1 - x  # noqa: B023, E731
        table[: 2 * BUCKETS, column] += np.bincount(places.ravel(), (use * side(p)[:, None]).ravel(), 2 * BUCKETS)
        table[list(TOTAL), column] += side(p).sum()
        for where, of in zip(word_places, word_chances):
            table[:, column] += np.bincount(where, side(of), TABLE)
        table[WORD_TOTAL, column] += side(event).sum()
    # Pairs of neighbouring events: of marks by the words between them, and of all neighbouring words.
    near = np.flatnonzero(np.diff(runs) == 0) + 1 if len(runs) else np.empty(0, np.int64)
    for c in range(UNMARKED):
        i = near[gap_numbers[near, LINK] == c]
        _add_pairs(table, c, chances[i - 1], chances[i])
    _add_pairs(table, UNMARKED, event[:-1], event[1:])


def _add_pairs(table: np.ndarray, link: int, a: np.ndarray, b: np.ndarray) -> None:
    for k, (x, y) in enumerate(((1 - a, 1 - b), (1 - a, b), (a, 1 - b), (a, b))):
        table[LINKS[link, k], 0] += (x * y).sum()


BLOCK_BITS = 14


def _to_blocks(table: np.ndarray, salt: int) -> pd.DataFrame:
    """The table's used places as (block, salt, data): data holds offset, boundary, none of each, as float32."""
    used = np.flatnonzero(table.any(axis=1))
    blocks = used >> BLOCK_BITS
    data = np.column_stack([used & ((1 << BLOCK_BITS) - 1), table[used]]).astype(np.float32)
    cuts = np.flatnonzero(np.diff(blocks)) + 1
    parts = np.split(data, cuts) if len(used) else []
    return pd.DataFrame({"block": blocks[np.concatenate([[0], cuts])] if len(used) else [], "salt": [salt] * len(parts), "data": [x.tobytes() for x in parts]}).astype({"block": "int32", "salt": "int32"})


def _add_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of one block's parts: 16,384 places at most."""
    total = np.zeros((1 << BLOCK_BITS, 2))
    for data in rows["data"]:
        part = np.frombuffer(data, dtype=np.float32).reshape(-1, 3)
        np.add.at(total, part[:, 0].astype(np.int64), part[:, 1:])
    used = np.flatnonzero(total.any(axis=1))
    data = np.column_stack([used, total[used]]).astype(np.float32)
    return pd.DataFrame({"block": [key[0]], "salt": [0], "data": [data.tobytes()]}).astype({"block": "int32", "salt": "int32"})


def gap_table(documents: DataFrame) -> DataFrame:
    """doc_id, spans, gaps, words: the paragraphs, candidate gaps and words of each text as packed numbers; texts are read once."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            numbers = [numbers_of(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], **{name: [n[i].tobytes() for n in numbers] for i, name in enumerate(("spans", "gaps", "words"))}})

    usable = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return spread(usable, "doc_id").mapInPandas(read, "doc_id bigint, spans binary, gaps binary, words binary")


def fit_events(gap_rows: DataFrame, rounds: int = ROUNDS) -> EventModel:
    """The model from counts over all rows of gap_table; what reaches the driver is bounded by the table (16 MB)."""
    spark = gap_rows.sparkSession
    model: EventModel | None = None
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(model.counts if model else None)

        def count(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = EventModel(shared.value) if shared.value is not None else None
            table, some = np.zeros((TABLE, 2)), 0
            for frame in frames:
                _, _, numbers, _, runs = _gathered(frame)
                add_counts(table, numbers, known.chances(numbers, runs) if known else numbers[:, SEED] / 1000, runs, _streams(frame))
                some += len(numbers)
            yield _to_blocks(table, some % 32)

        schema = "block int, salt int, data binary"
        sums = gap_rows.select("spans", "gaps", "words").mapInPandas(count, schema)
        sums = sums.groupBy("block", "salt").applyInPandas(_add_blocks, schema).groupBy("block").applyInPandas(_add_blocks, schema)
        counts = np.zeros((TABLE, 2), dtype=np.float32)
        for block, _, data in sums.collect():
            part = np.frombuffer(data, dtype=np.float32).reshape(-1, 3)
            counts[(block << BLOCK_BITS) + part[:, 0].astype(np.int64)] = part[:, 1:]
        model = EventModel(counts)
    return model


def units_of(frame: pd.DataFrame, model: EventModel) -> pd.DataFrame:
    """doc_id, start_char, end_char of a batch: each paragraph, cut at the gaps that are boundaries."""
    spans, span_rows, numbers, gap_rows, runs = _gathered(frame)
    cuts = model.chances(numbers, runs) >= THRESHOLD if len(numbers) else np.empty(0, bool)
    rows = np.concatenate([span_rows, gap_rows[cuts]])
    starts, ends = np.concatenate([spans[:, 0], numbers[cuts, AFTER]]), np.concatenate([spans[:, 1], numbers[cuts, BEFORE]])
    # Units of a document don't overlap, so its starts and ends pair up in order.
    by_start, by_end = np.lexsort((starts, rows)), np.lexsort((ends, rows))
    ids = frame["doc_id"].to_numpy()
    return pd.DataFrame({"doc_id": ids[rows[by_start]], "start_char": starts[by_start].astype(np.int64), "end_char": ends[by_end].astype(np.int64)})


def sentences_of(text: str | None, model: EventModel) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of one text in code points; none for null and blank texts."""
    spans, numbers, _ = numbers_of(text)
    units = units_of(pd.DataFrame({"doc_id": [0], "spans": [spans.tobytes()], "gaps": [numbers.tobytes()]}), model)
    return list(zip(units["start_char"].tolist(), units["end_char"].tolist()))


def sentence_units(documents: DataFrame) -> DataFrame:
    """doc_id, start_char, end_char: one row for each sentence of each document, 0-based code points, end exclusive.

    Null, empty and blank texts give none. Extra columns are ignored. The model is fitted on the same documents; an empty
    table gives no rows.
    """
    read = cut(gap_table(documents))
    shared = documents.sparkSession.sparkContext.broadcast(fit_events(read).counts)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = EventModel(shared.value)
        for frame in frames:
            yield units_of(frame, model)

    return read.select("doc_id", "spans", "gaps").mapInPandas(split, "doc_id bigint, start_char bigint, end_char bigint")
