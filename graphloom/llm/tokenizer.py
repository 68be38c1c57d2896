"""Encoding texts with a public byte-pair vocabulary by a lazily determinised finite-state transducer.

A token sequence is the encoding of a word exactly if each neighbouring pair is one the merges leave alone, so the last
token of every prefix is unique and a word can be encoded from left to right. A transducer state holds the bytes that may
still begin a token (a node of the prefix tree) and, for each position where that token could begin, the tokens not yet
settled before it. Reading a byte gives the next state and the tokens on which all positions agree. States and
transitions are built when they are first needed; a token is settled after a lookahead of at most the longest token.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import spread

DEFAULT_FOLDER = "/opt/tokenizers"
#: Fixed value: how the vocabulary's texts are cut into words before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_STATES = 400_000
MOST_WORDS = 200_000
LONGEST_CACHED_WORD = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id from a rank file of lines "base64 id"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Byte-pair encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._read_merges()
        self._build_tree()
        self._fits: dict[tuple[int, int], bool] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; the start state has nothing read and nothing pending."""
        self._paths: list[tuple[tuple[int, tuple[int, ...]], ...]] = [((0, ()),)]
        self._nodes: list[int] = [0]
        self._ids: dict[tuple, int] = {(0, ((0, ()),)): 0}
        self._next: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]

    def _read_merges(self) -> None:
        """The two tokens each token was merged from: what is left of its bytes when only earlier tokens are used."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) < 2:
                continue
            parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
            while len(parts) > 2:
                options = [(self.merged.get(p, rank), i) for i, p in enumerate(zip(parts, parts[1:]))]
                best, at = min(options)
                if best >= rank:
                    raise ValueError(f"token {rank} can't be built from earlier ones")
                parts[at : at + 2] = [best]
            self.halves[rank] = (parts[0], parts[1])
            self.merged[parts[0], parts[1]] = rank

    def _build_tree(self) -> None:
        """A prefix tree of all tokens with, for each node, its longest proper suffix that is a node as well."""
        self.child: list[dict[int, int]] = [{}]
        self.depth = [0]
        self.token_at: list[int] = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                following = self.child[node].get(byte)
                if following is None:
                    following = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token_at.append(-1)
                node = following
            self.token_at[node] = rank
        self.suffix = [0] * len(self.child)
        queue = list(self.child[0].values())
        for node in queue:
            for byte, following in self.child[node].items():
                back = self.suffix[node]
                while back and byte not in self.child[back]:
                    back = self.suffix[back]
                self.suffix[following] = self.child[back].get(byte, 0)
                queue.append(following)

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two neighbouring tokens."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._border_holds(left, right)
            if len(self._fits) > 4 * MOST_STATES:
                self._fits.clear()
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Pieces that touch the border, each with the merge that ends it (the whole token is never ended).
        never = len(self.ranks) + 1
        lefts, end = [], never
        while True:
            lefts.append((left, end))
            if left not in self.halves:
                break
            end, left = left, self.halves[left][1]
        rights, end = [], never
        while True:
            rights.append((right, end))
            if right not in self.halves:
                break
            end, right = right, self.halves[right][0]
        # A crossing merge happens if both pieces are still there; of equal merges the leftmost is done first.
        return not any((c := self.merged.get((a, b))) is not None and c < a_end and c <= b_end for a, a_end in lefts for b, b_end in rights)

    def step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        """(settled tokens, next state) after one more byte."""
        known = self._next[state].get(byte)
        if known is None:
            known = self._next[state][byte] = self._determinise(state, byte)
        return known

    def _determinise(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        node = self._nodes[state]
        pending = dict(self._paths[state])  # bytes back from the end -> unsettled tokens before that position
        while node and byte not in self.child[node]:
            node = self.suffix[node]
        node = self.child[node].get(byte, 0)
        # The last token of the longer prefix: the longest-to-shortest suffix that is a token and fits what precedes it.
        at, path = node, None
        while at:
            token = self.token_at[at]
            if token >= 0:
                before = pending.get(self.depth[at] - 1)
                if before is not None and (not before or self.fits(before[-1], token)):
                    path = (*before, token)
                    break
            at = self.suffix[at]
        if path is None:
            raise ValueError("the vocabulary lacks a single byte")
        # A later token may begin here or where a suffix that still begins some token began.
        alive = {0: path}
        at = node
        while at:
            if self.child[at]:
                before = pending.get(self.depth[at] - 1)
                if before is not None:
                    alive[self.depth[at]] = before
            at = self.suffix[at]
        # Tokens on which all agree are settled; the last one stays, as the next must fit it.
        common = min(len(p) for p in alive.values())
        settled = 0
        while settled < common - 1 and len({p[settled] for p in alive.values()}) == 1:
            settled += 1
        paths = tuple(sorted((back, p[settled:]) for back, p in alive.items()))
        key = (node, paths)
        number = self._ids.get(key)
        if number is None:
            number = self._ids[key] = len(self._paths)
            self._paths.append(paths)
            self._nodes.append(node)
            self._next.append({})
        return path[:settled], number

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        known = self.words.get(word)
        if known is not None:
            return known
        if len(self._paths) > MOST_STATES:
            self.reset()
        out: list[int] = []
        state, following = 0, self._next
        for byte in word:
            known = following[state].get(byte)
            settled, state = known if known is not None else self.step(state, byte)
            out += settled
        ids = (*out, *dict(self._paths[state])[0])
        if len(word) <= LONGEST_CACHED_WORD:
            if len(self.words) >= MOST_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str | None, pattern: regex.Pattern) -> list[int]:
        """Ids of a text; null and empty texts give none. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if text:
            for word in pattern.findall(text):
                out += self.encode_word(word.encode("utf-8", "replace"))
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text as soon as their bytes are complete; the UTF-8 state carries over from token to token."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            piece = machine.decode(self.bytes_of[int(i)])
            if piece:
                yield piece
        rest = machine.decode(b"", True)
        if rest:
            yield rest


def shipped(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to the executors once for each application, and give its name for local_copy()."""
    sent = spark.sparkContext.__dict__.setdefault("_graphloom_files", set())
    if path not in sent:
        spark.sparkContext.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def local_copy(name: str) -> str:
    """The executor's own copy of a shipped file."""
    return SparkFiles.get(name)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One transducer for each vocabulary file and Python worker."""
    return Transducer(read_ranks(path))


def encode_texts(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None
) -> DataFrame:
    """id_column, ids (array<int>): one row for each input row, in whole texts; null and empty texts give an empty list.

    Narrow: no shuffle. Rows with a null or repeated id are kept as they are. Extra columns are left out.
    """
    name = shipped(documents.sparkSession, os.path.join(folder or DEFAULT_FOLDER, f"{vocabulary}.tiktoken"))
    schema = T.StructType([documents.schema[id_column], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, pattern = transducer(local_copy(name)), regex.compile(WORD_PATTERN)
        for frame in frames:
            yield pd.DataFrame({id_column: frame[id_column], "ids": [machine.encode(t, pattern) for t in frame[text]]})

    return spread(documents.select(id_column, text), id_column).mapInPandas(run, schema)


def decode_texts(encoded: DataFrame, id_column: str = "doc_id", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """id_column, text from encode_texts' rows; an empty or null list gives an empty text."""
    name = shipped(encoded.sparkSession, os.path.join(folder or DEFAULT_FOLDER, f"{vocabulary}.tiktoken"))
    schema = T.StructType([encoded.schema[id_column], T.StructField("text", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(local_copy(name))
        for frame in frames:
            yield pd.DataFrame({id_column: frame[id_column], "text": ["".join(machine.decode(ids if ids is not None else ())) for ids in frame["ids"]]})

    return encoded.select(id_column, "ids").mapInPandas(run, schema)


def round_trip(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """doc_id, n_ids, same: whether decoding a document's ids gives its text again."""
    both = encode_texts(documents, vocabulary=vocabulary, folder=folder)
    decoded = decode_texts(both, vocabulary=vocabulary, folder=folder)
    ids = both.select("doc_id", F.size("ids").alias("n_ids"))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    return decoded.join(ids, "doc_id").join(texts, "doc_id").select("doc_id", "n_ids", (F.col("text") == F.col("original")).alias("same"))
