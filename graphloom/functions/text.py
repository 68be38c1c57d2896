"""Text, hash, id and time helpers of the memory pipeline, all inside whole-stage code except Unicode folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _folded(surface: pd.Series) -> pd.Series:
    return surface.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


def canonical_surface(surface: Column) -> Column:
    """NFKC, case folding, trimmed, runs of white space as one blank. The one Python step; Spark has no NFKC."""
    return F.trim(F.regexp_replace(_folded(surface), r"[\s ]+", " "))


def plain_surface(surface: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank, for text that needs no Unicode folding."""
    return F.lower(F.trim(F.regexp_replace(surface, r"\s+", " ")))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def chunk_id(context: Column, record: Column) -> Column:
    """Stable id of a record's chunk: the two keys joined by a null character."""
    return F.concat(F.lit("chunk:"), F.sha2(F.concat(context, F.lit("\x00"), record), 256))


def path_uuid(path: Column) -> Column:
    """Deterministic id in the layout of a UUID from a semantic path."""
    h = F.sha2(path, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def entity_terms(text: Column) -> Column:
    """Distinct lower-case ASCII words of more than two characters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def source_span(text: Column, quote: Column) -> Column:
    """struct(start, end) of a quote in its text, 0-based; the whole text where the quote is missing or not in it."""
    at = F.instr(text, F.coalesce(quote, F.lit("")))
    found = (at > 0) & (F.length(quote) > 0)
    return F.when(found, F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end"))).otherwise(
        F.struct(F.lit(0).alias("start"), F.length(text).alias("end"))
    )


def parse_time(text: Column) -> Column:
    """Timestamp of RFC 3339 text with an offset, or of `yyyy/MM/dd (EEE) HH:mm`; null for anything else."""
    bench = F.try_to_timestamp(F.regexp_replace(text, r"\s*\([A-Za-z]+\)\s*", " "), F.lit("yyyy/MM/dd HH:mm"))
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    return F.coalesce(zoned, bench)


def dot(a: Column, b: Column) -> Column:
    """Sum of the products of two number arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The array divided by its norm; for vectors that are compared many times."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(a, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; null where a length or norm doesn't allow it."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def semantic_score(cos: Column) -> Column:
    """1 / (1 + distance) of a cosine distance."""
    return 1 / (2 - cos)


def keyword_score(rank: Column) -> Column:
    return rank / (1 + rank)


def deterministic_embedding(text: Column) -> Column:
    """Eight numbers in [0, 1] from the first bytes of the text's SHA-256."""
    h = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)
