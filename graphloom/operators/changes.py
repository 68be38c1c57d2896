"""Applying a feed of inserts, updates and deletes, newest first.

The feed is split into time batches. They are processed backwards: the newest change of each key inside a batch is a
partial aggregate, keys that a later batch resolved already are anti-joined away, and what remains is recorded as the
key's image or tombstone. Rows of the base table whose key was never touched are appended last. A key's whole history
therefore never meets in one task, and each batch shuffles only (key, newest change) rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

#: Fixed values of the data: the far end of time in epoch seconds, and the least epoch that is in milliseconds.
OPEN_END_SECONDS = 9999999999
MILLISECONDS_FROM = 100_000_000_000


#: Batches of a feed: about a billion rows each, four at least; each costs a pass over the keys resolved before it.
LEAST_BATCHES, MOST_BATCHES, BATCH_ROWS = 4, 64, 1_000_000_000


def canonical_key(key: Column) -> Column:
    """Lower-case ASCII letters and digits of a key; null where none is left."""
    kept = F.lower(F.regexp_replace(key, "[^A-Za-z0-9]", ""))
    return F.when(F.length(kept) > 0, kept)


def canonical_action(action: Column) -> Column:
    """The first word of an action in upper case; null and blank mean ADD."""
    word = F.upper(F.regexp_extract(F.coalesce(action, F.lit("")), "([A-Za-z]+)", 1))
    return F.when(word == "", "ADD").otherwise(word)


def epoch_seconds(value: Column) -> Column:
    """Epoch seconds of a bigint that is in seconds or, from 10^11 on, in milliseconds."""
    return F.when(value >= MILLISECONDS_FROM, F.floor(value / 1000)).otherwise(value).cast("bigint")


def draft_changes(drafts: DataFrame) -> DataFrame:
    """One change for each draft_id from its deliveries.

    Columns: subject_id, predicate_key, observed_at, turn_index, draft_id, action, object_value, valid_from, valid_to
    (the two in epoch seconds, null where missing). Deliveries of a draft agree up to spelling; where one lacks a value
    the others have, the value counts. Rows without draft_id are one change each; without subject, key or observed_at
    none. A null turn_index sorts before all others. Extra columns are ignored; empty input gives no rows.
    """
    rows = drafts.select(
        F.coalesce("draft_id", F.concat(F.lit("delivery-"), F.col("delivery_id").cast("string"))).alias("draft_id"),
        F.col("subject_id").cast("bigint").alias("subject_id"),
        canonical_key(F.col("predicate_key")).alias("predicate_key"),
        epoch_seconds(F.col("observed_at")).alias("observed_at"),
        F.coalesce(F.col("turn_index"), F.lit(-1)).alias("turn_index"),
        canonical_action(F.col("action")).alias("action"),
        F.col("action").isNotNull().alias("has_action"),
        "object_value",
        F.col("valid_from").cast("timestamp").cast("bigint").alias("valid_from"),
        F.col("valid_to").cast("timestamp").cast("bigint").alias("valid_to"),
    )
    one = rows.groupBy("draft_id").agg(
        F.max("subject_id").alias("subject_id"),
        F.max("predicate_key").alias("predicate_key"),
        F.max("observed_at").alias("observed_at"),
        F.max("turn_index").alias("turn_index"),
        F.max(F.struct("has_action", "action"))["action"].alias("action"),
        F.max("object_value").alias("object_value"),
        F.max("valid_from").alias("valid_from"),
        F.max("valid_to").alias("valid_to"),
    )
    return one.where("subject_id is not null and predicate_key is not null and observed_at is not null").select(
        "subject_id", "predicate_key", "observed_at", "turn_index", "draft_id", "action", "object_value", "valid_from", "valid_to"
    )


def batch_bounds(changes: DataFrame, order: str, batches: int) -> list:
    """Ascending inner bounds that split `order` into about equal batches; one partial aggregate, a bounded result."""
    if batches < 2:
        return []
    shares = [i / batches for i in range(1, batches)]
    got = changes.agg(F.percentile_approx(order, shares, 10_000).alias("b")).first()["b"]
    return sorted(set(got or []))


def apply_changes(
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    action: str = "action",
    values: Sequence[str] = (),
    base: DataFrame | None = None,
    delete: str = "DELETE",
    batches: int | None = None,
) -> DataFrame:
    """Current state after a change feed: keys + values of the newest change of each key, deleted keys left out.

    order: columns that order changes, most significant first (a unique last one makes ties defined: the greatest wins).
    base: earlier state with keys + values; its untouched rows are kept whole, repeats included. Repeated and
    out-of-order changes are fine. batches: by default as many as the rows need. Rows with a null key match each other (nulls are one key). Empty input gives base.
    """
    values = list(values)
    keys = list(keys)
    slim = changes.select(*keys, *[F.col(c) for c in order if c not in keys], *[v for v in values if v not in keys and v not in order], action)
    slim = cut(slim)
    batches = batches or min(MOST_BATCHES, max(LEAST_BATCHES, slim.count() // BATCH_ROWS))
    bounds = batch_bounds(slim, order[0], batches)
    number = F.lit(0)
    for i, low in enumerate(bounds, 1):
        number = F.when(F.col(order[0]) > F.lit(low), i).otherwise(number)
    # A folder for each batch, so that each step reads its own rows only; a missing time is in the oldest batch.
    laid_out = cut(slim.withColumn("_batch", number), partition_by=["_batch"]) if bounds else slim.withColumn("_batch", F.lit(0))
    resolved: list[DataFrame] = []
    newest = F.struct(*order, *[v for v in values if v not in order], action)
    for batch in reversed(range(len(bounds) + 1)):
        part = laid_out.where(F.col("_batch") == batch)
        images = part.groupBy(*keys).agg(F.max(newest).alias("_image"))
        if resolved:
            images = _anti(images, _union(resolved).select(*keys), keys)
        resolved.append(cut(images))
    images = _union(resolved)
    state = images.where(F.col("_image")[action] != delete).select(*keys, *[F.col("_image")[v].alias(v) for v in values])
    if base is not None:
        untouched = _anti(base.select(*keys, *values), images.select(*keys), keys)
        state = state.unionByName(untouched)
    return state


def _anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    return left.join(right, on, "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def current_drafts(drafts: DataFrame, batches: int | None = None) -> DataFrame:
    """subject_id, predicate_key, draft_id of every key that has a value after all changes of extracted_drafts."""
    return apply_changes(
        draft_changes(drafts), ["subject_id", "predicate_key"], ["observed_at", "turn_index", "draft_id"], values=["draft_id"], batches=batches
    )

