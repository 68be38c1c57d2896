"""Validity history of changing attributes from stored checkpoints and patches.

An entity's changes are patches of its attributes. They are stored in segments of time: an entity with few changes has one,
one with many has a segment about every VERSION_EVERY changes. For each segment of an entity a checkpoint holds its full
version, the patch in force of every attribute, at the segment's start. Validity rows come from folding the patches of a
segment forward from its checkpoint, the state at an instant from one checkpoint and the patches after it. A long history
is therefore many units of work, and a state never needs more than one segment of it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.changes import OPEN_END_SECONDS, draft_changes
from graphloom.session import cut

#: An entity gets a full version after about this many changes; time is cut into at most so many slices.
VERSION_EVERY = 2_000
SLICES = 1_024


def slice_of(start: Column, bounds: list[int]) -> Column:
    """The number of bounds below `start`: first among every so-manyth bound, then in the block between two of these."""
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    below = lambda marks: F.size(F.filter(marks, lambda b: b < start))
    coarse = below(literal([b[-1] for b in blocks[:-1]], "array<bigint>"))
    return coarse * width + below(F.element_at(literal(blocks, "array<array<bigint>>"), coarse + 1))


@dataclass
class History:
    """The stored tables: patches with their segment, and checkpoints, with the time slices' bounds.

    patches and checkpoints: keys, segment, start, own_end, value, removes; in checkpoints the patch in force when the
    segment began. spans: entity, segment, final (whether it is the entity's last).
    """

    patches: DataFrame
    checkpoints: DataFrame
    spans: DataFrame
    entity: list[str]
    attribute: list[str]
    open_end: int

    @property
    def keys(self) -> list[str]:
        return [*self.entity, *self.attribute]


PATCH = ["start", "own_end", "value", "removes"]


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[f"_{c}"])
    return on


def _named(df: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in columns], *more)


def with_segments(rows: DataFrame, entity: Sequence[str], start: str, segments: int | None = None) -> DataFrame:
    """rows with `segment`, a number that grows with `start`: 0 for entities with up to VERSION_EVERY rows, for longer ones
    about so many rows each; or one of `segments` slices of time for every entity."""
    slices = segments or SLICES
    shares = [i / slices for i in range(1, slices)] or [0.5]
    bounds = sorted(set(rows.agg(F.percentile_approx(start, shares, 10_000).alias("b")).first()["b"] or []))
    if segments:
        return rows.withColumn("segment", slice_of(F.col(start), bounds).cast("int"))
    long = rows.groupBy(*entity).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > VERSION_EVERY)
    long = _named(long.withColumn("_parts", F.least(F.lit(slices), F.ceil(F.col("n") / VERSION_EVERY))), entity, "_parts")
    marked = rows.join(long, _same(rows, long, entity), "left")
    segment = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.floor(slice_of(F.col(start), bounds) * F.col("_parts") / (len(bounds) + 1)))
    return marked.withColumn("segment", segment.cast("int")).select(*rows.columns, "segment")


def store_history(patches: DataFrame, entity: Sequence[str], attribute: Sequence[str], segments: int | None = None, open_end: int = OPEN_END_SECONDS) -> History:
    """Write patches (entity, attribute, start, own_end, value, removes) and checkpoints as tables.

    segments: so many time slices for every entity; by default as many as its changes need.
    """
    entity, attribute = list(entity), list(attribute)
    keys = [*entity, *attribute]
    rows = cut(patches.where(F.col("start").isNotNull()).select(*keys, *PATCH))
    segmented = with_segments(rows, entity, "start", segments)
    segmented = cut(segmented)
    own = segmented.select(*entity, "segment").distinct()
    spans = cut(own.withColumn("final", F.lead("segment").over(Window.partitionBy(*entity).orderBy("segment")).isNull()))
    return History(segmented, cut(_checkpoints(segmented, spans, entity, attribute)), spans, entity, attribute, open_end)


def _checkpoints(segmented: DataFrame, spans: DataFrame, entity: list[str], attribute: list[str]) -> DataFrame:
    """The full version of each entity at the start of each of its segments but the first, a row an attribute.

    At most attributes x segments rows of an entity; the last patch of each segment is a partial aggregate.
    """
    keys = [*entity, *attribute]
    last = segmented.groupBy(*keys, "segment").agg(F.max(F.struct(*PATCH)).alias("last"))
    first = last.groupBy(*keys).agg(F.min("segment").alias("since"))
    later = spans.where("not final").groupBy(*entity).agg(F.count(F.lit(1)).alias("_n"))
    later = _named(later, entity)
    first = first.join(later, _same(first, later, entity), "left_semi")
    marks = _named(spans, entity, "segment")
    wanted = first.join(marks, _same(first, marks, entity) & (F.col("segment") > F.col("since"))).select(*keys, "segment", F.lit(None).alias("last"), F.lit(True).alias("asked"))
    both = last.withColumn("asked", F.lit(False)).unionByName(wanted.withColumn("last", F.col("last").cast(last.schema["last"].dataType)))
    # An asked-for row sorts before the segment's own patches and takes the last patch of any segment before.
    order = Window.partitionBy(*keys).orderBy("segment", F.col("asked").desc()).rowsBetween(Window.unboundedPreceding, -1)
    held = both.withColumn("held", F.last("last", ignorenulls=True).over(order)).where("asked")
    return held.select(*keys, "segment", *[F.col("held")[c].alias(c) for c in PATCH])


def fold(frames: Iterator[pd.DataFrame], keys: list[str], open_end: int) -> Iterator[pd.DataFrame]:
    """Fold patches, sorted by entity, segment, attribute and start, into runs of equal value.

    Every patch ends where the next one of its group starts; the last one of a group ends with its own end, and only in
    the entity's final segment, as the next segment's checkpoint stands for it otherwise. `edge` marks the first and
    last run of a group, which may go on over the segment's border.
    """
    kept: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
        if not len(frame):
            continue
        ids = _group_ids(frame, [*keys, "segment"])
        last = ids == ids[-1]
        kept = frame[last].reset_index(drop=True)
        yield _runs(frame[~last].reset_index(drop=True), ids[~last], keys, open_end)
    if kept is not None:
        yield _runs(kept, np.zeros(len(kept), np.int64), keys, open_end)


def _group_ids(frame: pd.DataFrame, columns: list[str]) -> np.ndarray:
    new = np.zeros(len(frame), bool)
    for c in columns:
        # Codes make nulls equal to one another.
        codes = pd.factorize(frame[c], use_na_sentinel=True)[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _runs(frame: pd.DataFrame, ids: np.ndarray, keys: list[str], open_end: int) -> pd.DataFrame:
    start = frame["start"].to_numpy(np.int64)
    end = frame["own_end"].astype("float64").to_numpy()
    own_end = np.where(np.isfinite(end) & (end > start) & (end < open_end), np.nan_to_num(end, nan=0, posinf=0, neginf=0), open_end).astype(np.int64)
    has_next = np.zeros(len(frame), bool)
    has_next[:-1] = ids[1:] == ids[:-1]
    nxt = np.full(len(frame), open_end, np.int64)
    nxt[:-1] = np.where(has_next[:-1], start[1:], open_end)
    stop = np.minimum(nxt, own_end)
    holds = (has_next | frame["final"].to_numpy(bool)) & ~frame["removes"].fillna(False).to_numpy(bool)
    at = np.flatnonzero(holds)
    if not len(at):  # a batch inside one group has no finished group, and groups that only remove have no period
        return frame.iloc[:0][keys].assign(valid_from=start[:0], valid_to=stop[:0], value=frame["value"].iloc[:0], edge=has_next[:0])
    ids, start, stop = ids[at], start[at], stop[at]
    value = pd.factorize(frame["value"], use_na_sentinel=True)[0][at]
    new = np.ones(len(at), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (value[1:] != value[:-1]) | (start[1:] != stop[:-1])
    first = np.flatnonzero(new)
    out = frame.loc[at[first], keys].reset_index(drop=True)
    lasts = np.append(first[1:], len(at)) - 1
    group = ids[first]
    edge = np.ones(len(first), bool)
    if len(first) > 2:
        edge[1:-1] = (group[1:-1] != group[:-2]) | (group[1:-1] != group[2:])
    return out.assign(valid_from=start[first], valid_to=stop[lasts], value=frame["value"].to_numpy()[at[first]], edge=edge & ~frame["alone"].to_numpy(bool)[at[first]])


def periods_of(history: History) -> DataFrame:
    """keys, valid_from, valid_to (exclusive), value: the joined periods, folded segment by segment."""
    keys, entity = history.keys, history.entity
    rows = history.patches.unionByName(history.checkpoints)
    marks = _named(history.spans.withColumn("alone", F.col("final") & (F.min("segment").over(Window.partitionBy(*entity)) == F.col("segment"))), entity, F.col("segment").alias("_segment"), "final", "alone")
    rows = rows.join(marks, _same(rows, marks, entity) & (F.col("segment") == F.col("_segment"))).select(*keys, "segment", *PATCH, "final", "alone")
    ordered = rows.repartition(*entity, "segment").sortWithinPartitions(*entity, "segment", *history.attribute, "start")
    types = {f.name: f.dataType.simpleString() for f in history.patches.schema}
    shape = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "valid_from bigint, valid_to bigint", f"value {types['value']}", "edge boolean"])
    open_end = history.open_end
    runs = cut(ordered.mapInPandas(lambda frames: fold(frames, keys, open_end), shape))
    # Only the first and last run of a segment can continue over its border; the rest is finished.
    border = _join_equal(runs.where("edge").drop("edge"), keys)
    return runs.where("not edge").drop("edge").unionByName(border)


def validity_periods(
    patches: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "own_end",
    value: str = "value",
    removes: str = "removes",
    segments: int | None = None,
    open_end: int = OPEN_END_SECONDS,
) -> DataFrame:
    """keys, valid_from, valid_to (exclusive), value: the joined periods in which each value of a key held.

    The first key names the entity, the others its attribute. patches: at most one row for each key and start. A row holds
    from its start to the next row's start, or to `end` where that is earlier and after the start; `removes` rows only end.
    Periods that meet with equal `value` (null equals null) are one. Null keys are one key; rows without start are left
    out; empty input gives no rows.
    """
    keys = list(keys)
    named = patches.select(*keys, F.col(start).alias("start"), F.col(end).alias("own_end"), F.col(value).alias("value"), F.col(removes).alias("removes"))
    return periods_of(store_history(named, keys[:1], keys[1:], segments, open_end))


def _join_equal(periods: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("valid_from")
    same = F.lag("valid_to").over(w).eqNullSafe(F.col("valid_from")) & F.lag("value").over(w).eqNullSafe(F.col("value")) & (
        F.lag("valid_from").over(w).isNotNull()
    )
    runs = periods.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(
        F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"), F.first("value").alias("value")
    ).drop("_run")


def draft_patches(drafts: DataFrame) -> DataFrame:
    """The changes of extracted_drafts as patches: of changes of a key with the same start, the last one.

    The start is valid_from, or observed_at where valid_from is null or 1970-01-01.
    """
    changes = draft_changes(drafts)
    start = F.when(F.col("valid_from").isNull() | (F.col("valid_from") == 0), F.col("observed_at")).otherwise(F.col("valid_from"))
    value = F.lower(F.trim("object_value"))
    newest = F.max(F.struct("observed_at", "turn_index", "draft_id", F.col("valid_to").alias("own_end"), value.alias("value"), "action"))
    one = changes.withColumn("start", start).groupBy("subject_id", "predicate_key", "start").agg(newest.alias("c"))
    return one.select(
        "subject_id", "predicate_key", "start", F.col("c.own_end").alias("own_end"), F.col("c.value").alias("value"), (F.col("c.action") == "DELETE").alias("removes")
    )


def draft_periods(drafts: DataFrame, segments: int | None = None) -> DataFrame:
    """subject_id, predicate_key, valid_from, valid_to of every joined period, in epoch seconds."""
    periods = validity_periods(draft_patches(drafts), ["subject_id", "predicate_key"], segments=segments)
    return periods.select("subject_id", "predicate_key", "valid_from", "valid_to")


def reconstruct(history: History, at: int, entities: DataFrame | None = None) -> DataFrame:
    """keys, value: the full version of each entity (of `entities`, by default of all) at one instant.

    Of each entity, the checkpoint of its nearest segment that begins no later and that segment's patches up to the
    instant are read; later segments and those before the checkpoint are not.
    """
    entity, keys = history.entity, history.keys
    patches, checkpoints = history.patches, history.checkpoints
    if entities is not None:
        asked = _named(entities.select(*entity).distinct(), entity)
        patches = patches.join(asked, _same(patches, asked, entity), "left_semi")
        checkpoints = checkpoints.join(asked, _same(checkpoints, asked, entity), "left_semi")
    nearest = _named(patches.where(F.col("start") <= at).groupBy(*entity).agg(F.max("segment").alias("_segment")), entity, "_segment")
    fits = lambda df: df.join(nearest, _same(df, nearest, entity) & (df["segment"] == F.col("_segment")), "left_semi")
    known = fits(checkpoints).unionByName(fits(patches.where(F.col("start") <= at)))
    newest = known.groupBy(*keys).agg(F.max_by(F.struct("own_end", "value", "removes"), "start").alias("p"), F.max("start").alias("start"))
    ended = (F.col("p.own_end") > F.col("start")) & (F.col("p.own_end") <= at)
    return newest.where(~F.coalesce(F.col("p.removes"), F.lit(False)) & ~F.coalesce(ended, F.lit(False))).select(*keys, F.col("p.value").alias("value"))
