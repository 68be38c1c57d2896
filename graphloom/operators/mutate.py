"""Graph writes as DataFrame transformations: every function takes the current table and a batch, and gives the new table.

The caller writes the result as a new version (see streaming.versions). A batch that contradicts itself or an earlier one
raises when the result is computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["edge_type", "src", "dst"]


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def merge_edges(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges of the batch that are missing are added, their properties merged in (a given new value wins); repeats and
    rows with a null end change nothing."""
    properties = [c for c in batch.columns if c not in EDGE]
    rows = batch.where("edge_type is not null and src is not null and dst is not null")
    rows = rows.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("_n"), *[F.max(p).alias(f"_new_{p}") for p in properties])
    both = edges.join(rows, EDGE, "full")
    kept = [c for c in edges.columns if c not in EDGE]
    return both.select(*EDGE, *[F.coalesce(f"_new_{c}", c).alias(c) if c in properties else F.col(c) for c in kept], *[F.col(f"_new_{p}").alias(p) for p in properties if p not in kept])


def create_relationships(relationships: DataFrame, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """A new record for every row of the batch, its id from the greatest one on."""
    top = relationships.agg(F.coalesce(F.max("relationship_id"), F.lit(0)).alias("_top"))
    fresh = numbered(batch, order, "_number").crossJoin(F.broadcast(top))  # one row
    return _union(relationships, fresh.withColumn("relationship_id", F.col("_top") + F.col("_number")).drop("_number", "_top"))


def upsert_vertices(vertices: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge by id: labels are united, given properties replace old ones, missing ones stay. The batch must have one row
    an id (see coalesced)."""
    properties = [c for c in batch.columns if c not in ("id", "labels")]
    new = batch.select("id", *[F.col(c).alias(f"_new_{c}") for c in batch.columns if c != "id"])
    both = vertices.join(new, "id", "full")
    labels = [F.array_sort(F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("_new_labels", F.array().cast("array<string>")))).alias("labels")]
    kept = [c for c in vertices.columns if c not in ("id", "labels")]
    return both.select("id", *(labels if "labels" in batch.columns else ["labels"]), *[F.coalesce(f"_new_{c}", c).alias(c) if c in properties else F.col(c) for c in kept])


def coalesced(batch: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key; two different values for one property of a key raise."""
    properties = [c for c in batch.columns if c not in (key, "labels")]
    one = batch.groupBy(key).agg(
        *([F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels")] if "labels" in batch.columns else []),
        *[F.max(p).alias(p) for p in properties],
        *[F.count_distinct(p).alias(f"_n_{p}") for p in properties],
    )
    if not properties:
        return one
    clash = reduce(lambda a, b: a | b, [F.col(f"_n_{p}") > 1 for p in properties])
    checked = one.withColumn(key, F.when(clash, F.raise_error(F.concat(F.lit("conflicting values in one batch for "), F.col(key).cast("string")))).otherwise(F.col(key)))
    return checked.drop(*[f"_n_{p}" for p in properties])


def guarded_upsert(table: DataFrame, batch: DataFrame, key: str, guard: str, create_only: Sequence[str] = ()) -> DataFrame:
    """Upsert that applies a row only if its guard is strictly greater than the stored one; a missing stored guard loses,
    a missing new guard never applies to a stored row. create_only columns keep their stored values."""
    newest = batch.groupBy(key).agg(F.max(F.struct(guard, *[c for c in batch.columns if c not in (key, guard)])).alias("_new"))
    both = table.withColumn("_old", F.lit(True)).join(newest, key, "full")
    apply = F.col("_old").isNull() | (F.col(f"_new.{guard}").isNotNull() & (F.col(guard).isNull() | (F.col(f"_new.{guard}") > F.col(guard))))
    apply = F.col("_new").isNotNull() & F.coalesce(apply, F.lit(False))

    def value(c: str) -> Column:
        if c not in batch.columns:
            return F.col(c)
        if c in create_only:
            return F.when(F.col("_old").isNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        return F.when(apply, F.coalesce(F.col(f"_new.{c}"), F.col(c))).otherwise(F.col(c)).alias(c)

    return both.select(key, *[value(c) for c in table.columns if c != key])


def set_properties(table: DataFrame, matched: DataFrame, key: str, **values: object) -> DataFrame:
    """Set properties on the rows whose key is in `matched`; the key itself can't be set."""
    if key in values:
        raise ValueError(f"{key} can't be changed")
    hit = matched.select(key).distinct().withColumn("_hit", F.lit(True))
    both = table.join(hit, key, "left")
    for name, v in values.items():
        both = both.withColumn(name, F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(name)))
    return both.select(*table.columns)


def set_labels(vertices: DataFrame, matched: DataFrame, add: Sequence[str] = (), remove: Sequence[str] = ()) -> DataFrame:
    hit = matched.select("id").distinct().withColumn("_hit", F.lit(True))
    have = F.coalesce("labels", F.array().cast("array<string>"))
    new = F.array_sort(F.array_except(F.array_union(have, F.array(*map(F.lit, add)).cast("array<string>")), F.array(*map(F.lit, remove)).cast("array<string>")))
    return vertices.join(hit, "id", "left").withColumn("labels", F.when(F.col("_hit"), new).otherwise(F.col("labels"))).select(*vertices.columns)


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the edges (or relationship records) of the given (edge_type, src, dst)."""
    return edges.join(keys.select(*EDGE).distinct(), EDGE, "left_anti")


def delete_edges_with_records(edges: DataFrame, relationships: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, relationships) without the given edges: the records of an edge go with it."""
    return delete_edges(edges, keys), delete_edges(relationships, keys)


def merge_relationships(relationships: DataFrame, batch: DataFrame, key: str = "relationship_id") -> DataFrame:
    """Records by their id: a new id is inserted, a known one keeps its ends and gets the batch's present values (SET).

    A batch row with another type or other ends than the stored record raises; of rows of one id, the greatest counts.
    """
    values = [c for c in batch.columns if c != key]
    new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*values)).alias("_new"))
    both = relationships.withColumn("_old", F.lit(True)).join(new, key, "full")
    moved = F.col("_old").isNotNull() & F.col("_new").isNotNull() & reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_new.{c}")) for c in EDGE])
    bad = F.raise_error(F.concat(F.lit("relationship has other ends: "), F.col(key).cast("string"))).cast("boolean")
    checked = both.where(F.when(moved, bad).otherwise(F.lit(True)))
    return checked.select(*[F.coalesce(f"_new.{c}", c).alias(c) if c in values else F.col(c) for c in relationships.columns])


#: Rows that one task numbers at most, about; the number of hash parts grows with the rows.
NUMBERED_ROWS = 1_000_000


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows with consecutive numbers from 1 on, given within hash parts from counts of the parts before, so no task sees
    all rows. The sizes, one row a part, are a small table that is joined, not collected."""
    parts = max(64, -(-rows.count() // NUMBERED_ROWS))
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inner = parted.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inner.join(before, "_part").withColumn(name, F.col("_before") + F.col("_rn")).drop("_part", "_rn", "_before")


def delete_relationships(relationships: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """Without the records whose property is among the values."""
    return relationships.join(values.select(name).distinct(), name, "left_anti")


def delete_vertices(
    vertices: DataFrame, edges: DataFrame, ids: DataFrame, detach: bool = False, relationships: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(vertices, edges, relationships) without the given ids. detach takes incident edges and relationship records along;
    without it, incident edges of a deleted vertex raise."""
    gone = ids.select("id").where("id is not null").distinct()
    if detach:
        for end in ("src", "dst"):
            edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
            if relationships is not None:
                relationships = relationships.join(gone.select(F.col("id").alias(end)), end, "left_anti")
        return vertices.join(gone, "id", "left_anti"), edges, relationships
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).join(gone, "id", "left_semi").distinct()
    blocked = gone.join(ends.withColumn("_used", F.lit(True)), "id", "left")
    checked = blocked.select(F.when(F.col("_used"), F.raise_error(F.concat(F.lit("vertex has edges: "), F.col("id").cast("string")))).otherwise(F.col("id")).alias("id"))
    return vertices.join(checked, "id", "left_anti"), edges, relationships


def between_labels(batch: DataFrame, vertices: DataFrame, src_label: str, dst_label: str) -> DataFrame:
    """Rows of the batch whose ends carry the labels."""
    have = lambda label, end: vertices.where(F.array_contains("labels", label)).select(F.col("id").alias(end)).distinct()
    return batch.join(have(src_label, "src"), "src", "left_semi").join(have(dst_label, "dst"), "dst", "left_semi")


def idempotent(batch: DataFrame, ledger: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """Rows of the batch whose idempotency key is new, once each. A key with other content than in the ledger or twice
    in the batch raises; a replay with equal content is dropped. Rows without a key are always new.

    ledger: (key, digest).
    """
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    keyed = batch.withColumn("digest", digest)
    own = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("digest").alias("digest"), F.count_distinct("digest").alias("_n"), F.first(F.struct(*batch.columns)).alias("_row"))
    old = ledger.select(key, F.col("digest").alias("_old"))
    both = own.join(old, key, "left")
    clash = (F.col("_n") > 1) | (F.col("_old") != F.col("digest"))
    # One condition decides and raises, so no optimisation can skip the check.
    bad = F.raise_error(F.concat(F.lit("idempotency key used for other content: "), F.col(key))).cast("boolean")
    fresh = both.where(F.when(F.coalesce(clash, F.lit(False)), bad).otherwise(F.col("_old").isNull())).select("_row.*")
    return fresh.unionByName(batch.where(F.col(key).isNull()))


def replace_rows(table: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the batch take the place of rows with their key."""
    return _union(table.join(batch.select(*key).distinct(), list(key), "left_anti"), batch)


def import_new(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Insert only: equal rows are kept once, a row whose key is there with other content raises."""
    new = batch.distinct()
    other = [c for c in table.columns if c != key]
    known = table.select(key, F.struct(*other).alias("_old"))
    both = new.join(known, key, "left")
    clash = F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.struct(*other))
    bad = F.raise_error(F.concat(F.lit("already there with other content: "), F.col(key).cast("string"))).cast("boolean")
    fresh = both.where(F.when(clash, bad).otherwise(F.col("_old").isNull()))
    return _union(table, fresh.select(*table.columns))


def outcome(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: created, deleted, updated and unchanged rows between two versions of a table."""
    other = [c for c in after.columns if c not in key]
    content = lambda df, name: df.select(*key, F.sha2(F.to_json(F.struct(F.lit(1).alias("one"), *other)), 256).alias(name))
    both = content(before, "_a").join(content(after, "_b"), list(key), "full")
    count = lambda c: F.count(F.when(c, 1))
    a, b = F.col("_a"), F.col("_b")
    return both.agg(
        count(a.isNull()).alias("created"), count(b.isNull()).alias("deleted"), count((a != b)).alias("updated"), count((a == b)).alias("unchanged")
    )
