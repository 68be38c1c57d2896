"""Resolving mentions to known entities, and upserts that guard immutable content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import cosine


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """mentions with entity_id and how: by exact canonical name, else by exact alias, else a new id from its key.

    mentions: (context_id, surface, ...); entities: (context_id, surface, entity_id); aliases alike. The smallest id
    counts where a name is taken twice. New ids are deterministic, negative hashes of (context, surface), so all mentions
    of a new name share one. Null surfaces stay unresolved.
    """
    one = lambda df, name: df.groupBy("context_id", "surface").agg(F.min("entity_id").alias(name))
    both = mentions.join(one(entities, "_exact"), ["context_id", "surface"], "left").join(one(aliases, "_alias"), ["context_id", "surface"], "left")
    fresh = F.when(F.col("surface").isNotNull(), -1 - F.shiftrightunsigned(F.xxhash64("context_id", "surface"), 2))
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "alias").when(F.col("surface").isNotNull(), "new")
    return both.withColumn("entity_id", F.coalesce("_exact", "_alias", fresh)).withColumn("how", how).drop("_exact", "_alias")


def similar_within(rows: DataFrame, probes: DataFrame, block: str, least: float = 0.75, most: int = 5) -> DataFrame:
    """probe_id, id, cos, rank: for each probe the most similar rows of its block (a haystack or context) from `least` on.

    rows: (id, block, vector), probes: (probe_id, block, vector). Probes are a stated query set; they meet rows of their
    own block only, on an equi-join.
    """
    asked = probes.select("probe_id", block, F.col("vector").alias("_p"))
    scored = rows.join(asked, block).where("id <> probe_id").withColumn("cos", F.round(cosine(F.col("vector"), F.col("_p")), 9)).where(F.col("cos") >= least)
    w = Window.partitionBy("probe_id").orderBy(F.col("cos").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("probe_id", "id", "cos", "rank")


def guarded_manifest(store: DataFrame, batch: DataFrame, key: Sequence[str], mutable: Sequence[str]) -> DataFrame:
    """Upsert in which only `mutable` columns of a stored row may change; another change raises.

    A null mutable value of the batch leaves the stored one. The batch must have one row a key.
    """
    fixed = [c for c in store.columns if c not in key and c not in mutable]
    new = batch.select(*key, *[F.col(c).alias(f"_n_{c}") for c in [*fixed, *mutable]], F.lit(True).alias("_new"))
    both = store.withColumn("_old", F.lit(True)).join(new, list(key), "full")
    clash = F.lit(False)
    for c in fixed:
        clash = clash | ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    clash = F.col("_old").isNotNull() & F.col("_new").isNotNull() & clash
    bad = F.raise_error(F.concat(F.lit("immutable content changed: "), F.concat_ws("/", *[F.col(k).cast("string") for k in key]))).cast("boolean")
    checked = both.where(F.when(clash, bad).otherwise(F.lit(True)))
    pick = lambda c: F.coalesce(f"_n_{c}", c).alias(c) if c in mutable else F.coalesce(c, f"_n_{c}").alias(c)
    return checked.select(*[F.col(k) if k in key else pick(k) for k in store.columns])


def property_kind(document, path: str):
    """struct(kind, text) of a JSON document's value: integral numbers become ints, null, arrays and objects their JSON text.

    kind is int, float, bool, string, json or null where the path or document is missing.
    """
    value = F.try_variant_get(F.try_parse_json(document), path, "variant")
    number = F.try_variant_get(F.try_parse_json(document), path, "double")
    of = F.schema_of_variant(value)
    integral = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 9e15)
    kind = (
        F.when(value.isNull(), None)
        .when(of.isin("STRING"), "string")
        .when(of.isin("BOOLEAN"), "bool")
        .when(of.isin("BIGINT") | (of.startswith("DECIMAL") | of.isin("DOUBLE")) & integral, "int")
        .when(of.startswith("DECIMAL") | of.isin("DOUBLE"), "float")
        .otherwise("json")
    )
    text = F.when(kind == "int", number.cast("bigint").cast("string")).when(kind == "string", F.try_variant_get(F.try_parse_json(document), path, "string")).otherwise(F.to_json(value))
    return F.struct(kind.alias("kind"), text.alias("text"))
