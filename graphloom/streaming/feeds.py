"""Structured Streaming over change feeds: incremental edges, newer-wins state, tumbling counts, event sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, directory: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A table's files as a stream, in batches of a few files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{directory}/{name}.parq[u]et")


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there now, batch by batch; progress is in `checkpoint`, so a restart goes on where it stopped."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _write_batch(rows: DataFrame, root: str, number: int) -> None:
    """The batch as its own folder; a replay of the batch replaces it, so nothing counts twice."""
    rows.write.mode("overwrite").parquet(f"{root}/batch={number}")


def maintain_edges(stream: DataFrame, root: str, checkpoint: str) -> None:
    """Keep the changes of edges (edge_type, src, dst, seq, exists) under `root`: of each batch the newest of an edge.

    A batch costs its own rows only; current_edges() puts them together, compact_edges() folds old batches now and then.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.where("edge_type is not null and src is not null and dst is not null")
        newest = rows.groupBy("edge_type", "src", "dst").agg(F.max(F.struct("seq", "exists")).alias("c"))
        _write_batch(newest.select("edge_type", "src", "dst", "c.*"), root, number)

    run_batches(stream, apply, checkpoint)


def _newest_changes(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.parquet(root)
    return rows.groupBy("edge_type", "src", "dst").agg(F.max(F.struct("seq", "exists")).alias("c")).select("edge_type", "src", "dst", "c.*")


def current_edges(spark: SparkSession, root: str) -> DataFrame:
    """edge_type, src, dst that exist after all batches kept so far; the greatest seq of an edge counts."""
    return _newest_changes(spark, root).where("exists").select("edge_type", "src", "dst")


def compact_edges(spark: SparkSession, root: str, target: str) -> None:
    """Write the newest change of each edge as one table of the same layout; readers then move to `target`. Deletions stay
    until no later batch can hold an older change of their edge."""
    _write_batch(_newest_changes(spark, root), target, 0)


def maintain_newest(stream: DataFrame, root: str, checkpoint: str, key: str, guard: str) -> None:
    """Keep the rows of a keyed table under `root`: of each batch the one with the greatest guard of a key."""

    def apply(batch: DataFrame, number: int) -> None:
        others = [c for c in batch.columns if c not in (key, guard)]
        newest = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(guard, *others)).alias("c"))
        _write_batch(newest.select(key, "c.*"), root, number)

    run_batches(stream, apply, checkpoint)


def current_newest(spark: SparkSession, root: str, key: str, guard: str, create_only: tuple[str, ...] = ()) -> DataFrame:
    """The row of each key with the greatest guard; of equal guards the earlier batch counts. A missing value doesn't
    replace an earlier one, and create_only columns keep their first value."""
    rows = spark.read.parquet(root)
    others = [c for c in rows.columns if c not in (key, guard, "batch")]
    last = F.struct(guard, (-F.col("batch")).alias("b"))
    first = F.struct((-F.col("batch")).alias("b"), guard)
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), first if c in create_only else last)).alias(c)
    return rows.groupBy(key).agg(F.max(guard).alias(guard), *[pick(c) for c in others])


def windowed_counts(stream: DataFrame, time: str, by: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, by, n: events of tumbling windows; rows later than the watermark are dropped by a running stream."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, every).alias("w"), F.col(by))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), by, "n")
    )


def changes_since(delta: DataFrame, seq: int) -> DataFrame:
    """The part of a change log after a snapshot."""
    return delta.where(F.col("seq") > seq)


def as_events(df: DataFrame, kind: str) -> DataFrame:
    """One JSON text (`value`) for each row: {"event": kind, "data": {...}}, for a line-based sink."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("event"), F.struct(*df.columns).alias("data"))).alias("value"))
