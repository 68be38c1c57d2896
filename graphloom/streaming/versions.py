"""Tables as numbered version folders: a write is a new folder, a reader resolves the newest complete one (or a pinned one)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of complete versions, ascending; a write that broke off has no success marker and doesn't count."""
    where, fs = _files(spark, root)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    found = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]
    return sorted(n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{n}/_SUCCESS")))


def write_version(df: DataFrame, root: str, number: int | None = None, partition_by: tuple[str, ...] = ()) -> int:
    """Write df as the next (or the given) version. A given number that is already complete is left as it is, so a
    replayed batch changes nothing.

    The rows are written aside and the folder is renamed when it is complete. Of two writers of one number the second
    fails instead of replacing the first (the file system's rename must refuse an existing target).
    """
    spark = df.sparkSession
    have = versions(spark, root)
    asked = number
    number = number if number is not None else (have[-1] + 1 if have else 0)
    if number in have:
        return number
    aside, target = f"{root}/_writing-{uuid.uuid4().hex}", f"{root}/v{number}"
    df.write.partitionBy(*partition_by).parquet(aside)
    source, fs = _files(spark, aside)
    place, _ = _files(spark, target)
    if fs.exists(place) or not fs.rename(source, place):
        fs.delete(source, True)
        if asked is None or number not in versions(spark, root):
            raise RuntimeError(f"version {number} was published by another writer")
    return number


def read_version(spark: SparkSession, root: str, number: int | None = None, at_least: int | None = None) -> DataFrame:
    """The newest version, a pinned one, or the newest that is not older than a bookmark."""
    have = versions(spark, root)
    if number is None:
        number = have[-1] if have else -1
    if number not in have or (at_least is not None and number < at_least):
        raise ValueError(f"version {number} is not there yet")
    return spark.read.parquet(f"{root}/v{number}")


def drop_before(spark: SparkSession, root: str, low: int) -> None:
    """Delete versions older than `low`, the newest always staying."""
    for number in versions(spark, root)[:-1]:
        if number < low:
            where, fs = _files(spark, f"{root}/v{number}")
            fs.delete(where, True)
