"""Parquet table access. Every reader is lazy: filters and column choices made later reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory (a Parquet file or a folder of Parquet files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
