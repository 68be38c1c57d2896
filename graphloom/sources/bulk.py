"""Bulk and conversation sources. Schemas are given, so files are read once and in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import parse_time

NODE_LINES = "id BIGINT, labels ARRAY<STRING>, properties MAP<STRING, STRING>"
EDGE_LINES = "id BIGINT, type STRING, source_id BIGINT, target_id BIGINT, properties MAP<STRING, STRING>"
HAYSTACK = (
    "question_id STRING, question STRING, question_date STRING, haystack_session_ids ARRAY<STRING>, haystack_dates ARRAY<STRING>, "
    "haystack_sessions ARRAY<ARRAY<STRUCT<role: STRING, content: STRING>>>"
)
TURN = "context_id STRING, session_id STRING, role STRING, content STRING, timestamp STRING"


def node_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, labels, properties of a JSON-lines file of vertices on any Hadoop file system; broken lines are left out."""
    return spark.read.schema(NODE_LINES).option("mode", "DROPMALFORMED").json(path).where("id is not null")


def edge_lines(spark: SparkSession, path: str) -> DataFrame:
    """edge_type, src, dst, relationship_id, properties of a JSON-lines file of edges; rows without an end are left out."""
    rows = spark.read.schema(EDGE_LINES).option("mode", "DROPMALFORMED").json(path)
    return rows.where("type is not null and source_id is not null and target_id is not null").select(
        F.col("type").alias("edge_type"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("id").alias("relationship_id"), "properties"
    )


def haystack_records(spark: SparkSession, path: str) -> DataFrame:
    """context_id, session_id, record_id, actor_role, occurred_at, content of benchmark conversations, in session order by
    date. Empty turns are skipped but keep their number; gold fields are not in the schema and so never read."""
    rows = spark.read.schema(HAYSTACK).option("multiLine", True).json(path)
    sessions = rows.select(
        F.col("question_id").alias("context_id"), F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("source", "s")
    )
    turns = sessions.select(
        "context_id", "source", F.col("s.haystack_session_ids").alias("session_id"), parse_time(F.col("s.haystack_dates")).alias("occurred_at"), F.posexplode("s.haystack_sessions").alias("turn", "t")
    )
    kept = turns.where(F.length(F.trim(F.coalesce("t.content", F.lit("")))) > 0)
    record = F.format_string("%s:source-%04d:turn-%04d", "session_id", F.col("source") + 1, F.col("turn") + 1)
    return kept.select("context_id", "session_id", record.alias("record_id"), F.col("t.role").alias("actor_role"), "occurred_at", F.col("t.content").alias("content"))


def chat_turns(stream_or_df: DataFrame) -> DataFrame:
    """context_id, session_id, record_id, actor_role, occurred_at, content of single chat turns; works on streams too."""
    record = F.concat(F.lit("turn:"), F.sha2(F.concat_ws("\x00", "context_id", "session_id", "timestamp", "role", "content"), 256))
    return stream_or_df.select("context_id", "session_id", record.alias("record_id"), F.col("role").alias("actor_role"), parse_time(F.col("timestamp")).alias("occurred_at"), "content")


def write_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("errorifexists").json(path)
