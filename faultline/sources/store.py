"""The record, action and tool-call tables: writes, newest-first reads, and tables in buckets for joins without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LIMIT = 500
BUCKETS = 32  # a large store asks for more: about a bucket per 256 MB of its largest table


def _append(df: DataFrame, path: str, at: str, key: str) -> None:
    """Append in folders by date; rows of one batch with the same key are written once."""
    dated = df.dropDuplicates([key]).withColumn("date", F.to_date(at))
    dated.write.mode("append").partitionBy("date").parquet(path)


def write_evaluations(records: DataFrame, path: str) -> None:
    """Flat columns for filters, plus the incident and the result as structs."""
    incident = [c for c in ("workflow", "stage", "incident_type", "category", "severity", "source", "message", "context") if c in records.columns]
    result = [c for c in ("status", "score", "summary", "reasoning", "suggested_action", "tags") if c in records.columns]
    flat = records.select(
        "record_id", "received_at", "workflow", "severity", "incident_type", "status", "score", "suggested_action", "summary",
        F.struct(*incident).alias("incident"), F.struct(*result).alias("result"),
    )
    _append(flat, path, "received_at", "record_id")


def write_actions(actions: DataFrame, path: str) -> None:
    _append(actions, path, "executed_at", "action_id")


def write_tool_calls(log: DataFrame, path: str) -> None:
    _append(log, path, "executed_at", "log_id")


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """`df` appended to the table `name` at `path`, in buckets of record_id, and that table.

    Tables with the same number of buckets hold the rows of one record in the same bucket. The rows are dealt as the
    buckets are, so a batch adds one file per bucket.
    """
    if df.schema["record_id"].dataType.simpleString() != "string":
        raise ValueError("record_id must be a string: buckets of different types do not match")
    dealt = df.repartition(buckets, "record_id")
    dealt.write.bucketBy(buckets, "record_id").sortBy("record_id").mode("append").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _newest(df: DataFrame, filters: dict[str, str | None], limit: int, *order: str) -> DataFrame:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    for column, value in filters.items():
        if value:
            df = df.where(F.col(column) == value)
    return df.orderBy(*[F.desc(c) for c in order]).limit(limit)


def list_incidents(records: DataFrame, workflow: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    return _newest(records, {"workflow": workflow, "status": status}, limit, "received_at", "record_id")


def incident_records(stored: DataFrame) -> DataFrame:
    """Stored rows as whole records: the incident and the result as structs, beside the id and the time."""
    return stored.select("record_id", "received_at", "incident", "result")


def list_actions(actions: DataFrame, workflow: str | None = None, action_type: str | None = None, limit: int = 50) -> DataFrame:
    return _newest(actions, {"workflow": workflow, "action_type": action_type}, limit, "executed_at", "action_id")


def list_tool_calls(log: DataFrame, workflow: str | None = None, limit: int = 50) -> DataFrame:
    return _newest(log, {"workflow": workflow}, limit, "executed_at", "log_id")


def analytics_rows(records: DataFrame) -> DataFrame:
    return records.select("record_id", "received_at", "workflow", "severity", "status", "score", "suggested_action")


def audit_trail(records: DataFrame, actions: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """Each record with its action and its tool calls, where there are any."""
    a = actions.select("record_id", "action_id", "action_type", "outcome")
    t = tool_calls.select("record_id", "log_id", "total_tools", "successful_tools")
    return records.join(a, "record_id", "left").join(t, "record_id", "left")


def stored_audit_trail(records: DataFrame, actions: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """`audit_trail` over tables of `write_bucketed`: buckets are merged side by side, nothing is shuffled or broadcast."""
    return audit_trail(records, actions.hint("merge"), tool_calls.hint("merge"))
