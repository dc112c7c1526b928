"""The stream buffer: an append log of messages, read by time of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 10_000
MESSAGE_FIELDS = (
    "incident_id", "source_system", "severity", "service", "message", "timestamp", "incident_type", "error_type",
    "affected_resource",
)
MESSAGE = "struct<" + ",".join(f"{f}:string" for f in MESSAGE_FIELDS) + ">"


def messages(events: DataFrame) -> DataFrame:
    """Events as buffer rows: arrival_ts, seq (their id) and one JSON text; missing texts become empty."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    fields = [
        (iso if f == "timestamp" else F.coalesce(F.col(f), F.lit("")) if f in ("error_type", "affected_resource") else F.col(f)).alias(f)
        for f in MESSAGE_FIELDS
    ]
    return events.select("arrival_ts", F.col("incident_id").alias("seq"), F.to_json(F.struct(*fields)).alias("data"))


def append_stream(events: DataFrame, path: str) -> None:
    """Append to the buffer, in folders by arrival date so that a window reads few of them."""
    rows = messages(events).withColumn("arrival_date", F.to_date("arrival_ts"))
    rows.write.mode("append").partitionBy("arrival_date").parquet(path)


def scan_window(buffer: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """Messages that arrived in the `seconds` before `as_of`, both ends included, oldest first.

    Rows without data or with broken JSON are left out; nothing is removed from the buffer.
    """
    start = as_of - F.expr(f"interval {seconds} seconds")
    rows = buffer.where((F.col("arrival_ts") >= start) & (F.col("arrival_ts") <= as_of))
    if "arrival_date" in buffer.columns:
        rows = rows.where(F.col("arrival_date").between(F.to_date(start), F.to_date(as_of)))
    rows = rows.where(F.coalesce("data", F.lit("")) != "").where(F.try_parse_json("data").isNotNull())
    return rows.select("arrival_ts", "seq", F.from_json("data", MESSAGE).alias("m")).select(
        "arrival_ts", "seq", "m.*"
    ).orderBy("arrival_ts", "seq")


def cap_buffer(buffer: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The newest messages; the buffer holds no more than `capacity`."""
    return buffer.orderBy(F.desc("arrival_ts"), F.desc("seq")).limit(capacity)


def stream_status(buffer: DataFrame, key: str = "stream:incidents") -> DataFrame:
    return buffer.agg(
        F.lit(key).alias("key"), F.count("*").alias("length"), F.lit(True).alias("available"),
        F.min("arrival_ts").alias("oldest"), F.max("arrival_ts").alias("newest"),
    )
