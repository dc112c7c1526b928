"""Versioned state that grows batch by batch: only the buckets of threads that a batch touches are read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.snapshots import distinct_states, merged_states, numbered
from faultline.streaming.state import BUCKET, VersionedTable, touched

BUCKETS = 256


def _table(spark: SparkSession, root: str, states: DataFrame, thread: str, at: str) -> VersionedTable:
    types = dict(states.dtypes)
    payload = ",".join(f"`{c}`:{t}" for c, t in states.dtypes if c not in (thread, at))
    schema = (
        f"`{thread}` {types[thread]}, snapshot_id string, version bigint, parent_id string, first_at {types[at]}, last_at {types[at]}, "
        f"payload struct<{payload}>, payload_order struct<at:{types[at]},hash:bigint>"
    )
    return VersionedTable(spark, f"{root}/snapshots", schema)


def upsert_snapshots(
    states: DataFrame, state: Column, root: str, batch_id: int, thread: str = "thread_id", at: str = "at", buckets: int = BUCKETS
) -> None:
    """Add a batch of saved states to the versions under `root`; the same batch again changes nothing.

    The result is that of `snapshot_versions` over all batches: a state that comes late takes its place by its first time,
    and the versions after it move up.
    """
    table = _table(states.sparkSession, root, states, thread, at)
    bucket = F.pmod(F.xxhash64(thread), F.lit(buckets)).cast("string")
    new = distinct_states(states, state, thread, at).withColumn(BUCKET, bucket).persist()
    before = table.read(batch_id, touched(new)).drop("version", "parent_id")
    versions = numbered(merged_states(before.unionByName(new.drop(BUCKET)), thread), thread)
    table.write(versions.withColumn(BUCKET, bucket), batch_id)
    new.unpersist()


def stored_versions(states: DataFrame, root: str, thread: str = "thread_id", at: str = "at") -> DataFrame:
    """All versions under `root`; `states` only names the columns."""
    return _table(states.sparkSession, root, states, thread, at).read(2**31).drop("payload_order")
