"""Versioned state per thread, messages between agents, and what is kept of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.ordered import row_numbers, sliding


def snapshot_id(state: Column) -> Column:
    """First 16 hex digits of the state's hash; `state` is text with its keys in order."""
    return F.substring(F.sha2(state, 256), 1, 16)


def snapshot_versions(states: DataFrame, state: Column, thread: str = "thread_id", at: str = "at") -> DataFrame:
    """Saved states -> one row per distinct state of a thread.

    The version counts distinct states in the order they first came; a state saved again keeps its version
    and takes the newer payload and time. The parent is the state before it.
    """
    return numbered(distinct_states(states, state, thread, at), thread).drop("payload_order")


def distinct_states(states: DataFrame, state: Column, thread: str = "thread_id", at: str = "at") -> DataFrame:
    """One row per thread and state: first and last time, the newest payload, and what it was chosen by."""
    keyed = states.withColumn("snapshot_id", snapshot_id(state))
    others = [c for c in states.columns if c not in (thread, at)]
    # of states saved at one instant the same one is taken in every run
    order = F.struct(F.col(at).alias("at"), F.xxhash64(*others).alias("hash"))
    return keyed.groupBy(thread, "snapshot_id").agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max_by(F.struct(*others), order).alias("payload"), F.max(order).alias("payload_order")
    )


def merged_states(parts: DataFrame, thread: str = "thread_id") -> DataFrame:
    """Distinct states of several batches as those of all of them."""
    return parts.groupBy(thread, "snapshot_id").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max_by("payload", "payload_order").alias("payload"),
        F.max("payload_order").alias("payload_order"),
    )


def numbered(merged: DataFrame, thread: str = "thread_id") -> DataFrame:
    """Distinct states with their version and parent."""
    placed = row_numbers(merged, [thread], ["first_at", "snapshot_id"], "version")
    linked = sliding(placed, [thread], "version", 1, {"_parent": F.first("snapshot_id")})
    parent = F.when(F.col("version") > 1, F.col("_parent"))
    return linked.select(thread, "snapshot_id", "version", parent.alias("parent_id"), "first_at", "last_at", "payload", "payload_order")


def latest_snapshot(versions: DataFrame, thread: str = "thread_id") -> DataFrame:
    others = [c for c in versions.columns if c != thread]
    newest = F.max_by(F.struct(*others), F.struct("version", "last_at"))
    return versions.groupBy(thread).agg(newest.alias("s")).select(thread, "s.*")


def snapshot_history(versions: DataFrame, limit: int = 10, thread: str = "thread_id") -> DataFrame:
    """The newest versions of each thread."""
    rank = F.row_number().over(Window.partitionBy(thread).orderBy(F.desc("version"), F.desc("last_at")))
    return versions.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def rollback(versions: DataFrame, targets: DataFrame, at: Column, thread: str = "thread_id") -> DataFrame:
    """Versions with, for each target (thread, snapshot_id), a copy of it as the newest version.

    A target that does not exist changes nothing.
    """
    top = versions.groupBy(thread).agg(F.max("version").alias("_top"))
    copies = versions.join(targets.select(thread, "snapshot_id").distinct(), [thread, "snapshot_id"], "left_semi").join(top, thread)
    turn = F.row_number().over(Window.partitionBy(thread).orderBy("version"))
    marked = copies.select(
        thread,
        # a second target of the thread at the same instant has its number in the id
        F.concat(F.lit("rollback_"), F.unix_seconds(at).cast("string"), F.when(turn > 1, F.concat(F.lit("_"), turn.cast("string"))).otherwise("")).alias("snapshot_id"),
        (F.col("_top") + turn).alias("version"),
        F.lit(None).cast("string").alias("parent_id"),
        at.cast(versions.schema["first_at"].dataType).alias("first_at"),
        at.cast(versions.schema["last_at"].dataType).alias("last_at"),
        "payload",
        F.col("snapshot_id").alias("rolled_back_from"),
        F.col("version").alias("original_version"),
    )
    none = F.lit(None)
    return versions.withColumns({"rolled_back_from": none.cast("string"), "original_version": none.cast("bigint")}).unionByName(marked)


def deliver_messages(messages: DataFrame, limit: int = 10, to: str = "to_agent") -> DataFrame:
    """The oldest messages of each recipient, at most `limit`, in the order sent."""
    rank = F.row_number().over(Window.partitionBy(to).orderBy("sent_at", "message_id"))
    return messages.withColumn("position", rank).where(F.col("position") <= limit)


def retain_snapshots(
    versions: DataFrame, as_of: Column, thread: str = "thread_id", current_hours: int = 24, history_days: int = 7,
    limit: int | None = None,
) -> DataFrame:
    """Drops expired snapshots: the newest lives `current_hours`, older ones `history_days`; at most `limit` per thread, if given."""
    rank = F.row_number().over(Window.partitionBy(thread).orderBy(F.desc("version")))
    ranked = versions.withColumn("_r", rank)
    if limit is not None:
        ranked = ranked.where(F.col("_r") <= limit)
    fresh = F.col("last_at") > as_of - F.expr(f"interval {current_hours} hours")
    recent = F.col("last_at") > as_of - F.expr(f"interval {history_days} days")
    return ranked.where(F.when(F.col("_r") == 1, fresh | recent).otherwise(recent)).withColumn(
        "is_current", (F.col("_r") == 1) & fresh
    ).drop("_r")
