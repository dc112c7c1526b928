"""Cooldown and hold-for alerts over a stream.

`alert_states` keeps, in Spark's own state store, when the condition of a series began to hold, for the series where it holds
now and no longer than `expiry` after it was last seen. The other functions work per micro-batch:

State is a small table (a row per alert name, or per series) in the shared folder, one version per
micro-batch: batch n reads version n - 1 and writes version n, so a batch that runs again after a failure
gives the same rows. Within a batch the work is the batch operator, so a hot name is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from faultline.operators.cooldown import hold_off
from faultline.operators.slo import TICK, alert_state


def _state(df: DataFrame, root: str, batch_id: int) -> DataFrame | None:
    """The newest state before this batch."""
    if batch_id == 0:
        return None
    return df.sparkSession.read.parquet(f"{root}/state/batch_id={batch_id - 1}")


def cooldown_batch(alerts: DataFrame, fired_before: DataFrame | None, seconds: float) -> tuple[DataFrame, DataFrame]:
    """(alerts that fire, last firing time per name) for new alerts (name, ts, alert_id).

    The last firing of each name takes part as a row of its own, and alerts older than it are in its hold.
    """
    rows = alerts.select("name", "ts", F.col("alert_id").cast("string").alias("alert_id"))
    if fired_before is not None:
        last = fired_before.select("name", F.col("ts").alias("_last"))
        fresh = rows.join(last, "name", "left").where(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last")
        # an empty id is less than all others, so the known firing wins its instant
        rows = fresh.unionByName(fired_before.select("name", "ts", F.lit("").alias("alert_id")))
    fired = hold_off(rows, "name", "ts", "alert_id", seconds)
    return fired.where(F.col("alert_id") != ""), fired.groupBy("name").agg(F.max("ts").alias("ts"))


def start_cooldown(alerts: DataFrame, root: str, seconds: float = 60, every: int | None = 10) -> StreamingQuery:
    """Alerts (name, ts, alert_id) in order of time -> the ones that fire, under root/fired."""

    def run(df: DataFrame, batch_id: int) -> None:
        fired, state = cooldown_batch(df, _state(df, root, batch_id), seconds)
        fired.write.mode("overwrite").parquet(f"{root}/fired/batch_id={batch_id}")
        state.write.mode("overwrite").parquet(f"{root}/state/batch_id={batch_id}")

    return _start(alerts, run, root, every)


def alert_state_batch(conditions: DataFrame, before: DataFrame | None, hold: int, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(states of the new steps, last state per series): a run that began in an earlier batch keeps its start."""
    states = alert_state(conditions, hold, by)
    if before is not None:
        known = before.select(*by, F.col("active_since").alias("_since"))
        order = Window.partitionBy(*by).orderBy(TICK).rowsBetween(Window.unboundedPreceding, 0)
        unbroken = F.min(F.col("breached").cast("int")).over(order) == 1
        joined = states.withColumn("_unbroken", unbroken).join(known, list(by), "left")
        since = F.when(F.col("_unbroken"), F.coalesce("_since", "active_since")).otherwise(F.col("active_since"))
        joined = joined.withColumn("active_since", since)
        firing = F.when(F.col(TICK) - F.col("active_since") >= hold, "firing").otherwise("pending")
        states = joined.withColumn("state", F.when(F.col("breached"), firing).otherwise("inactive")).drop("_since", "_unbroken")
    last = states.groupBy(*by).agg(F.max_by("active_since", TICK).alias("active_since"))
    if before is not None:
        # series without a step in this batch stay as they are
        last = last.unionByName(before.select(*by, "active_since").join(last, list(by), "left_anti"))
    return states, last


class HoldFor(StatefulProcessor):
    """States of one series, from the start of its unbroken run of true steps."""

    def __init__(self, by: Sequence[str], hold: int, expiry: int | None):
        self.by, self.hold, self.expiry = list(by), hold, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        # no entry: the condition did not hold at the last step
        self.since = handle.getValueState("since", "since long", ttlDurationMs=None if self.expiry is None else 1000 * self.expiry)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # the steps of one series in one micro-batch: as many as the time it covers has
        steps = pd.concat(list(rows)).sort_values(TICK, kind="stable")
        since = self.since.get()[0] if self.since.exists() else None
        states, starts = [], []
        for tick, holds in zip(steps[TICK], steps["breached"], strict=True):
            since = (tick if since is None else since) if holds else None
            states.append("inactive" if since is None else "firing" if tick - since >= self.hold else "pending")
            starts.append(since)
        if since is None:
            self.since.clear()
        else:
            # also renews the time it is kept
            self.since.update((int(since),))
        steps["state"], steps["active_since"] = states, pd.array(starts, dtype="Int64")
        yield steps[[*self.by, TICK, "breached", "state", "active_since"]]

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRY = 7 * 86400


def alert_states(conditions: DataFrame, hold: int, by: Sequence[str] = (), expiry: int | None = EXPIRY) -> DataFrame:
    """A stream of step conditions (by..., tick, breached), in order of time per series -> the states, as a stream.

    Needs the RocksDB state store, which is set on the session here. With an expiry (seconds since a series was last seen)
    the store asks for batches without end, so a run over what is there now, `availableNow`, takes None.
    """
    conditions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kept = StructType([conditions.schema[c] for c in (*by, TICK, "breached")])
    schema = StructType([*kept.fields, StructField("state", StringType()), StructField("active_since", LongType())])
    # a series without labels is one key
    keys = list(by) or ["_all"]
    steps = conditions.select(*by, TICK, "breached", *([] if by else [F.lit("all").alias("_all")]))
    return steps.groupBy(*keys).transformWithStateInPandas(
        HoldFor(by, hold, expiry), schema, "Append", "None" if expiry is None else "ProcessingTime"
    )


def start_alert_states(conditions: DataFrame, root: str, hold: int, by: Sequence[str], every: int | None = 10) -> StreamingQuery:
    """Step conditions (by..., tick, breached) in order of time -> alert states, under root/states."""

    def run(df: DataFrame, batch_id: int) -> None:
        states, last = alert_state_batch(df, _state(df, root, batch_id), hold, by)
        states.write.mode("overwrite").parquet(f"{root}/states/batch_id={batch_id}")
        last.write.mode("overwrite").parquet(f"{root}/state/batch_id={batch_id}")

    return _start(conditions, run, root, every)


def _start(df: DataFrame, run, root: str, every: int | None) -> StreamingQuery:
    trigger = {"availableNow": True} if every is None else {"processingTime": f"{every} seconds"}
    return df.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/_progress").trigger(**trigger).start()
