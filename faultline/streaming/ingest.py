"""The continuous cycle: read payloads, evaluate them, retrieve context, store, act."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.evaluate import cycle_summary
from faultline.operators.ingest import ingest_normalized
from faultline.operators.normalize import incident_type_from_error, normalize
from faultline.operators.similarity import rag_evaluate, retrieval_context
from faultline.session import stable
from faultline.sources.buffer import messages
from faultline.sources.payloads import with_positions
from faultline.streaming.memory import CycleMemory

MIN_INTERVAL, MAX_INTERVAL = 1, 60
FEW = 10_000  # payloads that are not worth a shuffle
TASKS_A_CORE = 3


def _write(df: DataFrame, root: str, name: str, batch_id: int) -> None:
    """One folder per micro-batch, overwritten when a batch is run again."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def _dealt(payloads: DataFrame) -> DataFrame:
    """The payloads over all cores: a micro-batch of few files comes in few tasks, and parsing is most of the work.

    A small micro-batch stays as it comes; to see that, a task makes no more than FEW payloads.
    """
    cores = payloads.sparkSession.sparkContext.defaultParallelism
    if payloads.rdd.getNumPartitions() >= cores or payloads.limit(FEW + 1).count() <= FEW:
        return payloads
    return payloads.repartition(TASKS_A_CORE * cores)


def run_cycle(
    payloads: DataFrame, batch_id: int, root: str, retrieve: Callable[[DataFrame], DataFrame] | None = None, memory: CycleMemory | None = None
) -> None:
    """One cycle over one set of payloads: records, actions, quarantine, buffer messages and the summary.

    `retrieve` maps the records to their neighbours (query_id, record_id, ...) among what earlier cycles
    stored; it runs before the records of this cycle are written, so none finds itself. With a `memory` the neighbours are
    looked up there, their evaluations become context in the reasoning of this cycle's, and its records are added after.
    """
    if {"file", "split"} <= set(payloads.columns):
        payloads = with_positions(payloads)
    normalized = normalize(_dealt(payloads)).persist()
    done = ingest_normalized(normalized)
    # the first to be written, so that each payload is parsed once: jobs of several stages would do so side by side
    _write(done.quarantine, root, "quarantine", batch_id)
    records = done.records.withColumn("cycle_id", F.lit(batch_id)).persist()
    actions = done.actions().withColumn("cycle_id", F.lit(batch_id)).persist()
    hits = records.select("cycle_id").limit(0)
    plain = records
    found = memory.recall(records, batch_id) if memory is not None else None
    if found is not None:
        found = stable(found)
        records = rag_evaluate(records, retrieval_context(found)).persist()
        hits = found.select("query_id").distinct().select(F.lit(batch_id).alias("cycle_id"))
    elif memory is not None:
        records = records.withColumn("context_used", F.lit(False))
    if retrieve is not None:
        hits = retrieve(records).select("query_id").distinct().select(F.lit(batch_id).alias("cycle_id"))
    _write(cycle_summary(records, actions, hits).drop("cycle_id"), root, "cycles", batch_id)
    _write(records.drop("cycle_id"), root, "records", batch_id)
    _write(actions.drop("cycle_id"), root, "actions", batch_id)
    typed = done.events.withColumn("incident_type", incident_type_from_error(F.col("error_type")))
    _write(messages(typed), root, "buffer", batch_id)
    if memory is not None:
        memory.remember(plain, batch_id)
    for df in (actions, records, plain, normalized):
        df.unpersist()


def start_ingest(
    payloads: DataFrame, root: str, seconds: int | None = 10, retrieve: Callable[[DataFrame], DataFrame] | None = None,
    memory: CycleMemory | None = None,
) -> StreamingQuery:
    """Run a cycle every `seconds`; None takes what is there now and stops."""
    if seconds is not None and not MIN_INTERVAL <= seconds <= MAX_INTERVAL:
        raise ValueError(f"the interval must be {MIN_INTERVAL} to {MAX_INTERVAL} seconds")
    writer = payloads.writeStream.foreachBatch(lambda df, batch_id: run_cycle(df, batch_id, root, retrieve, memory))
    writer = writer.option("checkpointLocation", f"{root}/_progress")
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()
