"""Queries that run a stream over the tables to its end, and must give what the batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import slo
from faultline.plans import ingest_queries  # noqa: F401  (registers the SQL used below)
from faultline.plans.ingest_queries import _rule_case
from faultline.plans.registry import SQL, query
from faultline.plans.service_queries import greedy_sql
from faultline.plans.window_queries import ASSESSMENT, CONTEXT, HRS, PATTERN, STEPS, VECTORS, vectors
from faultline.plans.workload import EVT, TASKS_A_CORE, incidents_of, payloads_of, stamp, table
from faultline.session import shared_folder, stable
from faultline.streaming.alerts import alert_states, start_cooldown
from faultline.streaming.ingest import start_ingest
from faultline.streaming.memory import CycleMemory
from faultline.streaming.windows import flush, start_windows, window_reports, window_summaries


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of its files."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source takes folders and patterns, not the name of one file
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/faultline-{name}-{uuid.uuid4().hex[:12]}"


def _pieces(spark: SparkSession, df: DataFrame, root: str, piece: Column) -> DataFrame:
    """`df` as a stream of files, one per micro-batch, in the order of `piece`."""
    for k in sorted(r[0] for r in df.select(piece.alias("p")).distinct().collect()):
        df.where(piece == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def _windows(spark: SparkSession, folder: str) -> str:
    """All windows of the events table, which comes in two pieces: the second is late all over the time covered."""
    root = _place(spark, "windows")
    events = table(spark, folder, "events")
    stream = incidents_of(_pieces(spark, events, root, F.col("event_id") % 2))
    start_windows(stream, root, 3600, ts="ts", every=None).awaitTermination()
    flush(spark, root, 3600)
    return root


@query(
    "stream_window_summary",
    f"""WITH {HRS} SELECT strftime(make_timestamp(batch_id * 3600000000), '%Y-%m-%d %H:%M:%S') AS window_start, service,
      CAST(count AS BIGINT) AS count, dominant_severity, array_to_string(types, ',') AS incident_types, CAST(urgent AS BIGINT) AS urgent
    FROM w1""",
)
def stream_window_summary(spark, folder):
    out = window_summaries(spark, _windows(spark, folder))
    return out.withColumns(
        {"window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), "incident_types": F.array_join("incident_types", ",")}
    )


@query(
    "stream_window_report",
    f"""WITH {HRS}, n AS (SELECT batch_id, string_agg(service || ':' || count || ':' || dominant_severity || ':'
        || array_to_string(types, ','), ';' ORDER BY service) AS events_by_service,
        string_agg(service, ',' ORDER BY service) AS services_affected FROM w1 GROUP BY batch_id)
    SELECT strftime(make_timestamp(batch_id * 3600000000), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(n AS BIGINT) AS event_count,
      CAST(u AS BIGINT) AS urgent_count, {ASSESSMENT} AS overall_assessment, {PATTERN} AS critical_pattern, {STEPS} AS recommended_actions,
      events_by_service, services_affected FROM rep JOIN n USING (batch_id)""",
)
def stream_window_report(spark, folder):
    report = window_reports(spark, _windows(spark, folder), 3600)
    entry = F.transform(
        "events_by_service",
        lambda e: F.concat_ws(":", e["service"], e["count"].cast("string"), e["dominant_severity"], F.array_join(e["incident_types"], ",")),
    )
    return report.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_count", "urgent_count", "overall_assessment",
        "critical_pattern", F.array_join("recommended_actions", "|").alias("recommended_actions"),
        F.array_join(entry, ";").alias("events_by_service"), F.array_join("services_affected", ",").alias("services_affected"),
    )


@query("stream_alert_states", SQL["alert_stalled"])
def stream_alert_states(spark, folder):
    """The step conditions of stalled sources, day after day."""
    root = _place(spark, "states")
    conditions = stable(slo.stalled(incidents_of(table(spark, folder, "events")), "ts", 60, 300, ["source_system"]))
    stream = _pieces(spark, conditions, root, F.floor(F.col("tick") / (7 * 86400)))
    states = alert_states(stream, 600, ["source_system"], expiry=None)
    writer = states.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/_progress")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(states.schema).parquet(f"{root}/out")
    return out.select("source_system", "tick", "breached", "state", "active_since")


@query("stream_ingest_records", SQL["ingest_records"])
def stream_ingest_records(spark, folder):
    root = _place(spark, "ingest")
    start_ingest(payloads_of(incidents_of(_events(spark, folder))), root, None).awaitTermination()
    rec = spark.read.parquet(f"{root}/records")
    return rec.select(
        F.col("record_id").alias("incident_id"), F.col("source").alias("source_system"), F.col("workflow").alias("service"),
        "severity", "incident_type", F.col("status").alias("evaluation_status"), F.col("score").alias("evaluation_score"),
        "suggested_action",
    )


# good events as evaluated records, the neighbours of each among those of earlier cycles, and the context these make
CYCLE = f"""{EVT}, {VECTORS},
up AS (SELECT *, severity IN ('high', 'critical') AS up, event_id % 3 AS cycle FROM good),
ruled AS (SELECT incident_id AS record_id, cycle, service AS workflow, severity, incident_type,
    {_rule_case(0)} AS status, {_rule_case(1, False)} AS score, {_rule_case(2)} AS suggested_action, {_rule_case(3)} AS summary, {_rule_case(4)} AS reasoning FROM up),
pairs AS (SELECT a.record_id AS query_id, b.record_id, round(1 - list_inner_product(x.e, y.e) / (x.n * y.n), 12) AS d
  FROM ruled a JOIN nrm x USING (record_id) JOIN ruled b ON b.cycle < a.cycle JOIN nrm y ON y.record_id = b.record_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, record_id) AS rank FROM pairs QUALIFY rank <= 3),
{CONTEXT}"""


@query(
    "stream_cycle_with_context",
    f"""WITH {CYCLE} SELECT record_id, cycle::BIGINT AS cycle, context IS NOT NULL AS context_used,
      md5(reasoning || CASE WHEN context IS NULL THEN '' ELSE chr(10) || chr(10) || context END) AS reasoning_md5
    FROM ruled LEFT JOIN ctx ON ctx.query_id = ruled.record_id""",
)
def stream_cycle_with_context(spark, folder):
    """Three cycles over a third of the events each; every evaluation is told of its neighbours in the cycles before."""
    root = _place(spark, "context")
    events = table(spark, folder, "events")
    # a piece is one file, which one task reads: its rows go to all cores before payloads are made of them
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    stream = payloads_of(incidents_of(_pieces(spark, events, root, F.col("event_id") % 3).repartition(tasks)))
    stored = vectors(spark, folder)
    memory = CycleMemory(spark, root, lambda records: records.select("record_id").join(stored, "record_id"))
    start_ingest(stream, root, None, memory=memory).awaitTermination()
    rec = spark.read.parquet(f"{root}/records")
    return rec.select("record_id", F.col("batch_id").cast("bigint").alias("cycle"), "context_used", F.md5("reasoning").alias("reasoning_md5"))


@query("stream_cooldown_alerts", greedy_sql("event_type", "1 HOUR"))
def stream_cooldown_alerts(spark, folder):
    root = _place(spark, "cooldown")
    alerts = incidents_of(_events(spark, folder)).select(
        F.col("event_type").alias("name"), "ts", F.col("record_id").alias("alert_id")
    )
    start_cooldown(alerts, root, 3600, None).awaitTermination()
    fired = spark.read.parquet(f"{root}/fired")
    return fired.select("name", stamp("ts").alias("fired"), F.col("alert_id").alias("record_id"))
