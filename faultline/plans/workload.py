"""The general-purpose tables read as incident data.

Each function has an SQL twin (the upper-case texts) that derives the same columns straight from the
tables, without going through payloads or operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import fixed
from faultline.functions.text import lookup
from faultline.operators.evaluate import evaluate_incidents, score_status, tool_score
from faultline.operators.normalize import incident_type_from_error

TASKS_A_CORE = 3
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_STAMP = "%Y-%m-%d %H:%M:%S.%f"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stamp(column: Column | str) -> Column:
    return F.date_format(column, STAMP)


def sql_stamp(expression: str) -> str:
    return f"strftime({expression}, '{SQL_STAMP}')"


ERROR_TYPE = {
    "error": "connection_refused",
    "purchase": "schema_validation_failed",
    "view": "semantic_drift_detected",
    "click": "latency_spike",
}

# --- incidents ----------------------------------------------------------------------------------
INC = """
inc AS (
  SELECT event_id, ts, user_id, event_type, value, props,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
    CASE WHEN value >= 147 THEN 'critical' WHEN value >= 69 THEN 'high'
         WHEN value >= 14.5 THEN 'medium' ELSE 'low' END AS severity,
    CASE event_type WHEN 'error' THEN 'connection_refused' WHEN 'purchase' THEN 'schema_validation_failed'
         WHEN 'view' THEN 'semantic_drift_detected' WHEN 'click' THEN 'latency_spike' END AS error_type,
    CASE event_type WHEN 'purchase' THEN 'schema_error' WHEN 'view' THEN 'semantic_error'
         WHEN 'click' THEN 'degradation' ELSE 'technical_error' END AS incident_type,
    CASE event_id % 3 WHEN 0 THEN 'spring-boot' WHEN 1 THEN 'kafka' ELSE 'generic' END AS source_system,
    CASE event_id % 3 WHEN 0 THEN 'service' WHEN 1 THEN 'stream' ELSE 'external' END AS stage,
    'svc-' || (user_id % 40) AS service,
    'wf-' || (user_id % 7) AS workflow,
    event_type || ' event ' || event_id || ' on svc-' || (user_id % 40) AS message,
    'rec_' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS record_id
  FROM events)"""


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """One incident per row of `events`."""
    return incidents_of(table(spark, folder, "events"))


def incidents_of(events: DataFrame) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    value, source = F.col("value"), F.col("event_id") % 3
    severity = (
        F.when(value >= 147, "critical").when(value >= 69, "high").when(value >= 14.5, "medium").otherwise("low")
    )
    service = F.concat(F.lit("svc-"), F.col("user_id") % 40)
    e = e.withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("bigint"),
            "severity": severity,
            "error_type": lookup(F.col("event_type"), ERROR_TYPE),
            "source_system": F.when(source == 0, "spring-boot").when(source == 1, "kafka").otherwise("generic"),
            "service": service,
            "workflow": F.concat(F.lit("wf-"), F.col("user_id") % 7),
            "message": F.concat("event_type", F.lit(" event "), "event_id", F.lit(" on "), service),
            "record_id": F.concat(F.lit("rec_"), F.lpad(F.col("event_id").cast("string"), 12, "0")),
        }
    )
    return e.withColumns(
        {
            "incident_type": incident_type_from_error(F.col("error_type")),
            "stage": lookup(F.col("source_system"), fixed.STAGE_OF_SOURCE),
        }
    )


# --- evaluation records --------------------------------------------------------------------------
REC = INC + """,
tool AS (
  SELECT inc.*, k % 4 AS tools,
    CASE severity WHEN 'low' THEN 20 WHEN 'medium' THEN 40 WHEN 'high' THEN 70 ELSE 90 END AS base
  FROM inc),
scored AS (
  SELECT *,
    CASE WHEN tools = 0 THEN greatest(10, base - 20) WHEN tools > 2 THEN least(95, base + 15) ELSE base END AS tool_score,
    severity IN ('high', 'critical') AS upper_band
  FROM tool),
rec AS (
  SELECT record_id, ts AS received_at, workflow, severity, incident_type, stage, service, message, event_id, user_id, value, k,
    source_system AS source, source_system AS category, event_type, error_type, tools,
    CASE WHEN event_type = 'signup'
           THEN CASE WHEN tool_score <= 40 THEN 'ok' WHEN tool_score <= 80 THEN 'needs_attention' ELSE 'critical' END
         WHEN incident_type = 'schema_error' THEN 'critical'
         WHEN incident_type = 'technical_error' AND upper_band THEN 'critical'
         ELSE 'needs_attention' END AS status,
    CAST(CASE WHEN event_type = 'signup' THEN tool_score
         WHEN incident_type = 'schema_error' THEN CASE WHEN upper_band THEN 85 ELSE 70 END
         WHEN incident_type = 'technical_error' THEN CASE WHEN upper_band THEN 80 ELSE 60 END
         WHEN incident_type = 'semantic_error' THEN CASE WHEN upper_band THEN 65 ELSE 50 END
         ELSE CASE WHEN upper_band THEN 70 ELSE 55 END END AS INTEGER) AS score,
    CASE WHEN event_type = 'signup' THEN NULL
         WHEN incident_type = 'schema_error' THEN 'inspect_schema'
         WHEN incident_type = 'technical_error' AND upper_band THEN 'check_provider'
         WHEN incident_type = 'semantic_error' THEN 'inspect_prompt'
         ELSE 'monitor' END AS suggested_action
  FROM scored)"""


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation records: sign-ups are scored by tool choice, all other incidents by the rule table."""
    base = incidents(spark, folder).select(
        "record_id", F.col("ts").alias("received_at"), "workflow", "severity", "incident_type", "stage", "service",
        "message", "event_id", "user_id", "value", "k", F.col("source_system").alias("source"),
        F.col("source_system").alias("category"), "event_type", "error_type", (F.col("k") % 4).alias("tools"),
    )
    ruled = evaluate_incidents(base)
    by_tool = F.col("event_type") == "signup"
    score = tool_score(F.col("severity"), F.col("tools"))
    return ruled.withColumns(
        {
            "status": F.when(by_tool, score_status(score)).otherwise(F.col("status")),
            "score": F.when(by_tool, score).otherwise(F.col("score")).cast("int"),
            "suggested_action": F.when(~by_tool, F.col("suggested_action")),
        }
    )


# --- raw payloads ---------------------------------------------------------------------------------
def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Raw JSON texts in the three source shapes, some cut short and some with a blank service."""
    return payloads_of(incidents_of(spread(table(spark, folder, "events"))))


def spread(rows: DataFrame) -> DataFrame:
    """The same rows dealt evenly over all cores: a file that is small for the work on its rows is read by few tasks."""
    tasks = max(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return rows.repartition(tasks, *rows.columns)


def payloads_of(e: DataFrame) -> DataFrame:
    number, user, service = F.col("event_id"), F.col("user_id"), F.col("service")
    blank, none = (number % 89) == 0, F.lit(None).cast("string")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    given = F.when(blank, F.lit(" ")).otherwise(service)
    jvm = F.to_json(F.struct(
        F.when(number % 2 == 0, F.concat(iso, F.lit("Z"))).alias("timestamp"),
        F.when(number % 2 == 1, F.concat(iso, F.lit("Z"))).alias("@timestamp"),
        lookup(F.col("severity"), {"critical": "FATAL", "high": "ERROR", "medium": "warn", "low": "debug"}).alias("level"),
        F.when(blank | (user % 2 == 0), given).alias("service"),
        F.concat(F.lit("com.example."), service, F.lit(".Handler")).alias("logger"),
        F.col("message").alias("message"),
        F.concat(F.lit("org.app."), "error_type").alias("exception"),
        F.concat(F.lit("/api/"), "event_type").alias("requestUri"),
    ))
    kafka = F.to_json(F.struct(
        F.concat("event_type", F.lit("-events")).alias("topic"),
        F.unix_millis("ts").alias("timestamp"),
        F.upper("severity").alias("severity"),
        F.when(blank | (user % 3 == 0), F.struct(given.alias("service"))).alias("headers"),
        F.when(user % 3 == 1, F.concat(service, F.lit("-consumer"))).alias("consumer_group"),
        F.when(user % 3 == 2, F.concat(service, F.lit("-group"))).alias("groupId"),
        lookup(F.col("event_type"), {
            "purchase": "schema registry deserialization failure", "click": "request timed out",
            "error": "consumer lag exceeded threshold", "view": "broker unreachable"}).alias("error"),
    ))
    hook = F.to_json(F.struct(
        F.when(user % 3 == 0, F.col("severity")).alias("severity"),
        F.when(user % 3 == 1, F.when(F.col("severity") == "high", "Error").otherwise(F.col("severity"))).alias("level"),
        F.when(user % 3 == 2, F.col("severity")).alias("priority"),
        F.concat(F.lit("  "), "message").alias("summary"),
        F.when(blank, F.lit("  ")).otherwise(F.concat(service, F.lit(" "))).alias("component"),
        F.when(number % 5 != 0, iso).alias("fired_at"),
        F.when(number % 5 == 0, F.unix_millis("ts")).alias("time"),
        F.col("error_type").alias("alert_name"),
        F.concat(F.lit("/hook/"), "event_type").alias("url"),
        none.alias("body"),
    ))
    raw = F.when(F.col("source_system") == "spring-boot", jvm).when(F.col("source_system") == "kafka", kafka)
    raw = raw.otherwise(hook)
    return e.select(
        F.col("record_id").alias("incident_id"),
        "source_system",
        F.expr("ts + interval 2 seconds").alias("arrival_ts"),
        _cut_some(raw, number).alias("raw"),
    )


def _cut_some(raw: Column, number: Column) -> Column:
    return F.when(number % 97 == 0, F.substring(raw, F.lit(1), F.length(raw) - 5)).otherwise(raw)


# what the normalizers must find in those payloads
EVT = INC + """,
evt AS (
  SELECT record_id AS incident_id, source_system, severity, event_id,
    CASE WHEN source_system = 'generic' AND event_id % 89 = 0 THEN 'unknown-service' ELSE service END AS service,
    CASE WHEN source_system <> 'kafka' THEN message
         WHEN event_type = 'purchase' THEN 'schema registry deserialization failure'
         WHEN event_type = 'click' THEN 'request timed out'
         WHEN event_type = 'error' THEN 'consumer lag exceeded threshold'
         WHEN event_type = 'view' THEN 'broker unreachable'
         ELSE 'Kafka event on topic signup-events' END AS message,
    CASE WHEN source_system = 'kafka' THEN date_trunc('millisecond', ts)
         WHEN source_system = 'generic' AND event_id % 5 = 0 THEN ts + INTERVAL 2 SECOND ELSE ts END AS timestamp,
    CASE WHEN source_system <> 'kafka' THEN error_type
         WHEN event_type = 'purchase' THEN 'schema_validation_failed'
         WHEN event_type = 'click' THEN 'timeout_exceeded'
         WHEN event_type = 'error' THEN 'consumer_lag'
         WHEN event_type = 'view' THEN 'technical_error' END AS error_type,
    CASE source_system WHEN 'kafka' THEN event_type || '-events' WHEN 'generic' THEN '/hook/' || event_type
         ELSE '/api/' || event_type END AS affected_resource,
    ts + INTERVAL 2 SECOND AS arrival_ts,
    CASE WHEN event_id % 97 = 0 THEN 'payload is not a JSON object'
         WHEN event_id % 89 = 0 AND source_system <> 'generic' THEN 'service must not be blank' ELSE '' END AS reasons
  FROM inc),
good AS (
  SELECT *, CASE WHEN error_type = 'schema_validation_failed' THEN 'schema_error'
       WHEN error_type = 'semantic_drift_detected' THEN 'semantic_error'
       WHEN error_type IN ('latency_spike', 'timeout_exceeded') THEN 'degradation' ELSE 'technical_error' END AS incident_type,
    CASE source_system WHEN 'spring-boot' THEN 'service' WHEN 'kafka' THEN 'stream' ELSE 'external' END AS stage
  FROM evt WHERE reasons = '')"""
