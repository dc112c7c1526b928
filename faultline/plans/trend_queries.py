"""Queries: stores, buffer, counts and trends."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faultline.operators import evaluate as ev
from faultline.operators import normalize as nz
from faultline.operators import trends as tr
from faultline.plans.registry import query
from faultline.plans.workload import EVT, INC, REC, incidents, payloads, records, sql_stamp, stamp, table
from faultline.sources import buffer as bf
from faultline.sources import payloads as pl
from faultline.sources import store as st
from faultline.session import shared_folder


# --- buffer ---------------------------------------------------------------------------------------
def _buffer(spark, folder):
    """Messages of all good events; some without data, some with broken JSON."""
    good = nz.accepted(nz.normalize(payloads(spark, folder)))
    typed = good.withColumn("incident_type", nz.incident_type_from_error(F.col("error_type")))
    number = F.col("seq").substr(5, 12).cast("bigint")
    cut = F.substring("data", F.lit(1), F.length("data") - 1)
    data = F.when(number % 31 == 0, F.lit(None)).when(number % 37 == 0, cut).otherwise(F.col("data"))
    return bf.messages(typed).withColumn("data", data)


BUF = EVT + """,
buf AS (SELECT *, CASE WHEN event_id % 31 = 0 OR event_id % 37 = 0 THEN 0 ELSE 1 END AS readable FROM good)"""


@query(
    "append_stream",
    f"""WITH {EVT} SELECT incident_id AS seq, {sql_stamp('arrival_ts')} AS arrived,
      '{{"incident_id":"' || incident_id || '","source_system":"' || source_system || '","severity":"' || severity
      || '","service":"' || service || '","message":"' || message || '","timestamp":"'
      || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","incident_type":"' || incident_type || '","error_type":"'
      || coalesce(error_type, '') || '","affected_resource":"' || affected_resource || '"}}' AS data FROM good""",
)
def append_stream(spark, folder):
    good = nz.accepted(nz.normalize(payloads(spark, folder)))
    typed = good.withColumn("incident_type", nz.incident_type_from_error(F.col("error_type")))
    return bf.messages(typed).select("seq", stamp("arrival_ts").alias("arrived"), "data")


@query(
    "scan_window",
    f"""WITH {BUF} SELECT incident_id, service, severity, incident_type, {sql_stamp('arrival_ts')} AS arrived FROM buf
    WHERE readable = 1 AND arrival_ts BETWEEN TIMESTAMP '2024-01-15 11:00:00' AND TIMESTAMP '2024-01-15 12:00:00'""",
)
def scan_window(spark, folder):
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    rows = bf.scan_window(_buffer(spark, folder), as_of, 3600)
    return rows.select("incident_id", "service", "severity", "incident_type", stamp("arrival_ts").alias("arrived"))


@query(
    "cap_buffer",
    f"""WITH {BUF} SELECT incident_id AS seq, {sql_stamp('arrival_ts')} AS arrived FROM buf
    ORDER BY arrival_ts DESC, incident_id DESC LIMIT 10000""",
)
def cap_buffer(spark, folder):
    return bf.cap_buffer(_buffer(spark, folder)).select("seq", stamp("arrival_ts").alias("arrived"))


@query(
    "stream_status",
    f"""WITH {BUF} SELECT 'stream:incidents' AS key, CAST(count(*) AS BIGINT) AS length, true AS available,
      {sql_stamp('min(arrival_ts)')} AS oldest, {sql_stamp('max(arrival_ts)')} AS newest FROM buf""",
)
def stream_status(spark, folder):
    status = bf.stream_status(_buffer(spark, folder))
    return status.withColumns({"oldest": stamp("oldest"), "newest": stamp("newest")})


# --- stores ---------------------------------------------------------------------------------------
def _actions(spark, folder):
    return ev.dispatch_actions(records(spark, folder))


def _tool_log(spark, folder):
    rec = records(spark, folder).where(F.col("event_type") == "signup")
    return rec.select(
        F.concat(F.lit("tlog_"), F.sha2("record_id", 256)).alias("log_id"), "record_id",
        F.col("received_at").alias("executed_at"), F.col("tools").alias("total_tools"),
        F.least("tools", F.lit(2)).alias("successful_tools"), "workflow", "severity",
    )


ACT = REC + """,
act AS (SELECT record_id, 'act_' || sha256(record_id) AS action_id, received_at AS executed_at,
  suggested_action AS action_type, 'success' AS outcome, workflow, severity
  FROM rec WHERE status <> 'ok' AND suggested_action IS NOT NULL),
tl AS (SELECT 'tlog_' || sha256(record_id) AS log_id, record_id, received_at AS executed_at,
  tools AS total_tools, least(tools, 2) AS successful_tools, workflow, severity FROM rec WHERE event_type = 'signup')"""


def _stored(spark, write, rows, name):
    """What is read back from a table that `write` made."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write(rows, path)
    return st.read_table(spark, path)


@query(
    "store_evaluations",
    f"""WITH {REC} SELECT record_id, {sql_stamp('received_at')} AS received, workflow, severity, status, score, workflow AS inner_workflow,
      status AS inner_status, strftime(received_at, '%Y-%m-%d') AS day FROM rec""",
)
def store_evaluations(spark, folder):
    back = _stored(spark, st.write_evaluations, records(spark, folder), "evaluations")
    return back.select(
        "record_id", stamp("received_at").alias("received"), "workflow", "severity", "status", "score",
        F.col("incident.workflow").alias("inner_workflow"), F.col("result.status").alias("inner_status"), F.col("date").cast("string").alias("day"),
    )


@query("store_actions", f"WITH {ACT} SELECT action_id, record_id, {sql_stamp('executed_at')} AS executed, action_type, workflow, severity FROM act")
def store_actions(spark, folder):
    back = _stored(spark, st.write_actions, _actions(spark, folder), "actions")
    return back.select("action_id", "record_id", stamp("executed_at").alias("executed"), "action_type", "workflow", "severity")


@query("store_tool_calls", f"WITH {ACT} SELECT log_id, record_id, {sql_stamp('executed_at')} AS executed, total_tools, successful_tools FROM tl")
def store_tool_calls(spark, folder):
    back = _stored(spark, st.write_tool_calls, _tool_log(spark, folder), "tool-calls")
    return back.select("log_id", "record_id", stamp("executed_at").alias("executed"), "total_tools", "successful_tools")


@query(
    "list_incidents",
    f"""WITH {REC} SELECT record_id, {sql_stamp('received_at')} AS received, workflow, status, score FROM rec
    WHERE workflow = 'wf-3' AND status = 'critical' ORDER BY received_at DESC, record_id DESC LIMIT 50""",
)
def list_incidents(spark, folder):
    rows = st.list_incidents(records(spark, folder), "wf-3", "critical")
    return rows.select("record_id", stamp("received_at").alias("received"), "workflow", "status", "score")


@query(
    "list_incident_records",
    f"""WITH {REC} SELECT record_id, {sql_stamp('received_at')} AS received, workflow, stage, incident_type, severity, source, message, status, score,
      CAST(NULL AS VARCHAR) AS missing FROM rec WHERE status = 'critical' AND event_type <> 'signup' ORDER BY received_at DESC, record_id DESC LIMIT 100""",
)
def list_incident_records(spark, folder):
    """Records written to the store and read back with the incident and the result as they were."""
    ruled = ev.evaluate_incidents(records(spark, folder).where(F.col("event_type") != "signup").drop("status", "score", "suggested_action", "summary", "reasoning", "tags"))
    back = _stored(spark, st.write_evaluations, ruled, "incident-records")
    rows = st.incident_records(st.list_incidents(back, status="critical", limit=100))
    one, result = "incident", "result"
    return rows.select(
        "record_id", stamp("received_at").alias("received"), *[f"{one}.{c}" for c in ("workflow", "stage", "incident_type", "severity", "source", "message")],
        *[f"{result}.{c}" for c in ("status", "score")], F.try_element_at(f"{result}.tags", F.lit(9)).alias("missing"),
    )


@query(
    "list_actions",
    f"""WITH {ACT} SELECT action_id, {sql_stamp('executed_at')} AS executed, action_type FROM act
    WHERE action_type = 'monitor' ORDER BY executed_at DESC, action_id DESC LIMIT 50""",
)
def list_actions(spark, folder):
    rows = st.list_actions(_actions(spark, folder), action_type="monitor")
    return rows.select("action_id", stamp("executed_at").alias("executed"), "action_type")


@query(
    "list_tool_calls",
    f"""WITH {ACT} SELECT log_id, record_id, total_tools, successful_tools FROM tl
    WHERE workflow = 'wf-1' ORDER BY executed_at DESC, log_id DESC LIMIT 50""",
)
def list_tool_calls(spark, folder):
    return st.list_tool_calls(_tool_log(spark, folder), "wf-1").select("log_id", "record_id", "total_tools", "successful_tools")


@query(
    "analytics_rows",
    f"""WITH {REC} SELECT record_id, {sql_stamp('received_at')} AS received_at, workflow, severity, status, score,
      suggested_action FROM rec""",
)
def analytics_rows(spark, folder):
    return st.analytics_rows(records(spark, folder)).withColumn("received_at", stamp("received_at"))


TRAIL = f"""WITH {ACT} SELECT rec.record_id, rec.status, action_id, action_type, outcome, log_id, total_tools, successful_tools
    FROM rec LEFT JOIN act USING (record_id) LEFT JOIN tl ON tl.record_id = rec.record_id"""


@query("audit_trail", TRAIL)
def audit_trail(spark, folder):
    rec = records(spark, folder).select("record_id", "status")
    return st.audit_trail(rec, _actions(spark, folder), _tool_log(spark, folder))


@query("audit_trail_stored", TRAIL)
def audit_trail_stored(spark, folder):
    """The trail over tables in buckets, the records of which came in two batches."""
    run = uuid.uuid4().hex
    rec = records(spark, folder).select("record_id", "status")
    first = F.pmod(F.xxhash64("record_id"), F.lit(2)) == 0
    parts = {"records": [rec.where(first), rec.where(~first)], "actions": [_actions(spark, folder)], "calls": [_tool_log(spark, folder)]}
    for name, batches in parts.items():
        for batch in batches:
            st.write_bucketed(batch, f"trail_{name}_{run}", f"{shared_folder(spark)}/trail-{run}/{name}")
    return st.stored_audit_trail(*(spark.table(f"trail_{name}_{run}") for name in parts))


@query(
    "split_numeric",
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN lang ELSE CAST(n_chars AS VARCHAR) END AS score
      FROM documents) SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'invalid' ELSE 'valid' END AS part,
      CASE WHEN doc_id % 5 = 0 THEN 0.0 WHEN doc_id % 5 <> 1 THEN CAST(score AS DOUBLE) END AS score FROM t""",
)
def split_numeric(spark, folder):
    doc = F.col("doc_id") % 5
    docs = table(spark, folder, "documents").select(
        "doc_id", F.when(doc == 1, F.col("lang")).when(doc != 0, F.col("n_chars").cast("string")).alias("score")
    )
    valid, invalid = pl.split_numeric(docs, "score")
    return valid.withColumn("part", F.lit("valid")).unionByName(
        invalid.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit("invalid").alias("part"))
    )


# --- counts and trends ------------------------------------------------------------------------------
@query("status_counts", f"WITH {REC} SELECT status, CAST(count(*) AS BIGINT) AS count FROM rec GROUP BY status")
def status_counts(spark, folder):
    return tr.status_counts(records(spark, folder))


@query("severity_counts", f"WITH {REC} SELECT severity, CAST(count(*) AS BIGINT) AS count FROM rec GROUP BY severity")
def severity_counts(spark, folder):
    return tr.severity_counts(records(spark, folder))


@query("average_score", f"WITH {REC} SELECT round_even(sum(score) / count(*), 2) AS average_score FROM rec")
def average_score(spark, folder):
    return tr.average_score(records(spark, folder))


@query(
    "top_actions",
    f"""WITH {REC} SELECT suggested_action, CAST(count(*) AS BIGINT) AS count FROM rec WHERE suggested_action IS NOT NULL
    GROUP BY suggested_action ORDER BY count(*) DESC, min(record_id) LIMIT 5""",
)
def top_actions(spark, folder):
    return tr.top_actions(records(spark, folder))


@query("distinct_workflows", f"WITH {REC} SELECT DISTINCT workflow FROM rec")
def distinct_workflows(spark, folder):
    return tr.distinct_workflows(records(spark, folder))


@query(
    "metrics_summary",
    f"""WITH {REC}, g AS (
      SELECT 'status' AS metric, status AS name, count(*) AS count, min(record_id) AS seen FROM rec GROUP BY status
      UNION ALL SELECT 'severity', severity, count(*), min(record_id) FROM rec GROUP BY severity
      UNION ALL SELECT 'suggested_action', suggested_action, count(*), min(record_id) FROM rec WHERE suggested_action IS NOT NULL GROUP BY suggested_action
      UNION ALL SELECT 'workflow', workflow, count(*), min(record_id) FROM rec GROUP BY workflow
      UNION ALL SELECT 'total', NULL, count(*), NULL FROM rec)
    SELECT metric, name, CAST(count AS BIGINT) AS count,
      CASE WHEN metric = 'total' THEN (SELECT round_even(sum(score) / count(*), 2) FROM rec) END AS average_score,
      CASE WHEN metric = 'suggested_action' AND place <= 5 THEN CAST(place AS INTEGER) END AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY count DESC, seen, name) AS place FROM g)""",
)
def metrics_summary(spark, folder):
    return tr.metrics_summary(records(spark, folder))


@query(
    "daily_score_trend",
    f"""WITH {REC} SELECT strftime(received_at, '%Y-%m-%d') AS date, round_even(sum(score) / count(*), 2) AS avg_score,
      CAST(count(*) AS BIGINT) AS count FROM rec GROUP BY 1""",
)
def daily_score_trend(spark, folder):
    return tr.daily_score_trend(records(spark, folder))


ROLLING = """round_even(sum(score) OVER w / count(*) OVER w, 2) AS rolling_avg"""


@query(
    "rolling_score",
    f"""WITH {REC}, r AS (SELECT record_id, received_at, {ROLLING} FROM rec
      WINDOW w AS (ORDER BY received_at, record_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT record_id, rolling_avg FROM r ORDER BY received_at DESC, record_id DESC LIMIT 10""",
)
def rolling_score(spark, folder):
    return tr.rolling_score(records(spark, folder)).select("record_id", "rolling_avg")


@query(
    "rolling_score_by_workflow",
    f"""WITH {REC}, r AS (SELECT workflow, record_id, {ROLLING},
        row_number() OVER (PARTITION BY workflow ORDER BY received_at DESC, record_id DESC) AS rn FROM rec
      WINDOW w AS (PARTITION BY workflow ORDER BY received_at, record_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT workflow, record_id, rolling_avg FROM r WHERE rn <= 10""",
)
def rolling_score_by_workflow(spark, folder):
    return tr.rolling_score(records(spark, folder), by=["workflow"]).select("workflow", "record_id", "rolling_avg")


@query(
    "severity_distribution",
    f"""WITH {REC} SELECT severity, CAST(count(*) AS BIGINT) AS count,
      round_even(count(*) / (SELECT count(*) FROM rec) * 100, 1) AS pct FROM rec GROUP BY severity""",
)
def severity_distribution(spark, folder):
    return tr.severity_distribution(records(spark, folder))


RATES = "SELECT workflow, count(*) AS total, count(*) FILTER (status <> 'ok') AS failed FROM rec GROUP BY workflow"


@query(
    "workflow_failure_rate",
    f"""WITH {REC}, f AS ({RATES}) SELECT workflow, CAST(total AS BIGINT) AS total, CAST(failed AS BIGINT) AS failed,
      round_even(failed / total, 4) AS failure_rate FROM f""",
)
def workflow_failure_rate(spark, folder):
    return tr.workflow_failure_rate(records(spark, folder))


@query("failure_rate_percent", f"WITH {REC}, f AS ({RATES}) SELECT workflow, round_even(failed / total, 4) * 100 AS failure_rate_percent FROM f")
def failure_rate_percent(spark, folder):
    return tr.failure_rate_percent(records(spark, folder))


@query(
    "status_shares",
    f"""WITH {REC} SELECT status, CAST(count(*) AS BIGINT) AS count, count(*) / (SELECT count(*) FROM rec) AS share
    FROM rec GROUP BY status""",
)
def status_shares(spark, folder):
    return tr.status_shares(records(spark, folder))


@query(
    "analytics_report",
    f"""WITH {REC}, f AS ({RATES})
    SELECT 'severity' AS part, severity AS name, CAST(count(*) AS BIGINT) AS count,
      round_even(count(*) / (SELECT count(*) FROM rec) * 100, 1) AS value FROM rec GROUP BY severity
    UNION ALL SELECT 'day', strftime(received_at, '%Y-%m-%d'), count(*), round_even(sum(score) / count(*), 2) FROM rec GROUP BY 2
    UNION ALL SELECT 'workflow', workflow, total, round_even(failed / total, 4) FROM f
    UNION ALL SELECT 'total', NULL, count(*), NULL FROM rec
    UNION ALL SELECT 'rolling', record_id, NULL, rolling_avg FROM (SELECT * FROM (SELECT record_id, received_at, {ROLLING} FROM rec
      WINDOW w AS (ORDER BY received_at, record_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) ORDER BY received_at DESC, record_id DESC LIMIT 10)""",
)
def analytics_report(spark, folder):
    parts = tr.analytics_report(records(spark, folder))
    none = F.lit(None).cast("string")
    return (
        parts["severity_distribution"].select(F.lit("severity").alias("part"), F.col("severity").alias("name"), "count", F.col("pct").alias("value"))
        .unionByName(parts["daily_score_trend"].select(F.lit("day").alias("part"), F.col("date").alias("name"), "count", F.col("avg_score").alias("value")))
        .unionByName(parts["workflow_failure_rate"].select(F.lit("workflow").alias("part"), F.col("workflow").alias("name"), F.col("total").alias("count"), F.col("failure_rate").alias("value")))
        .unionByName(parts["rows"].agg(F.count("*").alias("count")).select(F.lit("total").alias("part"), none.alias("name"), "count", F.lit(None).cast("double").alias("value")))
        .unionByName(parts["rolling_score"].select(F.lit("rolling").alias("part"), F.col("record_id").alias("name"), F.lit(None).cast("bigint").alias("count"), F.col("rolling_avg").alias("value")))
    )


DETAIL = """'Prompt review ticket created for workflow ''' || workflow || ''' (category: ' || category"""


@query(
    "recent_actions_table",
    f"""WITH {ACT}, d AS (SELECT act.*, CASE action_type
        WHEN 'monitor' THEN 'Enhanced monitoring activated for workflow ''' || act.workflow || ''' (stage: ' || stage || '). Elevated alert'
        WHEN 'inspect_prompt' THEN 'Prompt review ticket created for workflow ''' || act.workflow || ''' (category: ' || category
        WHEN 'inspect_schema' THEN 'Schema review ticket created for workflow ''' || act.workflow || ''' (stage: ' || stage || ', '
        ELSE 'Provider health check completed for workflow ''' || act.workflow || '''. Provider status' END AS detail
      FROM act JOIN rec USING (record_id))
    SELECT strftime(executed_at, '%Y-%m-%d %H:%M:%S') AS time, action_type, workflow, severity, outcome,
      substr(detail, 1, 50) || '...' AS detail FROM d ORDER BY executed_at DESC, action_id DESC LIMIT 10""",
)
def recent_actions_table(spark, folder):
    return tr.recent_actions_table(_actions(spark, folder))


@query(
    "action_timeline",
    f"""WITH {ACT} SELECT {sql_stamp('executed_at')} AS executed_at, action_type, workflow, severity, outcome FROM act
    ORDER BY act.executed_at DESC, action_id DESC LIMIT 100""",
)
def action_timeline(spark, folder):
    return tr.action_timeline(_actions(spark, folder)).withColumn("executed_at", stamp("executed_at"))


@query(
    "latency_summary",
    f"""WITH {INC}, s AS (SELECT event_type, value, event_type <> 'error' AS ok, count(*) OVER (PARTITION BY event_type) AS n,
        row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn FROM inc)
    SELECT event_type, CAST(n AS BIGINT) AS total, CAST(count(*) FILTER (ok) AS BIGINT) AS success,
      CAST(count(*) FILTER (NOT ok) AS BIGINT) AS errors, n / 2592000.0 AS throughput,
      max(value) FILTER (rn = CAST(floor(n * 0.5) AS BIGINT) + 1) AS p50,
      max(value) FILTER (rn = CAST(floor(n * 0.95) AS BIGINT) + 1) AS p95,
      max(value) FILTER (rn = CAST(floor(n * 0.99) AS BIGINT) + 1) AS p99 FROM s GROUP BY event_type, n""",
)
def latency_summary(spark, folder):
    rows = incidents(spark, folder).select("event_type", "value", (F.col("event_type") != "error").alias("ok"))
    return tr.latency_summary(rows, ["event_type"], "value", "ok", F.lit(2592000.0))
