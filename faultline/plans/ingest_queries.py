"""Queries: payloads to events, incidents and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import fixed
from faultline.operators import evaluate as ev
from faultline.operators import normalize as nz
from faultline.plans.registry import query
from faultline.plans.workload import EVT, INC, REC, incidents, payloads, records, sql_stamp, stamp

EVENT_COLUMNS = """incident_id, source_system, severity, service, message, {ts} AS event_time, error_type, affected_resource"""


def _event_select(df):
    return df.select(
        "incident_id", "source_system", "severity", "service", "message", stamp("timestamp").alias("event_time"),
        "error_type", "affected_resource",
    )


def _source_query(name: str, source: str):
    sql = f"WITH {EVT} SELECT {EVENT_COLUMNS.format(ts=sql_stamp('timestamp'))} FROM evt " \
          f"WHERE reasons = '' AND source_system = '{source}'"

    @query(name, sql)
    def build(spark, folder):
        raw = payloads(spark, folder).where(F.col("source_system") == source)
        return _event_select(nz.accepted(nz.normalize(raw)))


_source_query("normalize_jvm_log", "spring-boot")
_source_query("normalize_kafka_event", "kafka")
_source_query("normalize_webhook", "generic")


@query("normalize_all", f"WITH {EVT} SELECT {EVENT_COLUMNS.format(ts=sql_stamp('timestamp'))} FROM evt WHERE reasons = ''")
def normalize_all(spark, folder):
    return _event_select(nz.accepted(nz.normalize(payloads(spark, folder))))


@query("quarantine", f"WITH {EVT} SELECT incident_id, source_system, reasons FROM evt WHERE reasons <> ''")
def quarantine(spark, folder):
    bad = nz.rejected(nz.normalize(payloads(spark, folder)))
    return bad.select("incident_id", "source_system", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "validate_events",
    f"""WITH {INC} SELECT record_id,
      concat_ws('; ', CASE WHEN event_id % 11 = 0 THEN 'service must not be blank' END,
        CASE WHEN event_id % 13 = 0 THEN 'message must not be blank' END,
        CASE WHEN event_id % 17 = 0 THEN 'unknown source_system' END,
        CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'unknown severity' END,
        CASE WHEN k % 10 = 3 THEN 'timestamp cannot be parsed' END) AS reasons FROM inc""",
)
def validate_events(spark, folder):
    n, k = F.col("event_id"), F.col("k")
    dirty = incidents(spark, folder).withColumns(
        {
            "service": F.when(n % 11 == 0, " \t").otherwise(F.col("service")),
            "message": F.when(n % 13 != 0, F.col("message")),
            "source_system": F.when(n % 17 == 0, "oracle").otherwise(F.col("source_system")),
            "severity": F.when((F.col("event_type") == "view") & (k % 2 == 0), "fatal").otherwise(F.col("severity")),
            "timestamp": F.when(k % 10 != 3, F.col("ts")),
        }
    )
    return nz.validate_events(dirty).select("record_id", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "incident_types",
    f"WITH {EVT} SELECT incident_type, severity, CAST(count(*) AS BIGINT) AS incidents FROM good GROUP BY ALL",
)
def incident_types(spark, folder):
    std = nz.to_standard_incident(nz.accepted(nz.normalize(payloads(spark, folder))))
    return std.groupBy("incident_type", "severity").agg(F.count("*").alias("incidents"))


@query(
    "standard_incidents",
    f"""WITH {EVT} SELECT incident_id AS id, {sql_stamp('timestamp')} AS event_time, service AS workflow, stage, incident_type,
      source_system AS category, severity, source_system AS source, message,
      error_type AS context_error, affected_resource AS context_resource,
      CAST(CASE WHEN error_type IS NULL THEN 1 ELSE 2 END AS INTEGER) AS context_size FROM good""",
)
def standard_incidents(spark, folder):
    std = nz.to_standard_incident(nz.accepted(nz.normalize(payloads(spark, folder))))
    return std.select(
        "id", stamp("timestamp").alias("event_time"), "workflow", "stage", "incident_type", "category", "severity",
        "source", "message", F.col("context")["error_type"].alias("context_error"),
        F.col("context")["affected_resource"].alias("context_resource"), F.size("context").alias("context_size"),
    )


@query(
    "incident_text",
    f"""WITH {EVT} SELECT incident_id AS id, 'workflow: ' || service || ' | stage: ' || stage || ' | incident_type: '
      || incident_type || ' | severity: ' || severity || ' | category: ' || source_system || ' | source: ' || source_system
      || ' | message: ' || message || ' | context: {{'
      || CASE WHEN error_type IS NULL THEN '' ELSE '"error_type": "' || error_type || '", ' END
      || '"affected_resource": "' || affected_resource || '"}}' AS text FROM good""",
)
def incident_text(spark, folder):
    std = nz.to_standard_incident(nz.accepted(nz.normalize(payloads(spark, folder))))
    return std.select("id", nz.incident_text(std).alias("text"))


@query(
    "validate_contract",
    f"""WITH {INC} SELECT record_id,
      concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'workflow' END, CASE WHEN k >= 90 THEN 'incident_type' END,
        CASE WHEN user_id % 10 = 0 THEN 'timestamp' END) AS incident_reasons,
      concat_ws(',', CASE WHEN k % 3 = 0 THEN 'status' END, CASE WHEN event_id % 5 = 0 THEN 'suggested_action' END,
        CASE WHEN value > 100 THEN 'score' END) AS evaluation_reasons,
      concat_ws(',', CASE WHEN event_type = 'click' THEN 'status' END, CASE WHEN event_type = 'view' THEN 'trend' END,
        CASE WHEN k < 10 THEN 'recent_incident_count' END) AS health_reasons FROM inc""",
)
def validate_contract(spark, folder):
    base = incidents(spark, folder)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    inc = base.select(
        "record_id", F.col("record_id").alias("id"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("workflow")).alias("workflow"),
        "stage", F.when(F.col("k") >= 90, "other").otherwise(F.col("incident_type")).alias("incident_type"),
        F.col("source_system").alias("category"), "severity", F.col("source_system").alias("source"), "message",
        F.when(F.col("user_id") % 10 == 0, F.date_format("ts", "dd/MM/yyyy")).otherwise(iso).alias("timestamp"),
        "k", "event_id", "value", "event_type",
    )
    inc = nz.validate_contract(inc, "incident").withColumnRenamed("reasons", "incident_reasons")
    res = inc.select(
        "record_id", "incident_reasons", "k", "event_type", "workflow",
        F.when(F.col("k") % 3 == 0, F.lit(None)).otherwise("ok").alias("status"), F.col("value").alias("score"),
        F.col("message").alias("summary"), F.lit(None).cast("string").alias("reasoning"),
        F.when(F.col("event_id") % 5 == 0, "reboot").alias("suggested_action"), F.array("workflow").alias("tags"),
    )
    res = nz.validate_contract(res.withColumn("tags", F.array("event_type")), "evaluation")
    res = res.withColumnRenamed("reasons", "evaluation_reasons")
    health = res.select(
        "record_id", "incident_reasons", "evaluation_reasons", F.lit("wf").alias("workflow"),
        F.when(F.col("event_type") == "click", "down").otherwise("healthy").alias("status"), F.lit(50).alias("score"),
        F.when(F.col("event_type") == "view", "sideways").otherwise("stable").alias("trend"),
        F.when(F.col("k") < 10, -1).otherwise(F.col("k")).alias("recent_incident_count"), F.lit("s").alias("summary"),
        F.lit(None).cast("string").alias("timestamp"),
    )
    health = nz.validate_contract(health, "health")
    return health.select(
        "record_id",
        F.array_join("incident_reasons", ",").alias("incident_reasons"),
        F.array_join("evaluation_reasons", ",").alias("evaluation_reasons"),
        F.array_join("reasons", ",").alias("health_reasons"),
    )


# --- evaluation -----------------------------------------------------------------------------------
def _rule_case(position: int, text: bool = True) -> str:
    """SQL twin of one column of the rule table."""
    lines = []
    for kind, severities, status, score, action, _, texts in fixed.EVALUATION_RULES:
        value = (status, score, action, texts[0], texts[1])[position]
        shown = f"'{value}'" if text else str(value)
        names = ", ".join(f"'{s}'" for s in severities)
        lines.append(f"WHEN incident_type = '{kind}' AND severity IN ({names}) THEN {shown}")
    return "CASE " + " ".join(lines) + " END"


@query(
    "evaluate_incidents",
    f"""WITH {INC} SELECT record_id, {_rule_case(0)} AS status, CAST({_rule_case(1, False)} AS INTEGER) AS score,
      {_rule_case(3)} AS summary, {_rule_case(4)} AS reasoning, {_rule_case(2)} AS suggested_action,
      incident_type || ',' || source_system || ',' || CASE incident_type WHEN 'schema_error' THEN stage
        WHEN 'technical_error' THEN source_system ELSE workflow END AS tags FROM inc""",
)
def evaluate_incidents(spark, folder):
    base = incidents(spark, folder).withColumns({"source": F.col("source_system"), "category": F.col("source_system")})
    done = ev.evaluate_incidents(base)
    return done.select(
        "record_id", "status", "score", "summary", "reasoning", "suggested_action", F.array_join("tags", ",").alias("tags")
    )


@query(
    "ingest_records",
    f"""WITH {EVT}, outcome AS (SELECT *, severity IN ('high', 'critical') AS up FROM good)
    SELECT incident_id, source_system, service, severity, incident_type,
      CASE WHEN incident_type = 'schema_error' OR (incident_type = 'technical_error' AND up) THEN 'critical'
           ELSE 'needs_attention' END AS evaluation_status,
      CAST(CASE incident_type WHEN 'schema_error' THEN CASE WHEN up THEN 85 ELSE 70 END
           WHEN 'technical_error' THEN CASE WHEN up THEN 80 ELSE 60 END
           WHEN 'semantic_error' THEN CASE WHEN up THEN 65 ELSE 50 END
           ELSE CASE WHEN up THEN 70 ELSE 55 END END AS INTEGER) AS evaluation_score,
      CASE incident_type WHEN 'schema_error' THEN 'inspect_schema'
           WHEN 'technical_error' THEN CASE WHEN up THEN 'check_provider' ELSE 'monitor' END
           WHEN 'semantic_error' THEN 'inspect_prompt' ELSE 'monitor' END AS suggested_action
    FROM outcome""",
)
def ingest_records(spark, folder):
    from faultline.operators.ingest import ingest

    return ingest(payloads(spark, folder)).response()


def _detail_sql() -> str:
    def text(template: str) -> str:
        out = "'" + template.replace("'", "''") + "'"
        for name in ("workflow", "stage", "severity", "category", "incident_type", "source", "score"):
            out = out.replace("{" + name + "}", f"' || {name} || '")
        return out

    cases = " ".join(
        f"WHEN '{a}' THEN {text(fixed.ACTION_DETAIL[a])}"
        for a in ("monitor", "inspect_prompt", "inspect_schema", "check_provider")
    )
    return f"CASE suggested_action {cases} END"


@query(
    "dispatch_actions",
    f"""WITH {REC} SELECT record_id, 'act_' || sha256(record_id) AS action_id,
      {sql_stamp('received_at')} AS executed_at, suggested_action AS action_type, 'success' AS outcome,
      {_detail_sql()} AS detail, workflow, severity
    FROM rec WHERE status <> 'ok' AND suggested_action IS NOT NULL""",
)
def dispatch_actions(spark, folder):
    log = ev.dispatch_actions(records(spark, folder))
    return log.withColumn("executed_at", stamp("executed_at"))


@query(
    "dispatch_actions_all_kinds",
    f"""WITH {REC}, act AS (SELECT *, CASE k % 4 WHEN 0 THEN 'retry' WHEN 1 THEN 'escalate' WHEN 2 THEN 'reboot' ELSE 'monitor' END AS act
      FROM rec)
    SELECT record_id, act AS action_type, CASE WHEN act = 'reboot' THEN 'failed' ELSE 'success' END AS outcome,
      CASE act
        WHEN 'retry' THEN 'Retry scheduled (' || CASE WHEN severity = 'critical' THEN 'immediate' ELSE 'deferred (60 s backoff)' END
          || ') for workflow ''' || workflow || ''' at stage ''' || stage || '''. Reason: ' || message || '.'
        WHEN 'escalate' THEN 'Escalation triggered via ' || CASE severity WHEN 'critical' THEN 'PagerDuty (immediate page)'
          WHEN 'high' THEN 'Slack #ops-alerts' WHEN 'medium' THEN 'Jira (medium priority)' ELSE 'Jira (low priority)' END
          || ' for workflow ''' || workflow || ''' | severity: ' || severity || ' | score: ' || score
          || ' | message: ' || substr(message, 1, 120)
        WHEN 'monitor' THEN 'Enhanced monitoring activated for workflow ''' || workflow || ''' (stage: ' || stage
          || '). Elevated alert threshold: severity≥' || severity || '.'
        ELSE 'No handler for action ''reboot''' END AS detail
    FROM act WHERE status <> 'ok'""",
)
def dispatch_actions_all_kinds(spark, folder):
    chosen = F.element_at(F.array(F.lit("retry"), F.lit("escalate"), F.lit("reboot"), F.lit("monitor")), (F.col("k") % 4 + 1).cast("int"))
    log = ev.dispatch_actions(records(spark, folder).withColumn("suggested_action", chosen))
    return log.select("record_id", "action_type", "outcome", "detail")


def tool_choices(spark, folder):
    """Incidents with k % 4 chosen calls as JSON; the last call is broken in some, unknown in others."""
    base = incidents(spark, folder)
    names = F.array(*[F.lit(a) for a in fixed.TOOL_DETAIL])
    call = F.transform(
        F.sequence(F.lit(1), F.lit(3)),
        lambda i: F.struct(
            F.concat(F.lit("call_"), i).alias("id"),
            F.when((F.col("event_id") % 10 == 0) & (i == 1), "reboot")
            .otherwise(F.element_at(names, ((F.col("event_id") + i) % 6 + 1).cast("int")))
            .alias("function"),
            F.when((F.col("event_id") % 7 == 0) & (i == 2), F.lit('{"workflow": "w"}'))
            .otherwise(F.to_json(F.struct("workflow", "severity", F.col("event_type").alias("reason"))))
            .alias("arguments"),
        ),
    )
    n = (F.col("k") % 4).cast("int")
    return base.withColumn("tool_calls_json", F.to_json(F.slice(call, F.lit(1), n)))


CALLS = INC + """,
calls AS (
  SELECT inc.*, i, 'call_' || i AS tool_call_id,
    CASE WHEN event_id % 10 = 0 AND i = 1 THEN 'reboot'
      ELSE list_extract(['monitor', 'retry', 'inspect_prompt', 'inspect_schema', 'check_provider', 'escalate'],
        CAST((event_id + i) % 6 + 1 AS INTEGER)) END AS function,
    NOT (event_id % 7 = 0 AND i = 2) AS accepted
  FROM inc, range(1, 4) AS r(i) WHERE i <= k % 4)"""


@query(
    "dispatch_tool_calls",
    f"""WITH {CALLS} SELECT record_id, CAST(i - 1 AS INTEGER) AS position, tool_call_id, function,
      CASE WHEN accepted AND function <> 'reboot' THEN 'success' ELSE 'failed' END AS outcome, accepted,
      CASE WHEN NOT accepted THEN 'Tool execution error: invalid arguments' ELSE CASE function
        WHEN 'monitor' THEN 'Enhanced monitoring activated for workflow ''' || workflow || ''' based on LLM analysis: ' || event_type
        WHEN 'retry' THEN 'Retry scheduled (' || CASE WHEN severity = 'critical' THEN 'immediate' ELSE 'deferred' END
          || ') for workflow ''' || workflow || '''. LLM reasoning: ' || event_type
        WHEN 'inspect_prompt' THEN 'Prompt review ticket created for workflow ''' || workflow || '''. LLM identified issue: ' || event_type
        WHEN 'inspect_schema' THEN 'Schema review ticket created for workflow ''' || workflow || '''. LLM detected problem: ' || event_type
        WHEN 'check_provider' THEN 'Provider health check initiated for workflow ''' || workflow || '''. LLM suspected: ' || event_type
        WHEN 'escalate' THEN 'Escalation triggered via ' || CASE severity WHEN 'critical' THEN 'PagerDuty (immediate)'
          WHEN 'high' THEN 'Slack #ops-alerts' WHEN 'medium' THEN 'Jira (medium priority)' ELSE 'Jira (low priority)' END
          || ' for workflow ''' || workflow || '''. LLM reasoning: ' || event_type
        ELSE 'Unknown tool function: reboot' END END AS detail FROM calls""",
)
def dispatch_tool_calls(spark, folder):
    return ev.dispatch_tool_calls(tool_choices(spark, folder))


@query(
    "tool_call_log",
    f"""WITH {CALLS} SELECT record_id, CAST(count(*) FILTER (accepted) AS BIGINT) AS total_tools,
      CAST(count(*) FILTER (accepted AND function <> 'reboot') AS BIGINT) AS successful_tools FROM calls GROUP BY record_id""",
)
def tool_call_log(spark, folder):
    return ev.tool_call_log(ev.dispatch_tool_calls(tool_choices(spark, folder)))


@query(
    "evaluate_with_tools",
    f"""WITH {CALLS}, n AS (SELECT record_id, count(*) FILTER (accepted) AS t FROM calls GROUP BY record_id),
    s AS (SELECT inc.*, coalesce(t, 0) AS t,
        CASE severity WHEN 'low' THEN 20 WHEN 'medium' THEN 40 WHEN 'high' THEN 70 ELSE 90 END AS base
      FROM inc LEFT JOIN n USING (record_id)),
    f AS (SELECT *, CASE WHEN t = 0 THEN greatest(10, base - 20) WHEN t > 2 THEN least(95, base + 15) ELSE base END AS score FROM s)
    SELECT record_id, CAST(score AS INTEGER) AS score,
      CASE WHEN score <= 40 THEN 'ok' WHEN score <= 80 THEN 'needs_attention' ELSE 'critical' END AS status,
      'LLM analysis with ' || t || ' tool call(s)' AS summary FROM f""",
)
def evaluate_with_tools(spark, folder):
    chosen = tool_choices(spark, folder)
    log = ev.tool_call_log(ev.dispatch_tool_calls(chosen))
    base = chosen.withColumn("category", F.col("source_system"))
    return ev.evaluate_with_tools(base, log).select("record_id", F.col("score").cast("int").alias("score"), "status", "summary")


@query(
    "workflow_health",
    f"""WITH {REC} SELECT workflow, CASE status WHEN 'ok' THEN 'healthy' WHEN 'needs_attention' THEN 'degraded' ELSE 'critical' END AS status,
      score, 'stable' AS trend, CAST(recent AS BIGINT) AS recent_incident_count FROM (
        SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY received_at DESC, record_id DESC) AS rn,
          count(*) FILTER (received_at >= TIMESTAMP '2024-01-29 00:00:00') OVER (PARTITION BY workflow) AS recent FROM rec) WHERE rn = 1""",
)
def workflow_health(spark, folder):
    return ev.workflow_health(records(spark, folder), F.lit("2024-01-29 00:00:00").cast("timestamp"))


@query(
    "cycle_summary",
    f"""WITH {REC} SELECT strftime(date_trunc('hour', received_at), '%Y-%m-%d %H') AS cycle_id, CAST(count(*) AS BIGINT) AS records,
      CAST(count(*) FILTER (status <> 'ok' AND suggested_action IS NOT NULL) AS BIGINT) AS actions,
      CAST(count(*) FILTER (event_id % 6 > 0) AS BIGINT) AS retrieval_hits FROM rec GROUP BY ALL""",
)
def cycle_summary(spark, folder):
    rec = records(spark, folder).withColumn("cycle_id", F.date_format("received_at", "yyyy-MM-dd HH"))
    actions = rec.where((F.col("status") != "ok") & F.col("suggested_action").isNotNull())
    return ev.cycle_summary(rec, actions, rec.where(F.col("event_id") % 6 > 0))


@query(
    "ingest_failure_rate",
    f"""WITH {EVT}, s AS (SELECT service AS workflow, 1 AS failed FROM good)
    SELECT workflow, CAST(count(*) AS BIGINT) AS total, CAST(sum(failed) AS BIGINT) AS failed,
      round(sum(failed) / count(*), 4) AS failure_rate FROM s GROUP BY workflow""",
)
def ingest_failure_rate(spark, folder):
    from faultline.operators.ingest import ingest
    from faultline.operators.trends import workflow_failure_rate

    return workflow_failure_rate(ingest(payloads(spark, folder)).records)
