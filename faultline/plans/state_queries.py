"""Queries: model outputs, routing, and versioned state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faultline import fixed
from faultline.operators import outputs as ou
from faultline.operators import routing as rt
from faultline.operators import snapshots as sn
from faultline.plans.registry import query
from faultline.plans.workload import INC, incidents, sql_stamp, stamp, table
from faultline.session import shared_folder
from faultline.streaming.snapshots import stored_versions, upsert_snapshots


# --- model outputs ----------------------------------------------------------------------------------
def model_outputs(spark, folder):
    """Test-case answers: some cut short, some with an empty title, a wrong risk, no steps or no tags."""
    n, k = F.col("event_id"), F.col("k")
    case = F.struct(
        F.concat(F.lit("TC-"), n).alias("id"),
        F.when(n % 11 == 0, "").otherwise(F.col("message")).alias("title"),
        F.when(n % 19 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("open"), F.col("event_type"))).alias("steps"),
        F.lit("it works").alias("expected"),
        F.when(k % 2 == 0, F.array("severity")).alias("tags"),
        F.when(n % 13 == 0, "extreme").when(k % 3 == 0, "high").alias("risk"),
        F.concat(F.lit("FEAT-"), k).alias("createdFromFeatureId"),
    )
    second = case.withField("id", F.concat(F.lit("TC-"), n, F.lit("-b"))).withField("title", F.lit("second"))
    whole = F.to_json(F.struct(F.when(k % 4 == 0, F.array(case)).otherwise(F.array(case, second)).alias("testCases")))
    cut = F.substring(whole, F.lit(1), F.length(whole) - 1)
    fixed_title = F.when(n % 2 == 0, F.replace(whole, F.lit('"title":""'), F.lit('"title":"t"'))).otherwise(cut)
    return incidents(spark, folder).select(
        F.col("record_id").alias("output_id"), F.when(n % 7 == 0, cut).otherwise(whole).alias("raw"), fixed_title.alias("repaired")
    )


OUT = INC + """,
outp AS (SELECT *, event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 19 <> 0 AS valid,
  event_id % 2 = 0 AND event_id % 13 <> 0 AND event_id % 19 <> 0 AS repairable, CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END AS cases FROM inc)"""


@query(
    "validate_test_cases",
    f"""WITH {OUT} SELECT record_id AS output_id, valid, CAST(CASE WHEN valid THEN cases END AS INTEGER) AS cases FROM outp""",
)
def validate_test_cases(spark, folder):
    checked = ou.validate_test_cases(model_outputs(spark, folder))
    return checked.select("output_id", "valid", F.when(F.col("valid"), F.size("cases")).alias("cases"))


@query(
    "test_cases",
    f"""WITH {OUT}, c AS (SELECT *, unnest(CASE WHEN cases = 1 THEN [1] ELSE [1, 2] END) AS i FROM outp WHERE valid)
    SELECT record_id AS output_id, 'TC-' || event_id || CASE WHEN i = 2 THEN '-b' ELSE '' END AS id,
      CASE WHEN i = 2 THEN 'second' ELSE message END AS title, 'open,' || event_type AS steps, 'it works' AS expected,
      CASE WHEN k % 2 = 0 THEN severity ELSE '' END AS tags, CASE WHEN k % 3 = 0 THEN 'high' ELSE 'medium' END AS risk,
      'FEAT-' || k AS feature_id FROM c""",
)
def test_cases(spark, folder):
    cases = ou.test_cases(ou.validate_test_cases(model_outputs(spark, folder)))
    return cases.withColumns({"steps": F.array_join("steps", ","), "tags": F.array_join("tags", ",")})


@query(
    "recovery_stats",
    f"""WITH {OUT} SELECT CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (NOT valid) AS BIGINT) AS recovery_attempts,
      CAST(count(*) FILTER (NOT valid AND repairable) AS BIGINT) AS recovery_successes FROM outp""",
)
def recovery_stats(spark, folder):
    return ou.recovery_stats(ou.recover_outputs(model_outputs(spark, folder)))


@query(
    "parse_copilot_output",
    f"""WITH {INC}, c AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 11 = 0 OR k > 90 OR event_id % 13 = 0 THEN 2 ELSE 0 END AS bad FROM inc)
    SELECT record_id, CASE bad WHEN 1 THEN 'Copilot could not parse model output as JSON.' WHEN 2 THEN 'Copilot output failed validation.' ELSE message END AS summary,
      CASE bad WHEN 1 THEN 'Model returned invalid JSON.' WHEN 2 THEN 'Model returned JSON that does not match the expected schema.' ELSE event_type END AS probable_cause,
      CAST(CASE bad WHEN 0 THEN 1 ELSE 3 END AS INTEGER) AS actions,
      CASE bad WHEN 1 THEN 0.2::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE k / 90 END AS confidence FROM c""",
)
def parse_copilot_output(spark, folder):
    n, k = F.col("event_id"), F.col("k")
    body = F.to_json(F.struct(
        F.col("message").alias("summary"),
        F.when(n % 11 != 0, F.col("event_type")).alias("probableCause"),
        F.when(n % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("severity")).alias("suggestedActions"),
        (k / 90).alias("confidence"),
    ))
    quoted = F.to_json(F.array(body))
    text = F.when(n % 2 == 0, F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(body)
    broken = F.when(n % 2 == 0, F.lit('"{no json"')).otherwise(F.substring(body, F.lit(1), F.length(body) - 1))
    raw = incidents(spark, folder).select("record_id", F.when(n % 7 == 0, broken).otherwise(text).alias("raw"))
    done = ou.parse_copilot_output(raw)
    return done.select("record_id", "summary", "probable_cause", F.size("suggested_actions").alias("actions"), "confidence")


@query(
    "render_prompts",
    r"""WITH d AS (SELECT *, to_json(text)::VARCHAR AS j FROM documents)
    SELECT doc_id, md5('Spec:' || chr(10) || '{' || chr(10) || '  "id": "FEAT-' || doc_id || '",' || chr(10) || '  "title": "' || source || '",' || chr(10)
      || '  "description": ' || j || ',' || chr(10) || '  "acceptanceCriteria": [' || chr(10) || '    "' || lang || '",' || chr(10)
      || '    "' || n_chars || '"' || chr(10) || '  ],' || chr(10) || '  "tags": []' || chr(10) || '}' || chr(10) || 'Risk: high. {{UNKNOWN}}') AS prompt_md5 FROM d""",
)
def render_prompts(spark, folder):
    specs = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("FEAT-"), "doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("description"),
        F.array("lang", F.col("n_chars").cast("string")).alias("acceptance_criteria"), F.lit(None).cast("array<string>").alias("tags"),
    )
    template = "Spec:\n{{FEATURE_SPEC_JSON}}\nRisk: {{RISK}}. {{UNKNOWN}}"
    values = {"FEATURE_SPEC_JSON": ou.feature_spec_json(specs), "RISK": F.lit("high")}
    return ou.render_prompts(specs, template, values).select("doc_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query(
    "incident_prompts",
    f"""WITH {INC} SELECT record_id, md5(chr(10) || 'Analyze this LLM pipeline incident:' || chr(10) || chr(10) || 'Workflow: ' || workflow || chr(10)
      || 'Stage: ' || stage || chr(10) || 'Source: ' || source_system || chr(10) || 'Type: ' || incident_type || chr(10) || 'Category: ' || source_system
      || chr(10) || 'Severity: ' || severity || chr(10) || 'Message: ' || message || chr(10) || 'Timestamp: ' || {sql_stamp('ts')} || chr(10) || chr(10)
      || 'Please analyze this incident and call appropriate tools to address it.') AS prompt_md5 FROM inc""",
)
def incident_prompts(spark, folder):
    base = incidents(spark, folder).withColumns({"source": F.col("source_system"), "category": F.col("source_system")})
    return base.select("record_id", F.md5(ou.incident_prompt(stamp("ts"))).alias("prompt_md5"))


@query(
    "repair_prompts",
    """SELECT doc_id, md5(chr(10) || 'The previous response was not valid JSON.' || chr(10) || chr(10) || 'Return ONLY valid JSON.' || chr(10)
      || 'Do not include explanations, markdown or extra text.' || chr(10) || chr(10) || 'Invalid response:' || chr(10) || coalesce(text, '') || chr(10))
      AS prompt_md5 FROM documents""",
)
def repair_prompts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(ou.repair_prompt(F.col("text"))).alias("prompt_md5"))


@query(
    "copilot_prompts",
    f"""WITH {INC} SELECT record_id, md5('{{' || chr(10) || '  "incident": {{' || chr(10) || '    "service": "' || service || '",' || chr(10)
      || '    "environment": "prod",' || chr(10) || '    "healthStatus": "' || upper(severity) || '",' || chr(10) || '    "timestamp": "'
      || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') || 'Z"' || chr(10) || '  }},' || chr(10)
      || '  "kpis": {{' || chr(10) || '    "retryRate": 0.' || CAST(25 + 50 * (event_id % 2) AS VARCHAR) || ',' || chr(10) || '    "fallbackRate": '
      || event_id % 4 || ',' || chr(10) || '    "avgAttempts": ' || event_id % 7 || '.5' || chr(10) || '  }},' || chr(10) || '  "issues": '
      || CASE WHEN event_id % 3 = 0 THEN '[]' ELSE '[' || chr(10) || '    "' || message || '",' || chr(10) || '    "a \\"b\\""' || chr(10) || '  ]' END
      || chr(10) || '}}') AS user_md5, length('{fixed.COPILOT_SYSTEM}') AS system_length FROM inc""",
)
def copilot_prompts(spark, folder):
    n = F.col("event_id")
    base = incidents(spark, folder).withColumns({
        "environment": F.lit("prod"), "health": F.upper("severity"), "retry_rate": (25 + 50 * (n % 2)) / 100, "fallback_rate": (n % 4).cast("double"),
        "avg_attempts": n % 7 + 0.5, "issues": F.when(n % 3 != 0, F.array(F.col("message"), F.lit('a "b"'))),
    })
    out = ou.copilot_prompt(base)
    return out.select("record_id", F.md5(F.col("user")).alias("user_md5"), F.length("system").cast("bigint").alias("system_length"))


# --- routing ------------------------------------------------------------------------------------------
SIM = """
sim AS (SELECT *, count(*) OVER (PARTITION BY incident_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS similar_1h,
  count(*) OVER (PARTITION BY incident_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS similar_24h FROM inc)"""


@query(
    "similar_in_last",
    f"WITH {INC}, {SIM} SELECT record_id, CAST(similar_1h AS BIGINT) AS similar_1h, CAST(similar_24h AS BIGINT) AS similar_24h FROM sim",
)
def similar_in_last(spark, folder):
    base = incidents(spark, folder).select("record_id", "incident_type", "ts")
    hour = rt.similar_in_last(base, 1, name="similar_1h")
    return rt.similar_in_last(hour, 24, name="similar_24h").select("record_id", "similar_1h", "similar_24h")


@query(
    "escalation_trend",
    f"""WITH {INC}, t AS (SELECT record_id, count(*) OVER w AS n, count(*) FILTER (severity IN ('high', 'critical')) OVER w AS e FROM inc
      WINDOW w AS (ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))
    SELECT record_id, CAST(n AS BIGINT) AS recent, CAST(e AS BIGINT) AS recent_escalated,
      CASE WHEN e / n > 0.5 THEN 'deteriorating' WHEN e / n > 0.2 THEN 'concerning' ELSE 'stable' END AS trend FROM t""",
)
def escalation_trend(spark, folder):
    base = incidents(spark, folder).select("record_id", "severity", "ts")
    return rt.escalation_trend(base, F.col("severity").isin("high", "critical")).drop("severity", "ts")


HEALTH = "CASE k % 5 WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' WHEN 2 THEN 'unhealthy' WHEN 3 THEN 'unknown' ELSE 'offline' END"
LOAD = "(CASE WHEN k % 10 = 9 THEN 50.0 ELSE k END + CASE WHEN value > 100 THEN 60.0 ELSE value END) / 2"
LEVEL = f"CASE WHEN {LOAD} < 30 THEN 'low' WHEN {LOAD} < 70 THEN 'normal' WHEN {LOAD} < 90 THEN 'high' ELSE 'overload' END"


def _situations(spark, folder):
    k = F.col("k")
    health = F.element_at(F.array(*[F.lit(x) for x in ("healthy", "degraded", "unhealthy", "unknown", "offline")]), (k % 5 + 1).cast("int"))
    cpu = F.when(k % 10 != 9, k.cast("double"))
    memory = F.when(F.col("value") <= 100, F.col("value"))
    return incidents(spark, folder).withColumns({"health_status": health, "workload": rt.workload_level(cpu, memory)})


@query("workload_level", f"WITH {INC} SELECT record_id, {LEVEL} AS workload FROM inc")
def workload_level(spark, folder):
    return _situations(spark, folder).select("record_id", "workload")


@query(
    "route_incidents",
    f"""WITH {INC}, {SIM}, s AS (SELECT *, {HEALTH} AS health, {LEVEL} AS workload FROM sim),
    r AS (SELECT *, CASE WHEN health = 'offline' THEN NULL
        WHEN severity = 'critical' AND health IN ('healthy', 'degraded') THEN 'critical_incident_fast_track'
        WHEN similar_1h >= 3 THEN 'repeated_incident_escalation'
        WHEN workload IN ('high', 'overload') AND severity IN ('medium', 'high') THEN 'high_load_cautious'
        WHEN health IN ('degraded', 'unhealthy') THEN 'degraded_system_conservative' END AS rule FROM s)
    SELECT record_id, rule, CASE WHEN health = 'offline' THEN 'evaluate' WHEN rule = 'critical_incident_fast_track' THEN 'execute_action'
      WHEN rule = 'repeated_incident_escalation' THEN 'escalate_incident' WHEN rule = 'high_load_cautious' THEN 'prepare_staged_action'
      WHEN rule = 'degraded_system_conservative' THEN 'conservative_action' WHEN severity = 'critical' THEN 'execute_action'
      ELSE 'evaluate' END AS node FROM r""",
)
def route_incidents(spark, folder):
    base = _situations(spark, folder).select("record_id", "incident_type", "ts", "severity", "health_status", "workload")
    counted = rt.similar_in_last(base, 1, name="similar_incidents_1h")
    return rt.route_incidents(counted).select("record_id", "rule", "node")


@query(
    "service_health",
    f"""WITH {INC}, h AS (SELECT service, count(*) FILTER (event_type <> 'error' AND severity <> 'low') AS healthy, count(*) AS total FROM inc GROUP BY service)
    SELECT service, CAST(healthy AS BIGINT) AS healthy, CAST(total AS BIGINT) AS total,
      CASE WHEN healthy / total >= 0.8 THEN 'healthy' WHEN healthy / total >= 0.5 THEN 'degraded' ELSE 'unhealthy' END AS health_status FROM h""",
)
def service_health(spark, folder):
    fine = (F.col("event_type") != "error") & (F.col("severity") != "low")
    return rt.service_health(incidents(spark, folder).withColumn("healthy", fine), ["service"])


@query(
    "health_gate",
    f"""WITH {INC}, s AS (SELECT record_id, {HEALTH} AS health, severity FROM inc)
    SELECT record_id, CASE WHEN health = 'unhealthy' AND severity = 'high' THEN 'escalate' WHEN health = 'unhealthy' THEN 'wait_and_retry'
      WHEN health = 'degraded' THEN 'proceed_with_caution' WHEN health = 'healthy' THEN 'proceed_normally' ELSE 'health_check' END AS next FROM s""",
)
def health_gate(spark, folder):
    return _situations(spark, folder).select("record_id", rt.health_gate(F.col("health_status"), F.col("severity")).alias("next"))


@query(
    "safety_gate",
    f"""WITH {INC}, s AS (SELECT record_id, event_id, {HEALTH} AS health, k % 6 AS chunks FROM inc),
    m AS (SELECT *, CASE health WHEN 'unhealthy' THEN 1.5::DOUBLE WHEN 'degraded' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS f,
      CASE event_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'coordinated' WHEN 2 THEN 'waiting' END AS coord FROM s),
    a AS (SELECT *, least(0.9::DOUBLE, 0.5::DOUBLE + chunks * 0.1::DOUBLE) * f AS score, CASE WHEN f > 1.2::DOUBLE THEN 'needs_action' ELSE 'ok' END AS status,
      CASE WHEN f > 1.3::DOUBLE THEN 'restart_service' ELSE 'monitor' END AS action, health IN ('healthy', 'degraded') AS c1,
      coalesce(coord, 'ready') IN ('ready', 'coordinated') AS c2 FROM m)
    SELECT record_id, round(score, 6) AS score, status, round(0.8::DOUBLE + chunks * 0.1::DOUBLE, 6) AS confidence,
      CASE WHEN c1 AND c2 THEN action ELSE 'monitor' END AS final_action, CASE WHEN NOT (c1 AND c2) THEN 'safety_checks_failed' END AS reason,
      (CASE WHEN c1 THEN 1 ELSE 0 END + CASE WHEN c2 THEN 1 ELSE 0 END + 1) / 3 AS safety_score FROM a""",
)
def safety_gate(spark, folder):
    n = F.col("event_id")
    coordination = F.when(n % 4 == 0, "ready").when(n % 4 == 1, "coordinated").when(n % 4 == 2, "waiting")
    base = _situations(spark, folder).withColumns({"context_chunks": F.col("k") % 6, "coordination_status": coordination})
    done = rt.safety_gate(rt.context_adjusted_score(base))
    return done.select("record_id", F.round("score", 6).alias("score"), "status", F.round("confidence", 6).alias("confidence"),
                       "final_action", "reason", "safety_score")


@query(
    "execution_summary",
    """SELECT CAST(conv_id AS BIGINT) AS run_id, CAST(count(*) AS BIGINT) AS total_nodes, CAST(sum(length(text)) AS BIGINT) AS total_duration_us,
      max_by(role, turn) FILTER (role = 'assistant') AS final_action FROM conversations GROUP BY conv_id""",
)
def execution_summary(spark, folder):
    trace = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.length("text").cast("bigint").alias("duration_us"),
        F.when(F.col("role") == "assistant", F.col("role")).alias("action"),
    )
    return rt.execution_summary(trace)


# --- snapshots ----------------------------------------------------------------------------------------
STATE = ("role", "mood")


def _states(spark, folder):
    """Turns of conversations as saved states; states of a thread repeat."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.expr("timestamp_seconds(1704067200 + turn * 43200)").alias("at"), "role",
        (F.length("text") % 4).alias("mood"), "turn",
    )


def _versions(spark, folder):
    return sn.snapshot_versions(_states(spark, folder), F.concat_ws(":", *STATE))


SNP = """
st AS (SELECT conv_id AS thread_id, make_timestamp((1704067200 + turn * 43200) * 1000000) AS saved, role, length(text) % 4 AS mood, turn,
  substr(sha256(role || ':' || (length(text) % 4)), 1, 16) AS snapshot_id FROM conversations),
mg AS (SELECT thread_id, snapshot_id, min(saved) AS first_at, max(saved) AS last_at, max_by(turn, saved) AS turn FROM st GROUP BY ALL),
nu AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY first_at, snapshot_id) AS version FROM mg),
snp AS (SELECT *, lag(snapshot_id) OVER (PARTITION BY thread_id ORDER BY version) AS parent_id FROM nu)"""
SNP_COLUMNS = f"""CAST(thread_id AS BIGINT) AS thread_id, snapshot_id, CAST(version AS BIGINT) AS version, parent_id,
  {sql_stamp('first_at')} AS first_at, {sql_stamp('last_at')} AS last_at, CAST(turn AS BIGINT) AS turn"""


def _flat(versions):
    return versions.select(
        "thread_id", "snapshot_id", "version", "parent_id", stamp("first_at").alias("first_at"), stamp("last_at").alias("last_at"),
        F.col("payload.turn").alias("turn"),
    )


@query("snapshot_versions", f"WITH {SNP} SELECT {SNP_COLUMNS} FROM snp")
def snapshot_versions(spark, folder):
    return _flat(_versions(spark, folder))


@query("snapshot_upsert", f"WITH {SNP} SELECT {SNP_COLUMNS} FROM snp")
def snapshot_upsert(spark, folder):
    """The states in three batches, the later turns first, and the last batch twice."""
    root = f"{shared_folder(spark)}/faultline-snapshots-{uuid.uuid4().hex[:12]}"
    states = _states(spark, folder)
    late = F.col("turn") >= 3
    for batch_id, part in ((0, late), (1, ~late & (F.col("turn") % 2 == 1)), (2, ~late & (F.col("turn") % 2 == 0)), (2, ~late & (F.col("turn") % 2 == 0))):
        upsert_snapshots(states.where(part), F.concat_ws(":", *STATE), root, batch_id, buckets=8)
    return _flat(stored_versions(states, root))


@query(
    "latest_snapshot",
    f"WITH {SNP} SELECT {SNP_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY version DESC) AS rn FROM snp) WHERE rn = 1",
)
def latest_snapshot(spark, folder):
    return _flat(sn.latest_snapshot(_versions(spark, folder)))


@query(
    "snapshot_history",
    f"WITH {SNP} SELECT {SNP_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY version DESC) AS rn FROM snp) WHERE rn <= 3",
)
def snapshot_history(spark, folder):
    return _flat(sn.snapshot_history(_versions(spark, folder), 3))


@query(
    "rollback",
    f"""WITH {SNP}, top AS (SELECT thread_id, max(version) AS top FROM snp GROUP BY thread_id)
    SELECT CAST(thread_id AS BIGINT) AS thread_id, snapshot_id, CAST(version AS BIGINT) AS version, CAST(NULL AS VARCHAR) AS rolled_back_from, CAST(turn AS BIGINT) AS turn FROM snp
    UNION ALL SELECT thread_id, 'rollback_1717200000', top + 1, snapshot_id, turn FROM snp JOIN top USING (thread_id) WHERE version = 2""",
)
def rollback(spark, folder):
    versions = _versions(spark, folder)
    targets = versions.where(F.col("version") == 2)
    done = sn.rollback(versions, targets, F.timestamp_seconds(F.lit(1717200000)))
    return done.select("thread_id", "snapshot_id", "version", "rolled_back_from", F.col("payload.turn").alias("turn"))


@query(
    "retain_snapshots",
    f"""WITH {SNP}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY version DESC) AS rn FROM snp)
    SELECT CAST(thread_id AS BIGINT) AS thread_id, snapshot_id, rn = 1 AND last_at > TIMESTAMP '2024-01-02 06:00:00' AS is_current FROM r
    WHERE rn <= 5 AND last_at > TIMESTAMP '2024-01-03 06:00:00' - INTERVAL 2 DAY""",
)
def retain_snapshots(spark, folder):
    as_of = F.lit("2024-01-03 06:00:00").cast("timestamp")
    kept = sn.retain_snapshots(_versions(spark, folder), as_of, history_days=2, limit=5)
    return kept.select("thread_id", "snapshot_id", "is_current")


@query(
    "deliver_messages",
    """SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, to_agent, CAST(position AS INTEGER) AS position FROM (
      SELECT conv_id, turn, role || '-' || conv_id % 20 AS to_agent, row_number() OVER (PARTITION BY role || '-' || conv_id % 20 ORDER BY turn, conv_id) AS position
      FROM conversations) WHERE position <= 10""",
)
def deliver_messages(spark, folder):
    messages = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.concat("role", F.lit("-"), F.col("conv_id") % 20).alias("to_agent"), F.col("turn").alias("sent_at"),
        F.col("conv_id").alias("message_id"),
    )
    return sn.deliver_messages(messages).select("conv_id", "turn", "to_agent", "position")
