"""Queries: window summaries, reports, grounding and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import fixed
from faultline.operators import codes
from faultline.operators import grounding as gr
from faultline.operators import similarity as sm
from faultline.operators import windows as wn
from faultline.operators.evaluate import evaluate_incidents
from faultline.operators.normalize import incident_text
from faultline.operators.outputs import parse_window_reports
from faultline.plans.registry import query
from faultline.plans.workload import INC, REC, incidents, records, table

HOUR = 3600
MICROS = HOUR * 1000000


def hourly(spark, folder):
    """Incidents with batch_id = whole hours since 1970."""
    return incidents(spark, folder).withColumn("batch_id", F.floor(F.unix_seconds("ts") / HOUR))


HRS = INC + f""",
hrs AS (SELECT epoch_us(ts) // {MICROS} AS batch_id, * FROM inc),
w1 AS (
  SELECT batch_id, service, count(*) AS count, count(*) FILTER (severity IN ('high', 'critical')) AS urgent,
    CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)
      WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS dominant_severity,
    list_sort(list(DISTINCT incident_type)) AS types
  FROM hrs GROUP BY batch_id, service),
rep AS (
  SELECT batch_id, sum(count) AS n, count(*) AS services, sum(urgent) AS u, sum(urgent) > sum(count) * 0.5 AS hot
  FROM w1 GROUP BY batch_id)"""

ASSESSMENT = """CASE WHEN hot THEN 'High volume of critical/high severity incidents across ' || services || ' service(s). '
    || u || ' of ' || n || ' events require immediate attention.'
  ELSE 'Received ' || n || ' incident event(s) across ' || services || ' service(s) in the last 60 minutes. '
    || 'No critical pattern detected by rule-based analysis.' END"""
PATTERN = "CASE WHEN hot THEN 'Elevated error rate: ' || u || '/' || n || ' events are high/critical severity' END"
STEPS = """CASE WHEN hot THEN 'Investigate affected services immediately|Check infrastructure health|Consider rollback if recent deployment'
  ELSE 'Monitor situation|Review individual incident logs' END"""


@query(
    "window_service_summary",
    f"""WITH {HRS} SELECT CAST(batch_id AS BIGINT) AS batch_id, service, CAST(count AS BIGINT) AS count, dominant_severity,
      array_to_string(types, ',') AS incident_types, CAST(urgent AS BIGINT) AS urgent FROM w1""",
)
def window_service_summary(spark, folder):
    summary = wn.window_service_summary(hourly(spark, folder))
    return summary.withColumn("incident_types", F.array_join("incident_types", ","))


@query(
    "window_report",
    f"""WITH {HRS} SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(n AS BIGINT) AS event_count, 3600 AS window_seconds,
      CAST(services AS BIGINT) AS services, CAST(u AS BIGINT) AS urgent_count, {ASSESSMENT} AS overall_assessment,
      {PATTERN} AS critical_pattern, {STEPS} AS recommended_actions, 'low' AS hallucination_risk, 40 AS confidence_score,
      false AS llm_used FROM rep""",
)
def window_report(spark, folder):
    report = wn.window_report(wn.window_service_summary(hourly(spark, folder)), HOUR)
    return report.withColumn("recommended_actions", F.array_join("recommended_actions", "|"))


@query(
    "window_report_nested",
    f"""WITH {HRS}, n AS (SELECT batch_id, string_agg(service || ':' || count || ':' || dominant_severity || ':'
        || array_to_string(types, ','), ';' ORDER BY service) AS events_by_service,
        string_agg(service, ',' ORDER BY service) AS services_affected FROM w1 GROUP BY batch_id)
    SELECT CAST(batch_id AS BIGINT) AS batch_id, events_by_service, services_affected FROM n""",
)
def window_report_nested(spark, folder):
    summary = wn.window_service_summary(hourly(spark, folder))
    nested = wn.nested_report(wn.window_report(summary, HOUR), summary)
    entry = F.transform(
        "events_by_service",
        lambda e: F.concat_ws(":", e["service"], e["count"].cast("string"), e["dominant_severity"], F.array_join(e["incident_types"], ",")),
    )
    return nested.select(
        "batch_id", F.array_join(entry, ";").alias("events_by_service"), F.array_join("services_affected", ",").alias("services_affected")
    )


@query(
    "empty_window_report",
    f"""WITH {INC}, five AS (SELECT (epoch_us(ts) // 300000000) * 300 AS w, count(*) AS n FROM inc GROUP BY 1),
    g AS (SELECT unnest(generate_series(min(w), max(w), 300)) AS w FROM five)
    SELECT strftime(make_timestamp(g.w * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(coalesce(n, 0) AS BIGINT) AS event_count,
      CASE WHEN n IS NULL THEN 0 ELSE 40 END AS confidence_score, n IS NULL AS is_empty FROM g LEFT JOIN five USING (w)""",
)
def empty_window_report(spark, folder):
    events = incidents(spark, folder).withColumn("batch_id", wn.window_start("ts", 300))
    report = wn.window_report(wn.window_service_summary(events), 300)
    full = wn.with_empty_windows(report, "batch_id", 300)
    return full.select(
        F.date_format("batch_id", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_count", "confidence_score",
        (F.col("overall_assessment") == fixed.EMPTY_ASSESSMENT).alias("is_empty"),
    )


@query(
    "analyze_window",
    f"""WITH {INC}, w AS (SELECT * FROM inc WHERE ts BETWEEN TIMESTAMP '2024-01-20 09:00:00' AND TIMESTAMP '2024-01-20 10:00:00'),
    rep AS (SELECT count(*) AS n, count(DISTINCT service) AS services, count(*) FILTER (severity IN ('high', 'critical')) AS u,
      count(*) FILTER (severity IN ('high', 'critical')) > count(*) * 0.5 AS hot FROM w)
    SELECT CAST(n AS BIGINT) AS event_count, 3600 AS window_seconds, CAST(services AS BIGINT) AS services,
      CASE WHEN n = 0 THEN 'No events in the current window.' ELSE {ASSESSMENT} END AS overall_assessment, {PATTERN} AS critical_pattern,
      CASE WHEN n = 0 THEN '' ELSE {STEPS} END AS recommended_actions, 'low' AS hallucination_risk,
      CASE WHEN n = 0 THEN 0 ELSE 40 END AS confidence_score, false AS llm_used FROM rep""",
)
def analyze_window(spark, folder):
    events = incidents(spark, folder).withColumn("arrival_ts", F.col("ts"))
    report = wn.analyze_window(events, F.lit("2024-01-20 10:00:00").cast("timestamp"), HOUR)
    flat = report.drop("events_by_service", "services_affected")
    return flat.withColumn("recommended_actions", F.array_join("recommended_actions", "|"))


@query(
    "analyze_window_services",
    f"""WITH {INC}, w AS (SELECT * FROM inc WHERE ts BETWEEN TIMESTAMP '2024-01-20 09:00:00' AND TIMESTAMP '2024-01-20 10:00:00'),
    s AS (SELECT service, count(*) AS n, CASE max({{rank}}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS top,
      array_to_string(list_sort(list(DISTINCT incident_type)), ',') AS kinds FROM w GROUP BY service)
    SELECT 'last hour' AS name, coalesce(string_agg(service, ',' ORDER BY service), '') AS services_affected,
      coalesce(string_agg(service || ':' || n || ':' || top || ':' || kinds, ';' ORDER BY service), '') AS events_by_service FROM s
    UNION ALL SELECT 'before all', '', ''""".replace("{rank}", "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"),
)
def analyze_window_services(spark, folder):
    events = incidents(spark, folder).withColumn("arrival_ts", F.col("ts"))
    parts = []
    for name, at in (("last hour", "2024-01-20 10:00:00"), ("before all", "1999-01-01 00:00:00")):
        report = wn.analyze_window(events, F.lit(at).cast("timestamp"), HOUR)
        parts.append(report.select(F.lit(name).alias("name"), "events_by_service", "services_affected"))
    entry = F.transform(
        "events_by_service",
        lambda e: F.concat_ws(":", e["service"], e["count"].cast("string"), e["dominant_severity"], F.array_join(e["incident_types"], ",")),
    )
    both = parts[0].unionByName(parts[1])
    return both.select("name", F.array_join("services_affected", ",").alias("services_affected"), F.array_join(entry, ";").alias("events_by_service"))


@query(
    "full_judge_prompt",
    f"""WITH {HRS}, q AS (SELECT batch_id, service, chr(39) || service || chr(39) AS name, '{{' || chr(39) || 'service' || chr(39) || ': ' || chr(39) || service
          || chr(39) || ', ' || chr(39) || 'count' || chr(39) || ': ' || count || ', ' || chr(39) || 'dominant_severity' || chr(39) || ': ' || chr(39)
          || dominant_severity || chr(39) || ', ' || chr(39) || 'incident_types' || chr(39) || ': ['
          || array_to_string(list_transform(types, lambda x: chr(39) || x || chr(39)), ', ') || ']}}' AS entry FROM w1),
      h AS (SELECT batch_id, string_agg(name, ', ' ORDER BY service) AS names, string_agg(entry, ', ' ORDER BY service) AS entries FROM q GROUP BY batch_id),
      l AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts, record_id) AS no, count(*) OVER (PARTITION BY batch_id) AS total FROM hrs),
      e AS (SELECT batch_id, 'ACTUAL EVENTS (' || total || ' total, showing first ' || least(total, 50) || '):' || chr(10)
        || string_agg(no || '. service=' || service || ' severity=' || severity || ' type=' || incident_type || ' msg='
        || substr(message, 1, 80), chr(10) ORDER BY no) AS lines FROM l WHERE no <= 50 GROUP BY batch_id, total)
    SELECT CAST(batch_id AS BIGINT) AS batch_id, 'BATCH ANALYSIS REPORT:' || chr(10) || 'services_affected: [' || names || ']' || chr(10)
      || 'overall_assessment: ' || {ASSESSMENT} || chr(10) || 'critical_pattern: ' || coalesce({PATTERN}, 'None') || chr(10)
      || 'events_by_service: [' || entries || ']' || chr(10) || chr(10) || lines AS prompt FROM rep JOIN h USING (batch_id) JOIN e USING (batch_id)""",
)
def full_judge_prompt(spark, folder):
    events = hourly(spark, folder)
    summary = wn.window_service_summary(events)
    nested = wn.nested_report(wn.window_report(summary, HOUR), summary)
    return wn.full_judge_prompt(nested, events, "batch_id", ("ts", "record_id"))


@query(
    "window_prompt_lines",
    f"""WITH {HRS}, l AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY ts, record_id) AS line_no, * FROM hrs)
    SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(line_no AS BIGINT) AS line_no, line_no || '. [' || service || '] severity=' || severity
      || ' type=' || incident_type || ' source=' || source_system || ' | ' || substr(message, 1, 120) AS line FROM l
    UNION ALL SELECT batch_id, 0, 'You have received ' || count(*) || ' incident event(s) in the last 60 minutes.' || chr(10)
      || 'Analyze the pattern and identify what is happening across all services.' || chr(10) || chr(10) || 'INCIDENTS:'
      FROM hrs GROUP BY batch_id""",
)
def window_prompt_lines(spark, folder):
    events = hourly(spark, folder).select(
        "batch_id", "ts", "record_id", "service", "severity", "incident_type", "source_system", "message"
    )
    return wn.window_prompt_lines(events, HOUR, "batch_id", ("ts", "record_id"))


@query(
    "judge_prompt",
    f"""WITH {INC}, d AS (SELECT epoch_us(ts) // 86400000000 AS batch_id, * FROM inc),
    l AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts, record_id) AS no, count(*) OVER (PARTITION BY batch_id) AS total FROM d)
    SELECT CAST(batch_id AS BIGINT) AS batch_id, 'ACTUAL EVENTS (' || total || ' total, showing first ' || least(total, 50) || '):' || chr(10)
      || string_agg(no || '. service=' || service || ' severity=' || severity || ' type=' || incident_type || ' msg='
      || substr(message, 1, 80), chr(10) ORDER BY no) AS prompt FROM l WHERE no <= 50 GROUP BY batch_id, total""",
)
def judge_prompt(spark, folder):
    events = incidents(spark, folder).withColumn("batch_id", F.floor(F.unix_seconds("ts") / 86400))
    return wn.judge_prompt(events, "batch_id", ("ts", "record_id"))


# --- grounding --------------------------------------------------------------------------------------
def claims(spark, folder):
    """Reports of hours as claims: odd hours are checked against the next hour, some name ghosts."""
    summary = wn.window_service_summary(hourly(spark, folder))
    nested = wn.nested_report(wn.window_report(summary, HOUR), summary)
    types = F.sort_array(F.array_distinct(F.flatten("events_by_service.incident_types")))
    ghost = F.col("batch_id") % 24 % 5 == 0
    first = F.concat(F.lit("Errors in "), F.upper(F.col("services_affected")[0]))
    return nested.select(
        "batch_id",
        F.when(ghost, F.concat("services_affected", F.array(F.lit("ghost-a"), F.lit("ghost-a")))).otherwise(F.col("services_affected")).alias("services_affected"),
        F.when(ghost, F.concat(types, F.array(F.lit("ghost_type")))).otherwise(types).alias("claimed_types"),
        "overall_assessment",
        F.when(ghost, "ghost-database corruption detected").when(F.col("batch_id") % 4 == 1, first).otherwise(F.col("critical_pattern")).alias("critical_pattern"),
    )


def batch_events(spark, folder):
    """Each hour belongs to the batch of its own report and to that of the report of the hour before."""
    events = hourly(spark, folder)
    return events.withColumn("batch_id", F.explode(F.array("batch_id", F.col("batch_id") - 1)))


def judge_rows(spark, folder):
    """Judge answers for every third hour; some broken, some with a score out of bounds or a wrong verdict."""
    h, n = F.col("batch_id"), F.col("event_count")
    report = wn.window_report(wn.window_service_summary(hourly(spark, folder)), HOUR).where(h % 3 == 0)
    claims_json = F.when(h % 2 == 0, '["too vague"]').when(h % 9 == 0, '"none"').otherwise("[]")
    text = F.concat(
        F.lit('{"faithfulness_score": '), (n * 7 % 160).cast("string"), F.lit(', "ungrounded_claims": '), claims_json,
        F.lit(', "verdict": "unsure"}'),
    )
    return report.select("batch_id", F.when(h % 15 == 0, F.substring(text, 1, 30)).otherwise(text).alias("judge_json"))


GND = HRS + f""",
lists AS (SELECT batch_id, list_sort(list(DISTINCT service)) AS services, list_sort(list(DISTINCT incident_type)) AS types FROM hrs GROUP BY batch_id),
claim AS (
  SELECT batch_id, batch_id % 24 % 5 = 0 AS ghost, n,
    CASE WHEN batch_id % 24 % 5 = 0 THEN list_concat(l.services, ['ghost-a', 'ghost-a']) ELSE l.services END AS c_services,
    CASE WHEN batch_id % 24 % 5 = 0 THEN list_concat(l.types, ['ghost_type']) ELSE l.types END AS c_types,
    {ASSESSMENT.replace("services", "rep.services")} AS assessment,
    CASE WHEN batch_id % 24 % 5 = 0 THEN 'ghost-database corruption detected'
         WHEN batch_id % 4 = 1 THEN 'Errors in ' || upper(l.services[1]) ELSE {PATTERN} END AS pattern
  FROM rep JOIN lists l USING (batch_id)),
fact AS (
  SELECT c.batch_id, count(h.record_id) AS events, count(*) FILTER (h.severity IN ('high', 'critical')) AS urgent,
    coalesce(list(DISTINCT h.service) FILTER (h.service IS NOT NULL), []) AS services,
    coalesce(list(DISTINCT h.incident_type) FILTER (h.service IS NOT NULL), []) AS types
  FROM claim c LEFT JOIN hrs h ON h.batch_id IN (c.batch_id, c.batch_id + 1) GROUP BY c.batch_id),
chk AS (
  SELECT *, list_filter(c_services, lambda x: NOT list_contains(services, x)) AS bad_services,
    list_filter(c_types, lambda x: NOT list_contains(types, x)) AS bad_types,
    pattern IS NULL OR len(list_filter(list_concat(services, types), lambda e: contains(lower(pattern), lower(e)))) > 0 AS pattern_ok,
    regexp_matches(lower(assessment), 'critical|urgent|immediate|severe|emergency') AS says
  FROM claim JOIN fact USING (batch_id)),
rat AS (
  SELECT *, round_even((len(c_services) - len(bad_services)) / len(c_services), 3) AS services_ratio,
    round_even((len(c_types) - len(bad_types)) / len(c_types), 3) AS types_ratio,
    CASE WHEN events = 0 THEN true WHEN urgent / events >= 0.5 AND NOT says THEN false
         WHEN urgent / events < 0.2 AND says THEN false ELSE true END AS severity_ok FROM chk),
sco AS (
  SELECT *, CAST(trunc(services_ratio * 40 + types_ratio * 30 + CASE WHEN pattern_ok THEN 10 ELSE 0 END
    + CASE WHEN severity_ok THEN 20 ELSE 0 END) AS INTEGER) AS rule_score,
    list_concat(list_transform(bad_services, lambda x: 'Service ''' || x || ''' mentioned but not found in events'),
      list_transform(list_sort(bad_types), lambda x: 'Incident type ''' || x || ''' mentioned but not observed in events'),
      CASE WHEN pattern_ok THEN [] ELSE ['critical_pattern references entities not found in events'] END,
      CASE WHEN severity_ok THEN [] ELSE ['overall_assessment severity inconsistent with actual event distribution'] END) AS claims
  FROM rat),
fin AS (
  SELECT *, CASE WHEN batch_id % 3 = 0 AND batch_id % 15 <> 0 THEN CAST(least(n * 7 % 160, 100) AS INTEGER) END AS judge FROM sco),
res AS (
  SELECT *, CASE WHEN judge IS NULL THEN rule_score ELSE (rule_score + judge) // 2 END AS score,
    CASE WHEN judge IS NOT NULL AND batch_id % 2 = 0 THEN ['too vague'] ELSE claims END AS final_claims FROM fin)"""

VERDICT = "CASE WHEN {0} >= 80 THEN 'faithful' WHEN {0} >= 40 THEN 'partially_faithful' ELSE 'hallucinated' END"


@query(
    "event_facts",
    f"""WITH {HRS}, b AS (SELECT unnest([batch_id, batch_id - 1]) AS batch_id, severity, service, incident_type FROM hrs)
    SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS event_count,
      CAST(count(*) FILTER (severity IN ('high', 'critical')) AS BIGINT) AS urgent_count,
      CAST(count(DISTINCT service) AS BIGINT) AS services, CAST(count(DISTINCT incident_type) AS BIGINT) AS types FROM b GROUP BY batch_id""",
)
def event_facts(spark, folder):
    return gr.event_facts(batch_events(spark, folder))


@query(
    "services_grounding",
    f"""WITH {GND} SELECT CAST(batch_id AS BIGINT) AS batch_id, (len(c_services) - len(bad_services)) / len(c_services) AS service_ratio,
      array_to_string(bad_services, ',') AS ungrounded_services FROM chk""",
)
def services_grounding(spark, folder):
    checked = gr.services_grounding(claims(spark, folder), gr.event_entities(batch_events(spark, folder)))
    return checked.withColumn("ungrounded_services", F.array_join("ungrounded_services", ","))


@query(
    "types_grounding",
    f"""WITH {GND} SELECT CAST(batch_id AS BIGINT) AS batch_id, (len(c_types) - len(bad_types)) / len(c_types) AS type_ratio,
      array_to_string(list_sort(bad_types), ',') AS ungrounded_types FROM chk""",
)
def types_grounding(spark, folder):
    checked = gr.types_grounding(claims(spark, folder), gr.event_entities(batch_events(spark, folder)))
    return checked.withColumn("ungrounded_types", F.array_join("ungrounded_types", ","))


@query(
    "pattern_grounding",
    f"WITH {GND} SELECT CAST(batch_id AS BIGINT) AS batch_id, pattern_ok AS pattern_grounded FROM chk WHERE pattern IS NOT NULL",
)
def pattern_grounding(spark, folder):
    return gr.pattern_grounding(claims(spark, folder), gr.event_entities(batch_events(spark, folder)))


@query(
    "rule_checks",
    f"""WITH {GND} SELECT CAST(batch_id AS BIGINT) AS batch_id, services_ratio, types_ratio, pattern_ok AS pattern_grounded,
      severity_ok AS severity_consistent, rule_score, {VERDICT.format('rule_score')} AS rule_verdict,
      array_to_string(claims, '|') AS ungrounded_claims FROM sco""",
)
def rule_checks(spark, folder):
    checked = gr.rule_checks(claims(spark, folder), batch_events(spark, folder))
    return checked.withColumn("ungrounded_claims", F.array_join("ungrounded_claims", "|"))


@query(
    "parse_judge",
    f"""WITH {GND} SELECT CAST(batch_id AS BIGINT) AS batch_id, judge AS judge_score, CASE WHEN batch_id % 2 = 0 THEN 'too vague' ELSE '' END AS judge_claims,
      {VERDICT.format('judge')} AS judge_verdict FROM fin WHERE judge IS NOT NULL""",
)
def parse_judge(spark, folder):
    return gr.parse_judge(judge_rows(spark, folder)).withColumn("judge_claims", F.array_join("judge_claims", "|"))


@query(
    "faithfulness",
    f"""WITH {GND} SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(score AS INTEGER) AS faithfulness_score, {VERDICT.format('score')} AS verdict,
      services_ratio, types_ratio, pattern_ok AS pattern_grounded, severity_ok AS severity_consistent,
      array_to_string(final_claims, '|') AS ungrounded_claims, judge IS NOT NULL AS llm_used FROM res""",
)
def faithfulness(spark, folder):
    done = gr.faithfulness(claims(spark, folder), batch_events(spark, folder), judge_rows(spark, folder))
    return done.withColumn("ungrounded_claims", F.array_join("ungrounded_claims", "|"))


@query(
    "parse_window_reports",
    f"""WITH {HRS}, p AS (SELECT batch_id, n, services, u, hot, batch_id % 7 = 0 OR batch_id % 11 = 5 AS broken FROM rep),
    names AS (SELECT batch_id, string_agg(service, ',' ORDER BY service) AS all_services FROM w1 GROUP BY batch_id)
    SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(n AS BIGINT) AS event_count,
      CASE WHEN broken THEN all_services WHEN batch_id % 2 = 0 THEN 'svc-1' ELSE all_services END AS services_affected,
      CASE WHEN broken THEN {ASSESSMENT} WHEN batch_id % 3 = 0 THEN 'Analysis unavailable.' ELSE 'Seen ' || n END AS overall_assessment,
      CASE WHEN broken THEN {PATTERN} ELSE 'p' || n END AS critical_pattern,
      CAST(CASE WHEN broken THEN services WHEN batch_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS entries,
      CASE WHEN broken THEN 'low' WHEN batch_id % 5 = 0 THEN 'high' ELSE 'medium' END AS hallucination_risk,
      CAST(CASE WHEN broken THEN 40 ELSE least(n * 5, 100) END AS INTEGER) AS confidence_score, NOT broken AS llm_used
    FROM p JOIN names USING (batch_id)""",
)
def parse_reports(spark, folder):
    summary = wn.window_service_summary(hourly(spark, folder))
    nested = wn.nested_report(wn.window_report(summary, HOUR), summary)
    h, n = F.col("batch_id"), F.col("event_count").cast("string")
    good = '{"service": "svc-1", "count": 2, "dominant_severity": "high", "incident_types": ["a"]}'
    bad = '{"service": "svc-2", "count": 2, "dominant_severity": "fatal", "incident_types": ["a"]}, {"service": 5}'
    text = F.concat(
        F.lit('{"critical_pattern": "p'), n, F.lit('", '),
        F.when(h % 3 != 0, F.concat(F.lit('"overall_assessment": "Seen '), n, F.lit('", '))).otherwise(""),
        F.lit('"events_by_service": ['), F.when(h % 2 == 0, f"{good}, {bad}").otherwise(bad), F.lit("], "),
        F.when(h % 5 == 0, '"hallucination_risk": "high", ').otherwise('"hallucination_risk": "extreme", '),
        F.lit('"confidence_score": '), F.when(h % 11 == 5, '"many"').otherwise((F.col("event_count") * 5).cast("string")), F.lit("}"),
    )
    reports = nested.select("batch_id", F.when(h % 7 == 0, F.substring(text, 1, 25)).otherwise(text).alias("report_json"))
    done = parse_window_reports(reports, nested)
    return done.select(
        "batch_id", "event_count", F.array_join("services_affected", ",").alias("services_affected"), "overall_assessment",
        "critical_pattern", F.size("events_by_service").alias("entries"), "hallucination_risk", "confidence_score", "llm_used",
    )


# --- retrieval --------------------------------------------------------------------------------------
def vectors(spark, folder):
    """Embeddings as stored records: vector i belongs to incident i."""
    number = F.lpad(F.col("vec_id").cast("string"), 12, "0")
    return table(spark, folder, "embeddings").select(F.concat(F.lit("rec_"), number).alias("record_id"), "embedding")


def neighbours(spark, folder, k=3):
    stored = vectors(spark, folder)
    return sm.similar_incidents_ivf(stored.withColumnRenamed("record_id", "query_id"), stored, k, exact=True)


def stored_records(spark, folder):
    rec = evaluate_incidents(records(spark, folder).drop("status", "score", "summary", "reasoning", "suggested_action", "tags"))
    return rec


VECTORS = """
vec AS (SELECT 'rec_' || lpad(CAST(vec_id AS VARCHAR), 12, '0') AS record_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nrm AS (SELECT record_id, e, sqrt(list_inner_product(e, e)) AS n FROM vec)"""

VEC = VECTORS + """,
dst AS (SELECT a.record_id AS query_id, b.record_id, round(1 - list_inner_product(a.e, b.e) / (a.n * b.n), 12) AS d
  FROM nrm a JOIN nrm b ON a.record_id <> b.record_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, record_id) AS rank FROM dst QUALIFY rank <= 3)"""


@query(
    "cosine_distance",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT a.vec_id, round(1 - list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) AS distance
    FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
)
def cosine_distance(spark, folder):
    v = table(spark, folder, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(sm.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


NEAREST = f"""WITH {VEC} SELECT query_id, CAST(rank AS INTEGER) AS rank, record_id, round(d, 6) AS distance,
      round_even(greatest(0, 1 - d / 2), 3) AS similarity FROM knn"""


@query("similar_incidents", NEAREST)
def similar_incidents(spark, folder):
    stored = vectors(spark, folder)
    found = sm.similar_incidents(stored.withColumnRenamed("record_id", "query_id"), stored)
    return found.withColumn("distance", F.round("distance", 6))


@query("similar_by_codes", NEAREST)
def similar_by_codes(spark, folder):
    stored = vectors(spark, folder)
    found = codes.similar_by_codes(stored.withColumnRenamed("record_id", "query_id"), stored)
    return found.withColumn("distance", F.round("distance", 6))


@query("full_comparisons", f"""WITH {VECTORS} SELECT CAST(count(*) * sum(least(copies, 4)) AS BIGINT) AS pairs, true AS few
      FROM (SELECT e, count(*) AS copies FROM nrm GROUP BY e)""")
def full_comparisons(spark, folder):
    """Pairs of vectors, and whether the codes leave less than a twentieth of them to be compared in full."""
    stored = vectors(spark, folder)
    found = codes.compared(stored.withColumnRenamed("record_id", "query_id"), stored)
    return found.select("pairs", (F.col("compared") < 0.05 * F.col("pairs")).alias("few"))


def with_recall(spark, folder, search):
    """How many of all true neighbours `search` finds, and whether that is nine tenths of them."""
    stored = vectors(spark, folder)
    asked = stored.withColumnRenamed("record_id", "query_id")
    found = sm.recall(search(asked, stored), sm.similar_incidents(asked, stored))
    return found.select("expected", (F.col("recall") >= 0.9).alias("reached"))


REACHED = f"WITH {VEC} SELECT count(*) AS expected, true AS reached FROM knn"


@query("ivf_recall", REACHED)
def ivf_recall(spark, folder):
    # small cells, so that the small tables have many too
    return with_recall(spark, folder, lambda asked, stored: sm.similar_incidents_ivf(asked, stored, per_cell=32))


@query("similar_incidents_lsh")
def similar_incidents_lsh(spark, folder):
    stored = vectors(spark, folder)
    return sm.similar_incidents_lsh(stored.withColumnRenamed("record_id", "query_id"), stored)


@query("lsh_recall", REACHED)
def lsh_recall(spark, folder):
    return with_recall(spark, folder, sm.similar_incidents_lsh)


CONTEXT = """
blk AS (SELECT query_id, string_agg('### Incident ' || rank || ' (similarity: ' || printf('%.0f', round_even(greatest(0, 1 - d / 2), 3) * 100) || '%)' || chr(10)
    || '- **Workflow:** ' || workflow || chr(10) || '- **Type / Severity:** ' || incident_type || ' / ' || severity || chr(10)
    || '- **Evaluation:** ' || status || ' (score ' || score || ')' || chr(10) || '- **Summary:** ' || summary || chr(10)
    || '- **Action taken:** ' || suggested_action || chr(10), chr(10) ORDER BY rank) AS body
  FROM knn JOIN ruled USING (record_id) GROUP BY query_id),
ctx AS (SELECT query_id, '## Historical Context — Similar Past Incidents' || chr(10) || chr(10)
    || 'The following incidents from the operational history are semantically similar' || chr(10)
    || 'to the current one and may provide useful signal for evaluation:' || chr(10) || chr(10) || body AS context FROM blk)"""

RET = REC + "," + VEC + """,
band AS (SELECT *, severity IN ('high', 'critical') AS up FROM rec),
ruled AS (SELECT * REPLACE (
    CASE WHEN incident_type = 'schema_error' OR (incident_type = 'technical_error' AND up) THEN 'critical' ELSE 'needs_attention' END AS status,
    CASE incident_type WHEN 'schema_error' THEN CASE WHEN up THEN 85 ELSE 70 END
      WHEN 'technical_error' THEN CASE WHEN up THEN 80 ELSE 60 END
      WHEN 'semantic_error' THEN CASE WHEN up THEN 65 ELSE 50 END ELSE CASE WHEN up THEN 70 ELSE 55 END END AS score,
    CASE incident_type WHEN 'schema_error' THEN 'inspect_schema' WHEN 'technical_error' THEN CASE WHEN up THEN 'check_provider' ELSE 'monitor' END
      WHEN 'semantic_error' THEN 'inspect_prompt' ELSE 'monitor' END AS suggested_action),
  CASE incident_type WHEN 'schema_error' THEN 'Schema validation failure detected in the workflow.'
      WHEN 'technical_error' THEN CASE WHEN up THEN 'Critical technical failure detected in the workflow.' ELSE 'Technical issue detected in the workflow.' END
      WHEN 'semantic_error' THEN 'Semantic quality issue detected in the workflow output.' ELSE 'Workflow degradation detected.' END AS summary
  FROM band),
""" + CONTEXT


@query("retrieval_context", f"WITH {RET} SELECT query_id, context FROM ctx")
def retrieval_context(spark, folder):
    return sm.retrieval_context(sm.with_records(neighbours(spark, folder), stored_records(spark, folder)))


@query(
    "rag_evaluate",
    f"""WITH {RET} SELECT r.record_id, context IS NOT NULL AS context_used,
      CAST(coalesce(length(context), 0) AS INTEGER) AS context_length FROM ruled r LEFT JOIN ctx ON ctx.query_id = r.record_id""",
)
def rag_evaluate(spark, folder):
    rec = stored_records(spark, folder)
    contexts = sm.retrieval_context(sm.with_records(neighbours(spark, folder), rec))
    done = sm.rag_evaluate(rec.withColumn("_before", F.length("reasoning")), contexts)
    extra = F.when(F.col("context_used"), F.length("reasoning") - F.col("_before") - 2).otherwise(0)
    return done.select("record_id", "context_used", extra.cast("int").alias("context_length"))


@query(
    "retrieval_outcome",
    f"""WITH {REC}, {VEC}, c AS (SELECT record_id, count(knn.query_id) AS found FROM (SELECT record_id FROM rec) r
      LEFT JOIN (SELECT query_id FROM knn) knn ON knn.query_id = r.record_id GROUP BY record_id)
    SELECT CASE WHEN found > 0 THEN 'hit' ELSE 'miss' END AS retrieval, CAST(found AS BIGINT) AS found, CAST(count(*) AS BIGINT) AS queries
    FROM c GROUP BY ALL""",
)
def retrieval_outcome(spark, folder):
    asked = records(spark, folder).select(F.col("record_id").alias("query_id"))
    return sm.retrieval_outcome(asked, neighbours(spark, folder))


@query(
    "neighbour_action_profile",
    f"""WITH {RET}, n AS (SELECT query_id, suggested_action, count(*) AS c FROM knn JOIN ruled USING (record_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, suggested_action) AS rn, sum(c) OVER (PARTITION BY query_id) AS all_n FROM n)
    SELECT query_id, suggested_action AS action, CAST(c AS BIGINT) AS cases, CAST(all_n AS BIGINT) AS neighbours FROM r WHERE rn = 1""",
)
def neighbour_action_profile(spark, folder):
    return sm.neighbour_action_profile(sm.with_records(neighbours(spark, folder), stored_records(spark, folder)))


@query(
    "index_rows",
    f"""WITH {RET} SELECT record_id, 'workflow: ' || workflow || ' | stage: ' || stage || ' | incident_type: ' || incident_type
      || ' | severity: ' || severity || ' | category: ' || category || ' | source: ' || source || ' | message: ' || message AS text,
      workflow AS meta_workflow, summary AS meta_summary FROM ruled""",
)
def index_rows(spark, folder):
    rec = stored_records(spark, folder)
    rows = sm.index_rows(rec, incident_text(rec))
    return rows.select(
        "record_id", "text", F.col("metadata")["workflow"].alias("meta_workflow"), F.col("metadata")["summary"].alias("meta_summary")
    )


@query(
    "store_embeddings",
    f"""WITH {REC}, {VEC} SELECT rec.record_id, status, CAST(len(e) AS INTEGER) AS dimensions FROM rec LEFT JOIN vec USING (record_id)""",
)
def store_embeddings(spark, folder):
    stored = sm.store_embeddings(records(spark, folder), vectors(spark, folder))
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return stored.select("record_id", "status", size.alias("dimensions"))
