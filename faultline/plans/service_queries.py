"""Queries: service levels, alert states and reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import fixed
from faultline.operators import cooldown as cd
from faultline.operators import reliability as rl
from faultline.operators import slo
from faultline.plans.registry import query
from faultline.plans.workload import INC, REC, incidents, records, sql_stamp, stamp, table

MINUTE = 60
def latency():
    """Event values as seconds, mostly below one."""
    return F.col("value") / 400


# --- SQL for steps ----------------------------------------------------------------------------------
def grid(source: str, step: int, window: int, measures: dict[str, str], by: str | None = None, ts: str = "ts") -> str:
    """CTEs ending in `tr`: (label, tick, trailing sums) on a dense grid."""
    label = by or "'all'"
    sums = ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in measures.items())
    zero = ", ".join(f"coalesce({n}, 0) AS {n}" for n in measures)
    trail = ", ".join(f"CAST(sum({n}) OVER w AS BIGINT) AS {n}" for n in measures)
    return f"""
cnt AS (SELECT {label} AS label, ((epoch_us({ts}) + {step * 1000000 - 1}) // {step * 1000000}) * {step} AS tick, {sums}
  FROM {source} GROUP BY 1, 2),
lab AS (SELECT DISTINCT label FROM cnt),
tik AS (SELECT unnest(generate_series(min(tick), max(tick), {step})) AS tick FROM cnt),
den AS (SELECT label, tick, {zero} FROM lab CROSS JOIN tik LEFT JOIN cnt USING (label, tick)),
tr AS (SELECT label, tick, {trail} FROM den
  WINDOW w AS (PARTITION BY label ORDER BY tick RANGE BETWEEN {window - step} PRECEDING AND CURRENT ROW))"""


def quantile_sql(q: float, bounds, total: str = "n") -> str:
    """Interpolated bucket quantile over columns b0, b1, ..."""
    parts, low, below = [f"WHEN {total} = 0 THEN NULL"], 0.0, "0"
    for i, bound in enumerate(bounds):
        bound = float(bound)
        value = f"CAST({bound!r} AS DOUBLE)" if bound <= 0 else (
            f"CAST({low!r} AS DOUBLE) + CAST({bound - low!r} AS DOUBLE) * (({total} * CAST({q!r} AS DOUBLE) - {below}) / (b{i} - {below}))"
        )
        parts.append(f"WHEN b{i} >= {total} * CAST({q!r} AS DOUBLE) THEN {value}")
        low, below = bound, f"b{i}"
    return f"CASE {' '.join(parts)} ELSE CAST({float(bounds[-1])!r} AS DOUBLE) END"


def buckets_sql(value: str, bounds) -> dict[str, str]:
    return {f"b{i}": f"{value} <= CAST({float(b)!r} AS DOUBLE)" for i, b in enumerate(bounds)} | {"n": f"{value} IS NOT NULL"}


def states_sql(condition: str, hold: int, step: int, extra: str = "") -> str:
    """Alert states from `tr`: the run of true steps starts one step after the last false one."""
    return f"""
cond AS (SELECT label, tick, coalesce({condition}, false) AS breached{extra} FROM tr),
runs AS (SELECT *, max(CASE WHEN NOT breached THEN tick END) OVER (PARTITION BY label ORDER BY tick) AS last_false,
  min(tick) OVER (PARTITION BY label) AS first_tick FROM cond),
sts AS (SELECT *, coalesce(last_false + {step}, first_tick) AS since FROM runs),
states AS (SELECT label, tick, breached, CASE WHEN NOT breached THEN 'inactive' WHEN tick - since >= {hold} THEN 'firing' ELSE 'pending' END AS state,
  CASE WHEN breached THEN since END AS active_since{extra and ', value'} FROM sts)"""


STATE_COLUMNS = "CAST(tick AS BIGINT) AS tick, breached, state, CAST(active_since AS BIGINT) AS active_since"


# --- counters and histograms ------------------------------------------------------------------------
@query(
    "counter_by_label",
    f"""WITH {REC}, c AS (SELECT status, ((epoch_us(received_at) + 3599999999) // 3600000000) * 3600 AS tick, count(*) AS n FROM rec GROUP BY ALL)
    SELECT status, CAST(tick AS BIGINT) AS tick, CAST(n AS BIGINT) AS n,
      CAST(sum(n) OVER (PARTITION BY status ORDER BY tick) AS BIGINT) AS total FROM c""",
)
def counter_by_label(spark, folder):
    return slo.counter_by_label(records(spark, folder), "received_at", 3600, ["status"])


def _counter(name: str, source: str, ts: str, labels: dict[str, str], build) -> None:
    """A counter of its own labels: running totals at the hours with an increment."""
    names = "".join(f"{n}, " for n in labels)
    shown = "".join(f"{e} AS {n}, " for n, e in labels.items())
    over = f"PARTITION BY {names[:-2]} ORDER BY tick" if labels else "ORDER BY tick"
    sql = f"""WITH {REC}, {HOURLY_REPORT}, c AS (SELECT {shown}((epoch_us({ts}) + 3599999999) // 3600000000) * 3600 AS tick, count(*) AS n FROM {source} GROUP BY ALL)
      SELECT {names}CAST(tick AS BIGINT) AS tick, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER ({over}) AS BIGINT) AS total FROM c"""

    @query(name, sql)
    def run(spark, folder):
        return slo.counter_by_label(build(spark, folder), "at", 3600, list(labels))


# one batch report per hour with events
HOURLY_REPORT = """hour AS (SELECT date_trunc('hour', received_at) AS began, 'low' AS hallucination_risk, 'false' AS llm_used FROM rec GROUP BY 1)"""


def _reports(spark, folder):
    from faultline.operators import windows as wn

    events = incidents(spark, folder).withColumn("batch_id", F.date_trunc("hour", "ts"))
    report = wn.window_report(wn.window_service_summary(events), 3600)
    return report.select(F.col("batch_id").alias("at"), "hallucination_risk", F.col("llm_used").cast("string").alias("llm_used"))


def _retrievals(spark, folder):
    hit = F.when(F.col("event_id") % 6 > 1, "hit").otherwise("miss")
    return records(spark, folder).select(F.col("received_at").alias("at"), hit.alias("retrieval"))


def _actions(spark, folder):
    from faultline.operators.evaluate import dispatch_actions

    done = dispatch_actions(records(spark, folder))
    return done.select(F.col("executed_at").alias("at"), "action_type", "outcome")


_counter("counter_retrievals", "rec", "received_at", {"retrieval": "CASE WHEN event_id % 6 > 1 THEN 'hit' ELSE 'miss' END"}, _retrievals)
_counter("counter_actions", "rec WHERE suggested_action IS NOT NULL", "received_at", {"action_type": "suggested_action", "outcome": "'success'"}, _actions)
_counter("counter_batch_runs", "hour", "began", {"hallucination_risk": "hallucination_risk", "llm_used": "llm_used"}, _reports)
_counter("counter_loop_iterations", "rec", "received_at", {}, lambda spark, folder: records(spark, folder).select(F.col("received_at").alias("at")))
_counter("counter_loop_errors", "rec WHERE event_type = 'error'", "received_at", {},
         lambda spark, folder: records(spark, folder).where("event_type = 'error'").select(F.col("received_at").alias("at")))


def _histogram(name: str, column: str, expression: str, bounds, build):
    cases = " UNION ALL ".join(
        f"SELECT workflow, CAST({float(b)!r} AS DOUBLE) AS le, count(*) FILTER (v <= CAST({float(b)!r} AS DOUBLE)) AS count FROM s GROUP BY workflow"
        for b in bounds
    )
    sql = f"""WITH {REC}, s AS (SELECT workflow, {expression} AS v FROM rec), h AS ({cases}
      UNION ALL SELECT workflow, CAST('Infinity' AS DOUBLE), count(v) FROM s GROUP BY workflow)
      SELECT h.workflow, le, CAST(h.count AS BIGINT) AS count, t.total AS sum FROM h
      JOIN (SELECT workflow, CAST(sum(CAST(v AS DECIMAL(24,6))) AS DOUBLE) AS total FROM s GROUP BY workflow) t USING (workflow)"""

    @query(name, sql)
    def run(spark, folder):
        return slo.histogram_buckets(records(spark, folder), build(), bounds, ["workflow"])


_histogram("histogram_score", "score", "score", fixed.SCORE_BOUNDS, lambda: F.col("score"))
_histogram("histogram_retrieval_latency", "value", "value / 400", fixed.RETRIEVAL_BOUNDS, latency)
_histogram("histogram_embedding_latency", "value", "value / 400", fixed.EMBEDDING_BOUNDS, latency)
_histogram("histogram_found", "event_id", "event_id % 6", fixed.FOUND_BOUNDS, lambda: F.col("event_id") % 6)
_histogram("histogram_batch_events", "k", "k", fixed.BATCH_EVENT_BOUNDS, lambda: F.col("k"))
_histogram("histogram_faithfulness", "k", "k", fixed.FAITHFULNESS_BOUNDS, lambda: F.col("k"))


# --- rates --------------------------------------------------------------------------------------------
@query(
    "rate",
    f"WITH {INC}, {grid('inc', MINUTE, 300, {'n': 'true'}, 'event_type')} SELECT label AS event_type, CAST(tick AS BIGINT) AS tick, n / 300 AS rate FROM tr",
)
def rate(spark, folder):
    return slo.rate(incidents(spark, folder), "ts", MINUTE, 300, ["event_type"])


@query(
    "rate_per_minute",
    f"WITH {INC}, {grid('inc', MINUTE, 300, {'n': 'true'})} SELECT CAST(tick AS BIGINT) AS tick, n * 60 / 300 AS rate FROM tr",
)
def rate_per_minute(spark, folder):
    return slo.rate(incidents(spark, folder), "ts", MINUTE, 300, [], per=60)


@query(
    "increase_by_status",
    f"WITH {REC}, {grid('rec', 300, 3600, {'n': 'true'}, 'status', 'received_at')} SELECT label AS status, CAST(tick AS BIGINT) AS tick, n FROM tr",
)
def increase_by_status(spark, folder):
    return slo.increase(records(spark, folder), "received_at", 300, 3600, ["status"], {"n": F.lit(True)})


@query(
    "counter_increase",
    f"""WITH {INC}, s AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c, lag(CAST(round(value * 100) AS BIGINT)) OVER
        (PARTITION BY event_type ORDER BY ts) AS p FROM inc)
    SELECT event_type, CAST(count(*) AS BIGINT) AS samples, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN c < p THEN c ELSE c - p END) AS BIGINT) AS increase
    FROM s GROUP BY event_type""",
)
def counter_increase(spark, folder):
    samples = incidents(spark, folder).select("event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("c"))
    return slo.counter_increase(samples, ["event_type"], "ts", "c")


@query(
    "quantile_panels",
    f"""WITH {REC}, {grid('rec', 300, 3600, buckets_sql('score', fixed.SCORE_BOUNDS), None, 'received_at')}
    SELECT CAST(tick AS BIGINT) AS tick, {quantile_sql(0.5, fixed.SCORE_BOUNDS)} AS p50, {quantile_sql(0.95, fixed.SCORE_BOUNDS)} AS p95,
      {quantile_sql(0.99, fixed.SCORE_BOUNDS)} AS p99 FROM tr""",
)
def quantile_panels(spark, folder):
    return slo.trailing_quantiles(
        records(spark, folder), "received_at", 300, 3600, F.col("score"), fixed.SCORE_BOUNDS, {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    )


@query(
    "score_heatmap",
    f"""WITH {REC}, {grid('rec', 300, 900, buckets_sql('score', fixed.SCORE_BOUNDS), None, 'received_at')}
    """ + " UNION ALL ".join(
        f"SELECT CAST(tick AS BIGINT) AS tick, CAST({float(b)!r} AS DOUBLE) AS le, (b{i} - {f'b{i - 1}' if i else '0'}) / 900 AS rate FROM tr"
        for i, b in enumerate(fixed.SCORE_BOUNDS)
    ) + f" UNION ALL SELECT CAST(tick AS BIGINT), CAST('Infinity' AS DOUBLE), (n - b{len(fixed.SCORE_BOUNDS) - 1}) / 900 FROM tr",
)
def score_heatmap(spark, folder):
    return slo.bucket_heatmap(records(spark, folder), "received_at", 300, 900, F.col("score"), fixed.SCORE_BOUNDS)


# --- service level alerts -------------------------------------------------------------------------------
def _share_alert(name, source, ts, window, part, test, hold, spark_part, above=None, below=None, whole="true", spark_whole=None):
    sql = f"""WITH {REC}, {grid(source, MINUTE, window, {'p': part, 'n': whole}, None, ts)},
      {states_sql(f"CASE WHEN n > 0 THEN p / n END {test}", hold, MINUTE, ", CASE WHEN n > 0 THEN p / n END AS value")}
      SELECT {STATE_COLUMNS}, value FROM states"""

    @query(name, sql)
    def run(spark, folder):
        values = slo.share(records(spark, folder), "received_at", MINUTE, window, spark_part(), (), spark_whole and spark_whole())
        return slo.alert_state(slo.breached(values, above, below), hold).select("tick", "breached", "state", "active_since", "value")


_share_alert("alert_error_ratio", "rec", "received_at", 300, "event_type = 'error'", "> 0.01", 120,
             lambda: F.col("event_type") == "error", above=0.01)
_share_alert("alert_retrieval_hit_rate", "rec", "received_at", 900, "event_id % 6 > 1", "< 0.6", 600,
             lambda: F.col("event_id") % 6 > 1, below=0.6)
_share_alert("alert_critical_share", "rec", "received_at", 600, "status = 'critical'", "> 0.5", 300,
             lambda: F.col("status") == "critical", above=0.5)
_share_alert("alert_loop_error_ratio", "rec", "received_at", 300, "event_type = 'error'", "> 0.1", 300,
             lambda: F.col("event_type") == "error", above=0.1, whole="event_type IN ('error', 'view')",
             spark_whole=lambda: F.col("event_type").isin("error", "view"))

# handler -> (limit in seconds, hold)
LATENCY_SLO = {"click": (0.5, 180), "view": (0.3, 180), "purchase": (0.2, 300)}


def _latency_sql() -> str:
    limit = "CASE label " + " ".join(f"WHEN '{h}' THEN {v}" for h, (v, _) in LATENCY_SLO.items()) + " END"
    hold = "CASE label " + " ".join(f"WHEN '{h}' THEN {s}" for h, (_, s) in LATENCY_SLO.items()) + " END"
    q = quantile_sql(0.95, fixed.RETRIEVAL_BOUNDS)
    grid_sql = grid("slow", MINUTE, 300, buckets_sql("value / 400", fixed.RETRIEVAL_BOUNDS), "event_type")
    return f"""WITH {INC}, slow AS (SELECT * FROM inc WHERE event_type IN ('click', 'view', 'purchase')), {grid_sql},
      {states_sql(f"{q} > {limit}", 0, MINUTE).replace("tick - since >= 0", f"tick - since >= {hold}")}
      SELECT label AS event_type, {STATE_COLUMNS} FROM states"""


@query("alert_latency", _latency_sql())
def alert_latency(spark, folder):
    rows = incidents(spark, folder).where(F.col("event_type").isin(*LATENCY_SLO))
    values = slo.trailing_quantiles(rows, "ts", MINUTE, 300, latency(), fixed.RETRIEVAL_BOUNDS, {"value": 0.95}, ["event_type"])

    def of_handler(part: int):
        return F.element_at(F.create_map(*[F.lit(x) for h, v in LATENCY_SLO.items() for x in (h, v[part])]), F.col("event_type"))

    states = slo.alert_state(slo.breached(values, above=of_handler(0)), of_handler(1), ["event_type"])
    return states.select("event_type", "tick", "breached", "state", "active_since")


@query(
    "alert_median_score",
    f"""WITH {REC}, {grid('rec', MINUTE, 600, buckets_sql('score', fixed.SCORE_BOUNDS), None, 'received_at')},
      {states_sql(quantile_sql(0.5, fixed.SCORE_BOUNDS) + ' < 40', 300, MINUTE)} SELECT {STATE_COLUMNS} FROM states""",
)
def alert_median_score(spark, folder):
    values = slo.trailing_quantiles(records(spark, folder), "received_at", MINUTE, 600, F.col("score"), fixed.SCORE_BOUNDS, {"value": 0.5})
    return slo.alert_state(slo.breached(values, below=40), 300).select("tick", "breached", "state", "active_since")


@query(
    "alert_stalled",
    f"""WITH {INC}, {grid('inc', MINUTE, 300, {'n': 'true'}, 'source_system')},
      seen AS (SELECT label, min(tick) AS first_seen FROM cnt GROUP BY label),
      {states_sql("n = 0 AND tick >= (SELECT first_seen FROM seen WHERE seen.label = tr.label)", 600, MINUTE)}
      SELECT label AS source_system, {STATE_COLUMNS} FROM states""",
)
def alert_stalled(spark, folder):
    conditions = slo.stalled(incidents(spark, folder), "ts", MINUTE, 300, ["source_system"])
    return slo.alert_state(conditions, 600, ["source_system"]).select("source_system", "tick", "breached", "state", "active_since")


@query(
    "alert_target_down",
    f"""WITH {INC}, {grid('inc', MINUTE, MINUTE, {'n': 'true'}, 'source_system')}, {states_sql('n = 0', 60, MINUTE)}
      SELECT label AS source_system, {STATE_COLUMNS} FROM states""",
)
def alert_target_down(spark, folder):
    conditions = slo.target_down(incidents(spark, folder), "ts", MINUTE, ["source_system"])
    return slo.alert_state(conditions, 60, ["source_system"]).select("source_system", "tick", "breached", "state", "active_since")


# --- reliability ----------------------------------------------------------------------------------------
def outcomes(spark, folder):
    """Incidents as request outcomes."""
    n = F.col("event_id")
    return incidents(spark, folder).select(
        F.col("record_id").alias("request_id"), "service", "ts", F.col("value").alias("latency_ms"),
        (n % 3 + 1).alias("attempts"), (n % 20 == 0).alias("used_fallback"), (F.col("event_type") != "error").alias("ok"),
        (n % 10 == 0).alias("recovery_attempted"), (n % 30 == 0).alias("recovery_ok"), F.col("event_type"),
    )


KPI = INC + """,
cn AS (SELECT service, count(*) AS requests, sum(event_id % 3 + 1) AS attempts, sum(event_id % 3) AS retries,
  count(*) FILTER (event_id % 20 = 0) AS fallbacks, count(*) FILTER (event_id % 10 = 0) AS recovery_attempts,
  count(*) FILTER (event_id % 30 = 0) AS recovery_successes FROM inc GROUP BY service),
kp AS (SELECT *, CASE WHEN attempts = 0 THEN 0 ELSE retries / attempts END AS retry_rate, fallbacks / requests AS fallback_rate,
  CASE WHEN recovery_attempts = 0 THEN 0 ELSE recovery_successes / recovery_attempts END AS recovery_success_rate, attempts / requests AS avg_attempts,
  CASE WHEN recovery_attempts = 0 THEN 0 ELSE 1 - recovery_successes / recovery_attempts END AS recovery_fail_rate FROM cn),
hl AS (SELECT *, retry_rate >= 0.2 OR fallback_rate >= 0.05 OR recovery_fail_rate >= 0.2 AS worst,
  retry_rate >= 0.05 OR fallback_rate >= 0.01 OR recovery_fail_rate >= 0.05 AS warns FROM kp),
he AS (SELECT *, CASE WHEN worst THEN 'CRITICAL' WHEN warns THEN 'WARN' ELSE 'OK' END AS health, concat_ws('|',
    CASE WHEN retry_rate >= 0.05 THEN 'retry rate ' || CAST(CAST(round(CAST(retry_rate * 100 AS DECIMAL(30,12)), 1) AS DECIMAL(20,1)) AS VARCHAR) || '% ' || CASE WHEN retry_rate >= 0.2 THEN 'is CRITICAL' ELSE 'is high' END END,
    CASE WHEN fallback_rate >= 0.01 THEN 'fallback rate ' || CAST(CAST(round(CAST(fallback_rate * 100 AS DECIMAL(30,12)), 1) AS DECIMAL(20,1)) AS VARCHAR) || '% ' || CASE WHEN fallback_rate >= 0.05 THEN 'is CRITICAL' ELSE 'is high' END END,
    CASE WHEN recovery_fail_rate >= 0.05 THEN 'recovery fail rate ' || CAST(CAST(round(CAST(recovery_fail_rate * 100 AS DECIMAL(30,12)), 1) AS DECIMAL(20,1)) AS VARCHAR) || '% ' || CASE WHEN recovery_fail_rate >= 0.2 THEN 'is CRITICAL' ELSE 'is high' END END) AS issues,
  2 * (CASE WHEN retry_rate >= 0.05 THEN 1 ELSE 0 END + CASE WHEN fallback_rate >= 0.01 THEN 1 ELSE 0 END
    + CASE WHEN recovery_fail_rate >= 0.05 THEN 1 ELSE 0 END) AS actions FROM hl)"""


@query(
    "kpis",
    f"""WITH {KPI} SELECT service, CAST(requests AS BIGINT) AS requests, CAST(attempts AS BIGINT) AS attempts, CAST(retries AS BIGINT) AS retries,
      CAST(fallbacks AS BIGINT) AS fallbacks, CAST(recovery_attempts AS BIGINT) AS recovery_attempts,
      CAST(recovery_successes AS BIGINT) AS recovery_successes, retry_rate, fallback_rate, recovery_success_rate, avg_attempts, recovery_fail_rate FROM kp""",
)
def kpis(spark, folder):
    return rl.kpis(rl.kpi_counters(outcomes(spark, folder), ["service"]))


def _health(spark, folder):
    return rl.health_report(kpis(spark, folder))


@query("health_report", f"WITH {KPI} SELECT service, health, issues, CAST(actions AS INTEGER) AS actions FROM he")
def health_report(spark, folder):
    return _health(spark, folder).select("service", "health", F.array_join("issues", "|").alias("issues"), F.size("actions").alias("actions"))


@query(
    "critical_alerts",
    f"""WITH {KPI} SELECT service, '{fixed.ALERT_NAME}' AS name, 'critical' AS severity, '{fixed.ALERT_MESSAGE}' AS message, issues,
      CAST(actions AS INTEGER) AS actions, retry_rate, fallback_rate, avg_attempts FROM he WHERE health = 'CRITICAL'""",
)
def critical_alerts(spark, folder):
    health = _health(spark, folder).withColumn("ts", F.lit("2024-01-31").cast("timestamp"))
    found = rl.critical_alerts(health, "ts")
    return found.select("service", "name", "severity", "message", F.array_join("issues", "|").alias("issues"),
                        F.size("actions").alias("actions"), "retry_rate", "fallback_rate", "avg_attempts")


def _percent_sql(x: str, digits: int) -> str:
    kind = f"DECIMAL(20,{digits})" if digits else "DECIMAL(20,0)"
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(30,12)), {digits}) AS {kind}) AS VARCHAR)"


@query(
    "copilot_report",
    f"""WITH {KPI}, f AS (SELECT *, string_split(issues, '|')[1] AS first_issue,
        {_percent_sql('retry_rate * 100', 0)} AS r0, {_percent_sql('fallback_rate * 100', 0)} AS f0, {_percent_sql('avg_attempts', 2)} AS a2,
        {_percent_sql('retry_rate * 100', 1)} AS r1, {_percent_sql('fallback_rate * 100', 1)} AS f1 FROM he),
    t AS (SELECT *, 'Health is ' || health || ' for ' || service || ' (dev). retryRate=' || r0 || '%, fallbackRate=' || f0 || '%, avgAttempts=' || a2 || '.' AS summary,
      CASE WHEN issues <> '' THEN 'Most likely related to: ' || first_issue ELSE '{fixed.COPILOT_CAUSE}' END AS probable_cause,
      CASE WHEN issues <> '' THEN 0.65::DOUBLE ELSE 0.45::DOUBLE END AS confidence FROM f)
    SELECT service, summary, probable_cause, confidence,
      repeat('=', 40) || chr(10) || '🤖 INCIDENT COPILOT' || chr(10) || repeat('=', 40) || chr(10) || 'Service:       ' || service || chr(10)
      || 'Environment:   dev' || chr(10) || 'Health:        ' || health || chr(10) || 'Timestamp:     2024-01-31T00:00:00.000Z' || chr(10) || chr(10)
      || 'Summary:       ' || summary || chr(10) || 'Cause:         ' || probable_cause || chr(10)
      || 'Confidence:    ' || CASE WHEN issues <> '' THEN '65' ELSE '45' END || '%' || chr(10) || chr(10) || 'Suggested actions:' || chr(10)
      || {" || chr(10) || ".join(f"'  {i}. {a}'" for i, a in enumerate(fixed.COPILOT_ACTIONS, 1))} || chr(10) || chr(10)
      || 'Signals:' || chr(10) || '  retryRate:    ' || r1 || '%' || chr(10) || '  fallbackRate: ' || f1 || '%' || chr(10) || '  avgAttempts:  ' || a2 || chr(10)
      || CASE WHEN issues <> '' THEN 'Issues:' || chr(10) || '  - ' || replace(issues, '|', chr(10) || '  - ') || chr(10) ELSE '' END || repeat('=', 40) AS report
    FROM t""",
)
def copilot_report(spark, folder):
    inputs = _health(spark, folder).withColumns({"environment": F.lit("dev"), "ts": F.lit("2024-01-31").cast("timestamp")})
    return rl.copilot_report(inputs).select("service", "summary", "probable_cause", "confidence", "report")


@query(
    "classify_errors",
    f"""WITH {INC}, e AS (SELECT CASE k % 4 WHEN 0 THEN 'AbortError' WHEN 1 THEN 'Error' WHEN 2 THEN 'TimeoutError' END AS name,
        CASE k % 5 WHEN 0 THEN 'Unexpected JSON token' WHEN 1 THEN 'schema differs' WHEN 2 THEN 'socket closed' END AS message,
        CASE WHEN event_id % 9 < 4 THEN [429, 500, 503, 404][CAST(event_id % 9 AS INTEGER) + 1] END AS status,
        CASE event_id % 7 WHEN 0 THEN 'ECONNRESET' WHEN 1 THEN 'EPIPE' WHEN 2 THEN 'ENOTFOUND' END AS code FROM inc),
    c AS (SELECT CASE WHEN name IS NULL AND message IS NULL THEN 'none' WHEN name = 'AbortError' THEN 'timeout' WHEN message LIKE '%JSON%' THEN 'invalid_json'
        WHEN message LIKE '%schema%' THEN 'schema_mismatch' ELSE 'network' END AS failure_mode,
      CASE WHEN name IS NULL AND status IS NULL AND code IS NULL THEN NULL WHEN name = 'TimeoutError' THEN 'timeout' WHEN name = 'AbortError' THEN 'aborted'
        WHEN status = 429 THEN 'rate_limit' WHEN status BETWEEN 500 AND 599 THEN 'server_5xx'
        WHEN code IN ('ECONNRESET', 'ENOTFOUND') THEN 'network_' || code ELSE 'non_retryable' END AS retry_reason,
      coalesce(name IN ('TimeoutError', 'AbortError'), false) OR coalesce(status = 429 OR status BETWEEN 500 AND 599, false) AS falls_back FROM e)
    SELECT failure_mode, retry_reason, falls_back, CAST(count(*) AS BIGINT) AS errors FROM c GROUP BY ALL""",
)
def classify_errors(spark, folder):
    n, k = F.col("event_id"), F.col("k")
    e = incidents(spark, folder).select(
        F.when(k % 4 == 0, "AbortError").when(k % 4 == 1, "Error").when(k % 4 == 2, "TimeoutError").alias("name"),
        F.when(k % 5 == 0, "Unexpected JSON token").when(k % 5 == 1, "schema differs").when(k % 5 == 2, "socket closed").alias("message"),
        F.when(n % 9 == 0, 429).when(n % 9 == 1, 500).when(n % 9 == 2, 503).when(n % 9 == 3, 404).alias("status"),
        F.when(n % 7 == 0, "ECONNRESET").when(n % 7 == 1, "EPIPE").when(n % 7 == 2, "ENOTFOUND").alias("code"),
    )
    name, status = F.col("name"), F.col("status")
    return e.groupBy(
        rl.classify_error(name, F.col("message")).alias("failure_mode"),
        rl.retry_reason(name, status, F.col("code")).alias("retry_reason"),
        rl.falls_back(name, status).alias("falls_back"),
    ).agg(F.count("*").alias("errors"))


ROLL = INC + """,
num AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts, record_id) AS seq_no FROM inc),
win AS (SELECT service, seq_no, count(*) OVER w AS window_size, count(*) FILTER (event_type = 'error') OVER w AS failed,
    count(*) FILTER (event_id % 20 = 0) OVER w AS fallbacks, sum(CAST(round(value * 1000) AS BIGINT)) OVER w AS us
  FROM num WINDOW w AS (PARTITION BY service ORDER BY seq_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
rol AS (SELECT service, seq_no, window_size, failed / window_size AS error_rate, us / window_size / 1000 AS avg_latency,
    fallbacks / window_size AS fallback_rate, CASE WHEN failed / window_size <= 0.05 THEN 'OK' WHEN failed / window_size <= 0.15 THEN 'DEGRADED' ELSE 'CRITICAL' END AS health,
    'Error rate: ' || """ + _percent_sql("failed / window_size * 100", 1) + """ || '%' AS reason
  FROM win WHERE seq_no % 5 = 0)"""


@query(
    "rolling_health",
    f"""WITH {ROLL} SELECT service, CAST(seq_no AS BIGINT) AS seq_no, CAST(window_size AS BIGINT) AS window_size, health, error_rate, avg_latency,
      fallback_rate, reason FROM rol""",
)
def rolling_health(spark, folder):
    return rl.rolling_health(outcomes(spark, folder), 5)


def _js_number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


@query(
    "rolling_alerts",
    f"""WITH {ROLL} SELECT service, CAST(seq_no AS BIGINT) AS seq_no, health, health || ': ' || reason || '. Focus on retry/fallback sources. KPIs={{"errorRate":'
      || {_js_number('error_rate')} || ',"avgLatency":' || {_js_number('avg_latency')} || ',"fallbackRate":' || {_js_number('fallback_rate')} || '}}' AS summary,
      0.72::DOUBLE AS confidence FROM rol WHERE health <> 'OK'""",
)
def rolling_alerts(spark, folder):
    return rl.rolling_alerts(rl.rolling_health(outcomes(spark, folder), 5)).select("service", "seq_no", "health", "summary", "confidence")


def greedy_sql(key: str, hold: str) -> str:
    return f"""WITH RECURSIVE {INC}, a AS (SELECT {key} AS name, ts FROM inc),
    f AS (SELECT name, min(ts) AS ts FROM a GROUP BY name
      UNION ALL SELECT f.name, min(a.ts) FROM f JOIN a ON a.name = f.name AND a.ts >= f.ts + INTERVAL {hold} GROUP BY f.name)
    SELECT f.name AS name, {sql_stamp('f.ts')} AS fired, record_id FROM f JOIN (SELECT {key} AS name, ts, record_id FROM inc) i ON i.name = f.name AND i.ts = f.ts"""


@query("cooldown_alerts", greedy_sql("event_type", "1 HOUR"))
def cooldown_alerts(spark, folder):
    alerts = incidents(spark, folder).select(F.col("event_type").alias("name"), "ts", "record_id")
    fired = cd.cooldown_alerts(alerts, 3600, row_id="record_id")
    return fired.select("name", stamp("ts").alias("fired"), "record_id")


@query("claim_actions", greedy_sql("workflow || '/' || incident_type", "3 HOUR"))
def claim_actions(spark, folder):
    keyed = incidents(spark, folder).select(F.concat_ws("/", "workflow", "incident_type").alias("name"), "ts", "record_id")
    held = cd.claim_actions(keyed, 3 * 3600, key="name", row_id="record_id")
    return held.select("name", stamp("ts").alias("fired"), "record_id")
