"""Retry, fallback and recovery rates, health levels and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed
from faultline.functions.numeric import fixed_text, ratio
from faultline.functions.text import fill
from faultline.operators.ordered import row_numbers, sliding

COUNTERS = ("requests", "attempts", "retries", "fallbacks", "recovery_attempts", "recovery_successes")


def kpi_counters(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Request outcomes (attempts, used_fallback, recovery_attempted, recovery_ok) -> the six counters."""
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.sum("attempts").alias("attempts"),
        F.sum(F.col("attempts") - 1).alias("retries"),
        F.count_if("used_fallback").alias("fallbacks"),
        F.count_if("recovery_attempted").alias("recovery_attempts"),
        F.count_if("recovery_ok").alias("recovery_successes"),
    )


def kpis(counters: DataFrame) -> DataFrame:
    """Adds the rates; a rate over nothing is 0."""
    c = F.col
    failed = F.when(c("recovery_attempts") == 0, 0.0).otherwise(1 - c("recovery_successes") / c("recovery_attempts"))
    return counters.withColumns(
        {
            "retry_rate": ratio(c("retries"), c("attempts")),
            "fallback_rate": ratio(c("fallbacks"), c("requests")),
            "recovery_success_rate": ratio(c("recovery_successes"), c("recovery_attempts")),
            "avg_attempts": ratio(c("attempts"), c("requests")),
            "recovery_fail_rate": failed,
        }
    )


def health_report(rated: DataFrame) -> DataFrame:
    """Adds health, issues and actions to a table with the rates."""
    issues, actions, worst, any_issue = [], [], F.lit(False), F.lit(False)
    for name, warn, critical, label, advice in fixed.KPI_RULES:
        rate = F.col(name)
        level = F.when(rate >= critical, "is CRITICAL").otherwise("is high")
        text = F.concat(F.lit(f"{label} "), fixed_text(rate * 100, 1), F.lit("% "), level)
        issues.append(F.when(rate >= warn, text))
        actions.append(F.when(rate >= warn, F.array(*[F.lit(a) for a in advice])))
        worst, any_issue = worst | (rate >= critical), any_issue | (rate >= warn)
    return rated.withColumns(
        {
            "health": F.when(worst, "CRITICAL").when(any_issue, "WARN").otherwise("OK"),
            "issues": F.array_compact(F.array(*issues)),
            "actions": F.array_distinct(F.flatten(F.array_compact(F.array(*actions)))),
        }
    )


def critical_alerts(health: DataFrame, ts: str) -> DataFrame:
    """One alert row per critical health row; rates that are missing or not finite become 0."""

    def number(name: str) -> Column:
        x = F.col(name).cast("double")
        bad = x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
        return F.when(bad, 0.0).otherwise(x)

    found = health.where(F.col("health") == "CRITICAL")
    return found.select(
        *[c for c in found.columns if c not in (ts, "issues", "actions", "retry_rate", "fallback_rate", "avg_attempts")],
        F.lit(fixed.ALERT_NAME).alias("name"),
        F.lit("critical").alias("severity"),
        F.lit(fixed.ALERT_MESSAGE).alias("message"),
        F.col(ts),
        F.coalesce("issues", F.array().cast("array<string>")).alias("issues"),
        F.coalesce("actions", F.array().cast("array<string>")).alias("actions"),
        *[number(n).alias(n) for n in ("retry_rate", "fallback_rate", "avg_attempts")],
    )


def copilot_report(inputs: DataFrame) -> DataFrame:
    """service, environment, health, rates, issues, ts -> summary, cause, confidence and the printed report."""
    some = F.size("issues") > 0
    first = F.try_element_at("issues", F.lit(1))
    values = {
        "health": F.col("health"),
        "service": F.col("service"),
        "environment": F.col("environment"),
        "retry": fixed_text(F.col("retry_rate") * 100, 0),
        "fallback": fixed_text(F.col("fallback_rate") * 100, 0),
        "attempts": fixed_text(F.col("avg_attempts"), 2),
    }
    summary = fill(
        "Health is {health} for {service} ({environment}). retryRate={retry}%, fallbackRate={fallback}%, "
        "avgAttempts={attempts}.",
        **values,
    )
    cause = F.when(some, F.concat(F.lit("Most likely related to: "), first)).otherwise(fixed.COPILOT_CAUSE)
    out = inputs.withColumns(
        {
            "summary": summary,
            "probable_cause": cause,
            "confidence": F.when(some, 0.65).otherwise(0.45),
            "suggested_actions": F.array(*[F.lit(a) for a in fixed.COPILOT_ACTIONS]),
        }
    )
    return out.withColumn("report", _printed(some))


def _printed(some: Column) -> Column:
    rule = "=" * 40
    head = fill(
        rule + "\n🤖 INCIDENT COPILOT\n" + rule + "\n"
        "Service:       {service}\nEnvironment:   {environment}\nHealth:        {health}\nTimestamp:     {ts}\n\n"
        "Summary:       {summary}\nCause:         {cause}\nConfidence:    {confidence}%\n\nSuggested actions:\n",
        service=F.col("service"), environment=F.col("environment"), health=F.col("health"),
        ts=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), summary=F.col("summary"), cause=F.col("probable_cause"),
        confidence=fixed_text(F.col("confidence") * 100, 0),
    )
    actions = F.array_join(
        F.transform("suggested_actions", lambda a, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), a)), "\n"
    )
    signals = fill(
        "\n\nSignals:\n  retryRate:    {retry}%\n  fallbackRate: {fallback}%\n  avgAttempts:  {attempts}\n",
        retry=fixed_text(F.col("retry_rate") * 100, 1), fallback=fixed_text(F.col("fallback_rate") * 100, 1),
        attempts=fixed_text(F.col("avg_attempts"), 2),
    )
    lines = F.array_join(F.transform("issues", lambda x: F.concat(F.lit("  - "), x)), "\n")
    issues = F.when(some, F.concat(F.lit("Issues:\n"), lines, F.lit("\n"))).otherwise("")
    return F.concat(head, actions, signals, issues, F.lit(rule))


# --- error classes --------------------------------------------------------------------------------
def classify_error(name: Column, message: Column) -> Column:
    """Failure mode of a request; no name and no message means no error."""
    return (
        F.when(name.isNull() & message.isNull(), "none")
        .when(F.coalesce(name, F.lit("")) == "AbortError", "timeout")
        .when(F.coalesce(message.contains("JSON"), F.lit(False)), "invalid_json")
        .when(F.coalesce(message.contains("schema"), F.lit(False)), "schema_mismatch")
        .otherwise("network")
    )


def retry_reason(name: Column, status: Column, code: Column) -> Column:
    """Why an error is worth another try; `non_retryable` if it is not, null without an error."""
    return (
        F.when(name.isNull() & status.isNull() & code.isNull(), F.lit(None).cast("string"))
        .when(name == "TimeoutError", "timeout")
        .when(name == "AbortError", "aborted")
        .when(status == 429, "rate_limit")
        .when(status.between(500, 599), "server_5xx")
        .when(code.isin(*fixed.RETRYABLE_CODES), F.concat(F.lit("network_"), code))
        .otherwise("non_retryable")
    )


def falls_back(name: Column, status: Column) -> Column:
    """True for the errors that send a request to the second provider."""
    by_status = (status == 429) | status.between(500, 599)
    return F.coalesce(name.isin("TimeoutError", "AbortError"), F.lit(False)) | F.coalesce(by_status, F.lit(False))


# --- rolling health -------------------------------------------------------------------------------
def rolling_health(
    outcomes: DataFrame, every: int, by: Sequence[str] = ("service",), order: Sequence[str] = ("ts", "request_id")
) -> DataFrame:
    """Health over the last max(every, 10) requests, at each `every`-th request of a stream.

    Positions come from range blocks and frames from overlapping runs, so one busy service is spread over
    many tasks.
    """
    size = max(every, 10)
    placed = row_numbers(outcomes, by, order, "seq_no")
    framed = sliding(
        placed,
        by,
        "seq_no",
        size - 1,
        {
            "window_size": F.count("*"),
            "failed": F.count_if(~F.col("ok")),
            "fallbacks": F.count_if("used_fallback"),
            # latencies are summed as whole microseconds, so the sum does not hang on the order
            "latency_us": F.sum(F.round(F.col("latency_ms") * 1000).cast("bigint")),
        },
    )
    at = framed.where(F.col("seq_no") % every == 0)
    error_rate = F.col("failed") / F.col("window_size")
    rated = at.withColumn("error_rate", error_rate)
    return rated.select(
        *by,
        "seq_no",
        "window_size",
        F.when(F.col("error_rate") <= 0.05, "OK").when(F.col("error_rate") <= 0.15, "DEGRADED").otherwise("CRITICAL").alias("health"),
        "error_rate",
        (F.col("latency_us") / F.col("window_size") / 1000).alias("avg_latency"),
        (F.col("fallbacks") / F.col("window_size")).alias("fallback_rate"),
        F.concat(F.lit("Error rate: "), fixed_text(F.col("error_rate") * 100, 1), F.lit("%")).alias("reason"),
    )


def rolling_alerts(health: DataFrame) -> DataFrame:
    """Every row that is not OK, with the one-line summary."""

    def plain(x: Column) -> Column:
        # whole numbers are written without a fraction
        return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))

    kpi_json = F.concat(
        F.lit('{"errorRate":'), plain(F.col("error_rate")), F.lit(',"avgLatency":'), plain(F.col("avg_latency")),
        F.lit(',"fallbackRate":'), plain(F.col("fallback_rate")), F.lit("}"),
    )
    text = "{health}: {reason}. Focus on retry/fallback sources. KPIs={kpis}"
    summary = fill(text, health=F.col("health"), reason=F.col("reason"), kpis=kpi_json)
    return health.where(F.col("health") != "OK").withColumns({"summary": summary, "confidence": F.lit(0.72)})
