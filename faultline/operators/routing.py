"""Routing of incidents by severity, health, load and history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed
from faultline.functions.text import lookup
from faultline.operators.ordered import trailing_totals

HOUR = 3600


def similar_in_last(
    incidents: DataFrame, hours: float, ts: str = "ts", row_id: str = "record_id", include_self: bool = True,
    name: str = "similar",
) -> DataFrame:
    """Incidents of the same type in the `hours` before each one, itself included unless told otherwise."""
    counted = trailing_totals(incidents, ["incident_type"], ts, row_id, hours * HOUR, {name: F.lit(1)})
    return counted if include_self else counted.withColumn(name, F.col(name) - 1)


def escalation_trend(incidents: DataFrame, escalated: Column, ts: str = "ts", row_id: str = "record_id") -> DataFrame:
    """Trend of the share of escalated incidents in the hour up to each incident."""
    totals = {"recent": F.lit(1), "recent_escalated": escalated.cast("int")}
    counted = trailing_totals(incidents, [], ts, row_id, HOUR, totals)
    share = F.col("recent_escalated") / F.col("recent")
    trend = F.when(share > 0.5, "deteriorating").when(share > 0.2, "concerning").otherwise("stable")
    return counted.withColumn("trend", trend)


def workload_level(cpu: Column, memory: Column) -> Column:
    """Load level from CPU and memory percent; missing values count as 50 and 60."""
    load = (F.coalesce(cpu, F.lit(50.0)) + F.coalesce(memory, F.lit(60.0))) / 2
    return F.when(load < 30, "low").when(load < 70, "normal").when(load < 90, "high").otherwise("overload")


def _matches(conditions: dict) -> Column:
    tests = [
        F.col(name).isin(*wanted) if isinstance(wanted, list) else F.col(name) >= wanted
        for name, wanted in conditions.items()
    ]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def route_incidents(
    incidents: DataFrame, rules: Sequence[tuple] = fixed.ROUTING_RULES, nodes: dict[str, str] = fixed.ROUTING_NODES
) -> DataFrame:
    """Adds `rule` and `node`: the matching rule of lowest priority number, the first listed of equal ones.

    Needs severity, health_status, workload and the counts the rules name. The rules become one CASE, so
    nothing is joined.
    """
    severity, health = F.col("severity"), F.col("health_status")
    valid = severity.isin(*fixed.SEVERITIES) & health.isin("healthy", "degraded", "unhealthy", "unknown")
    default = (
        F.when(severity == "critical", "execute_action")
        .when(health.isin("unhealthy", "degraded"), "conservative_action")
        .otherwise("evaluate")
    )
    ok = F.coalesce(valid, F.lit(False))
    rule, node = F.when(~ok, F.lit(None).cast("string")), F.when(~ok, "evaluate")
    for name, conditions, action, _ in sorted(rules, key=lambda r: r[3]):
        hit = _matches(conditions)
        rule, node = rule.when(hit, name), node.when(hit, nodes.get(action, "evaluate"))
    return incidents.withColumns({"rule": rule, "node": node.otherwise(default)})


def service_health(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of healthy checks per group and its level; no checks means unhealthy."""
    counted = checks.groupBy(*by).agg(F.count_if("healthy").alias("healthy"), F.count("*").alias("total"))
    share = F.col("healthy") / F.col("total")
    return counted.withColumn("health_status", F.when(share >= 0.8, "healthy").when(share >= 0.5, "degraded").otherwise("unhealthy"))


def health_gate(health: Column, severity: Column) -> Column:
    return (
        F.when((health == "unhealthy") & (F.lower(severity) == "high"), "escalate")
        .when(health == "unhealthy", "wait_and_retry")
        .when(health == "degraded", "proceed_with_caution")
        .when(health == "healthy", "proceed_normally")
        .otherwise("health_check")
    )


def context_adjusted_score(df: DataFrame, health: str = "health_status", chunks: str = "context_chunks") -> DataFrame:
    """Adds score, status, action and confidence from system health and the amount of context."""
    multiplier = lookup(F.col(health), {"unhealthy": 1.5, "degraded": 1.2}, 1.0)
    context = F.col(chunks) * 0.1
    return df.withColumns(
        {
            "score": F.least(F.lit(0.9), F.lit(0.5) + context) * multiplier,
            "status": F.when(multiplier > 1.2, "needs_action").otherwise("ok"),
            "action": F.when(multiplier > 1.3, "restart_service").otherwise("monitor"),
            "confidence": F.lit(0.8) + context,
        }
    )


def safety_gate(df: DataFrame) -> DataFrame:
    """Adds final_action, reason and safety_score; an unsafe action becomes monitor."""
    checks = [
        F.col("health_status").isin("healthy", "degraded"),
        F.coalesce("coordination_status", F.lit("ready")).isin("ready", "coordinated"),
        F.coalesce("confidence", F.lit(0.0)) > 0.6,
    ]
    checks = [F.coalesce(c, F.lit(False)) for c in checks]
    safe = checks[0] & checks[1] & checks[2]
    passed = checks[0].cast("int") + checks[1].cast("int") + checks[2].cast("int")
    return df.withColumns(
        {
            "final_action": F.when(safe, F.coalesce("action", F.lit("monitor"))).otherwise("monitor"),
            "reason": F.when(~safe, "safety_checks_failed"),
            "safety_score": passed / 3,
        }
    )


def execution_summary(trace: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Nodes, total duration and last action per run; durations are whole microseconds."""
    last = F.max_by(F.col("action"), F.when(F.col("action").isNotNull(), F.col("step")))
    return trace.groupBy(*by).agg(
        F.count("*").alias("total_nodes"), F.sum("duration_us").alias("total_duration_us"), last.alias("final_action")
    )
