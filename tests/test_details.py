"""Any severity, equal counts, week dates, reports with services, prompts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.functions.payload import iso_timestamp
from faultline.operators import outputs, slo, trends, windows
from faultline.operators.evaluate import RULE_SCHEMA, evaluate_incidents


def incidents(spark, rows):
    schema = "record_id string, incident_type string, severity string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit(c) for c in ("category", "stage", "source", "workflow")})


def test_rules_hold_for_any_severity(spark):
    rows = [("1", "schema_error", "weird"), ("2", "schema_error", None), ("3", "technical_error", ""), ("4", "semantic_error", "HIGH"),
            ("5", "degradation", "high"), ("6", "unknown", "high"), ("7", None, None), ("8", "technical_error", "critical")]
    got = {r.record_id: (r.status, r.score, r.tags[0]) for r in evaluate_incidents(incidents(spark, rows)).collect()}
    assert got == {
        "1": ("critical", 70, "schema_error"), "2": ("critical", 70, "schema_error"), "3": ("needs_attention", 60, "technical_error"),
        "4": ("needs_attention", 50, "semantic_error"), "5": ("needs_attention", 70, "degradation"), "6": ("needs_attention", 50, "unclassified"),
        "7": ("needs_attention", 50, "unclassified"), "8": ("critical", 80, "technical_error"),
    }


def test_own_rules_without_a_rule_for_the_rest(spark):
    rule = ("schema_error", "high", "ok", 1, "monitor", "stage", "s", "r")
    rules = spark.createDataFrame([rule, ("schema_error", "low", "ok", 2, "monitor", "stage", "s", "r")], RULE_SCHEMA)
    df = incidents(spark, [("1", "schema_error", "high"), ("2", "schema_error", "low"), ("3", "schema_error", "medium")])
    assert [(r.score, r.tags[0]) for r in evaluate_incidents(df, rules).orderBy("record_id").collect()] == [
        (1, "schema_error"), (2, "schema_error"), (50, "unclassified")]
    with pytest.raises(ValueError):
        evaluate_incidents(df, rules.union(rules))


def test_equal_counts_go_by_first_seen(spark):
    rows = [(f"r{k}", a) for k, a in enumerate(["monitor", "escalate", "retry", "escalate", "monitor", "retry", "restart"])]
    df = spark.createDataFrame(rows, "record_id string, suggested_action string").withColumns(
        {"status": F.lit("ok"), "severity": F.lit("low"), "workflow": F.lit("w"), "score": F.lit(1)})
    placed = {r.name: r.place for r in trends.metrics_summary(df).where("metric = 'suggested_action'").collect()}
    assert sorted(placed, key=placed.get) == [r.suggested_action for r in trends.top_actions(df).collect()] == ["monitor", "escalate", "retry", "restart"]


@pytest.mark.parametrize("text", [
    "2024-W03-2", "2024W032", "2024-W03", "2024W03", "2024-W03-2T10:20:30", "2020-W53-7", "2015-W01-1", "2024-W03-2T10:20:30+02:00", "2024W032T1020",
    "2023-W53-1", "2024-W00-1", "2024-W03-8", "2024-W3-1", "2024-W03-", "2024W03-2", "2024-01-16", "0000-W01-1",
])
def test_week_dates(spark, text):
    try:
        want = datetime.fromisoformat(text)
        want = (want - want.utcoffset()).replace(tzinfo=None) if want.tzinfo else want
    except ValueError:
        want = None
    df = spark.createDataFrame([(text,)], "t string").select(F.date_format(iso_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("d"))
    assert df.first().d == (want and want.strftime("%Y-%m-%d %H:%M:%S"))


def test_gaps_between_far_windows(spark):
    days = ["2024-01-01 00:00:00", "2024-01-01 00:05:00", "2024-01-01 00:20:00", "2024-01-02 00:00:00"]
    events = spark.createDataFrame([(d, "s", "low", "t") for d in days], "ts string, service string, severity string, incident_type string")
    events = events.withColumn("batch_id", F.col("ts").cast("timestamp"))
    full = windows.with_empty_windows(windows.window_report(windows.window_service_summary(events), 300), "batch_id", 300)
    assert full.count() == full.select("batch_id").distinct().count() == 289
    assert full.where("event_count = 0").count() == 285


def test_window_without_events_has_empty_lists(spark):
    events = spark.createDataFrame([], "arrival_ts timestamp, service string, severity string, incident_type string")
    (row,) = windows.analyze_window(events, F.lit("2024-01-01").cast("timestamp"), 300).collect()
    assert (row.events_by_service, row.services_affected, row.event_count) == ([], [], 0)


def test_counter_without_labels(spark):
    df = spark.range(500).select(F.timestamp_seconds(F.col("id") * 100).alias("ts"))
    rows = slo.counter_by_label(df, "ts", 3600, []).orderBy("tick").collect()
    assert rows[-1].total == 500 and [r.total for r in rows] == sorted(r.total for r in rows)


def test_prompts_of_missing_values(spark):
    df = spark.createDataFrame([(None,) * 8], "workflow string, stage string, source string, incident_type string, category string, severity string, message string, bad string")
    row = df.select(outputs.incident_prompt(F.lit(None).cast("string")).alias("p"), outputs.repair_prompt(F.col("bad")).alias("r")).first()
    assert row.p.count("None") == 8 and row.r.endswith("Invalid response:\n\n")
