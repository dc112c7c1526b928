"""Rows that used to be lost: equal lines, mixed types beside the chosen value, null keys, short ids."""

import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from faultline.functions.text import json_string
from faultline.operators import evaluate, outputs, slo, snapshots, trends, windows
from faultline.operators.normalize import normalize
from faultline.sources.payloads import read_raw_payloads

def arrival():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def test_equal_lines_are_separate_events(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"message":"same"}\n' * 3)
    events = normalize(read_raw_payloads(spark, str(tmp_path), "spring-boot"))
    assert events.select("incident_id").distinct().count() == 3


@pytest.mark.parametrize(("source", "raw"), [
    ("generic", '{"error_type":"timeout","type":5}'), ("generic", '{"resource":"db","url":{"a":1}}'),
    ("spring-boot", '{"requestUri":"/a","endpoint":7}'), ("spring-boot", '{"level":0}'), ("kafka", '{"severity":false}'),
])
def test_only_the_chosen_value_must_be_text(spark, source, raw):
    df = spark.createDataFrame([(raw, source)], "raw string, source_system string").withColumn("arrival_ts", arrival())
    assert normalize(df).first().reasons == []


@pytest.mark.parametrize(("source", "raw"), [("spring-boot", '{"level":7}'), ("generic", '{"error_type":5,"type":"x"}'), ("generic", '{"url":0}')])
def test_a_chosen_value_of_another_type_is_rejected(spark, source, raw):
    df = spark.createDataFrame([(raw, source)], "raw string, source_system string").withColumn("arrival_ts", arrival())
    assert normalize(df).first().reasons == ["text field holds another type"]


def test_null_label_keeps_its_rate(spark):
    df = spark.createDataFrame([(None, 10), (None, 20), ("a", 10)], "label string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = slo.rate(df, "ts", 60, 60, ["label"], per=60).where("rate > 0").collect()
    assert {(r.label, r.rate) for r in got} == {(None, 2.0), ("a", 1.0)}


def test_null_group_keeps_its_latency(spark):
    df = spark.createDataFrame([(None, 5, True), (None, 7, False), ("a", 1, True)], "g string, latency_ms int, ok boolean")
    got = {r.g: (r.total, r.success, r.p50) for r in trends.latency_summary(df, ["g"]).collect()}
    assert got == {None: (2, 1, 7), "a": (1, 1, 1)}


def test_rates_round_half_to_even(spark):
    df = spark.createDataFrame([("low",)] + [("high",)] * 15, "severity string")
    assert {r.severity: r.pct for r in trends.severity_distribution(df).collect()}["low"] == 6.2


def test_action_ids_are_full_hashes(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("record_id"), *[F.lit("x").alias(c) for c in (
        "workflow", "stage", "severity", "message", "category", "incident_type", "source")], F.lit(1).alias("score"),
        F.lit("bad").alias("status"), F.lit("x").alias("suggested_action"), arrival().alias("received_at"))
    assert {len(r.action_id) for r in evaluate.dispatch_actions(df).collect()} == {68}


def test_a_rule_given_twice_is_refused(spark):
    rules = evaluate.evaluation_rules(spark)
    df = spark.createDataFrame([("a", "b")], "incident_type string, severity string")
    with pytest.raises(ValueError):
        evaluate.evaluate_incidents(df, rules.union(rules))


def test_no_answer_is_an_empty_object(spark):
    df = spark.createDataFrame([(1, None), (2, "no json")], "id int, raw string")
    assert {r.id: r.confidence for r in outputs.parse_copilot_output(df).collect()} == {1: 0.25, 2: 0.2}


def test_json_text_is_ascii(spark):
    import json

    texts = ["café \"x\"\n", "plain", "\U0001f600€", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.j for r in df.select("i", json_string(F.col("t"), True).alias("j")).orderBy("i").collect()]
    assert got == [json.dumps(t) for t in texts]


def test_null_batch_keeps_its_lists(spark):
    events = spark.createDataFrame([(None, "s", "high", "t")], "batch_id int, service string, severity string, incident_type string")
    report = spark.createDataFrame([(None, 1)], "batch_id int, event_count int")
    summary = windows.window_service_summary(events)
    assert windows.nested_report(report, summary).first().services_affected == ["s"]


def test_snapshots_stay_without_a_limit(spark):
    df = spark.range(150).select(F.lit(1).alias("thread_id"), F.col("id").alias("version"), F.lit("2024-01-01").cast("timestamp").alias("last_at"))
    assert snapshots.retain_snapshots(df, F.lit("2024-01-01 01:00:00").cast("timestamp")).count() == 150


def test_workers_have_the_package_from_any_folder(tmp_path):
    """The package is found through the driver's path alone; workers get it sent."""
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {sys.path[0]!r}); sys.path.insert(0, {__file__.rsplit('/', 2)[0]!r})
        from faultline.session import local_session
        from faultline.plans import QUERIES
        spark = local_session(cores="4")
        print("ROWS", QUERIES["similar_incidents"](spark, "/root/testdata/sf0.001").count(), QUERIES["cooldown_alerts"](spark, "/root/testdata/sf0.001").count())
    """)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-1500:]
