import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from faultline.functions.payload import iso_timestamp
from faultline.operators import normalize as nz

ARRIVAL = datetime(2026, 4, 13, 10, 0, 0)


def event(spark, source, payload):
    raw = payload if isinstance(payload, str) else json.dumps(payload)
    df = spark.createDataFrame([(raw, source)], "raw string, source_system string").withColumn(
        "arrival_ts", F.lit("2026-04-13 10:00:00").cast("timestamp")
    )
    out = nz.normalize(df).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return out.collect()[0]


JVM = {
    "timestamp": "2026-04-13T09:00:00Z", "level": "ERROR", "logger": "com.example.checkout.PaymentService",
    "message": "NullPointerException in process()", "service": "checkout-api",
    "exception": "java.lang.NullPointerException", "requestUri": "/api/v1/orders",
}


def test_jvm_log(spark):
    e = event(spark, "spring-boot", JVM)
    assert (e.severity, e.service, e.error_type, e.affected_resource) == (
        "high", "checkout-api", "NullPointerException", "/api/v1/orders")
    assert e.timestamp == "2026-04-13 09:00:00.000000" and e.reasons == []


@pytest.mark.parametrize("payload, service", [
    ({"logger": "com.example.checkout.PaymentService"}, "checkout"),
    ({"logger": "com.example"}, "example"),
    ({"loggerName": "main"}, "main"),
    ({"service": "", "logger": "a.b.c"}, "c"),
    ({"service": 0, "logger": "a.b.c"}, "c"),
    ({"service": True}, "True"),
    ({}, "unknown-service"),
])
def test_jvm_service(spark, payload, service):
    assert event(spark, "spring-boot", {"message": "m", **payload}).service == service


def test_log_levels(spark, rows):
    levels = {"FATAL": "critical", "ERROR": "high", "WARN": "medium", "WARNING": "medium", "INFO": "low", "DEBUG": "low",
              "TRACE": "low", "other": "medium", None: "medium"}
    df = spark.createDataFrame([(k,) for k in levels], "level string")
    got = dict(rows(df.select("level", nz.severity_from_log_level(F.col("level")))))
    assert got == levels


@pytest.mark.parametrize("payload, service", [
    ({"headers": {"service": "order-service"}, "consumer_group": "payment-group"}, "order-service"),
    ({"headers": "order-service", "consumer_group": "payment-group"}, "payment"),
    ({"groupId": "checkout-consumer"}, "checkout"),
    ({"groupId": "a-group-consumer"}, "a"),
    ({"topic": "orders-events"}, "orders"),
    ({"topic": "-events"}, "-events"),
    ({}, "unknown-service"),
])
def test_kafka_service(spark, payload, service):
    assert event(spark, "kafka", payload).service == service


@pytest.mark.parametrize("error, kind", [
    ("consumer lag exceeded", "consumer_lag"), ("request timed out", "timeout_exceeded"),
    ("schema registry deserialization", "schema_validation_failed"), ("sent to dead letter queue", "dlq_entry"),
    ("boom", "technical_error"), (None, None), ("", None),
])
def test_kafka_error_type(spark, error, kind):
    assert event(spark, "kafka", {"topic": "t", "error": error}).error_type == kind


def test_kafka_timestamp_and_messages(spark):
    e = event(spark, "kafka", {"topic": "orders-events", "timestamp": 1712998800000})
    assert e.timestamp == "2024-04-13 09:00:00.000000" and e.message == "Kafka event on topic orders-events"
    assert e.severity == "medium"
    assert event(spark, "kafka", {"timestamp": 1712998800}).timestamp == "2024-04-13 09:00:00.000000"
    assert event(spark, "kafka", {}).message == "Kafka event on topic unknown"
    assert event(spark, "kafka", {"topic": None}).message == "Kafka event on topic None"


@pytest.mark.parametrize("payload, service, severity, message", [
    ({"severity": "critical", "summary": "pool exhausted", "service": "database-service"}, "database-service", "critical", "pool exhausted"),
    ({"labels": {}, "component": "prometheus", "description": "d", "severity": "high"}, "prometheus", "high", "d"),
    ({"title": "t", "app": "backend-api", "level": "error"}, "backend-api", "high", "t"),
    ({"service": "  ", "source": " s ", "message": " \t", "text": "x", "urgency": "INFO"}, "s", "low", "x"),
    ({"message": 0, "service": False}, "False", "medium", "0"),
    ({}, "unknown-service", "medium", "Webhook event received"),
])
def test_webhook(spark, payload, service, severity, message):
    e = event(spark, "generic", payload)
    assert (e.service, e.severity, e.message) == (service, severity, message)


def test_webhook_epoch_is_not_a_time(spark):
    assert event(spark, "generic", {"timestamp": 1712998800000}).timestamp == "2026-04-13 10:00:00.000000"
    assert event(spark, "generic", {"time": "2026-04-13T08:00:00+02:00"}).timestamp == "2026-04-13 06:00:00.000000"


@pytest.mark.parametrize("text", [
    "2026-04-13T09:00:00Z", "2026-04-13 09:00:00", "2026-04-13", "20260413", "20260413T091500", "2026-04-13T09",
    "2026-04-13T09:15", "2026-04-13T09:15:30.123456789", "2026-04-13T09:15:30,5", "2026-04-13T09:15:30+0200",
    "2026-04-13T09:15:30-05", "2026", "2026-13-01", "2026-02-30", "yesterday", "2026-04-13T25:00:00", "1712998800000",
])
def test_iso_timestamps_as_python_reads_them(spark, text):
    try:
        want = datetime.fromisoformat(text.replace("Z", "+00:00"))
        want = (want if want.tzinfo else want.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
        want = want.strftime("%Y-%m-%d %H:%M:%S.%f")
    except ValueError:
        want = None
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.date_format(iso_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSSSSS")).collect()[0][0]
    assert got == want


@pytest.mark.parametrize("source, payload, reason", [
    ("spring-boot", '{"message": "m"', "payload is not a JSON object"),
    ("spring-boot", "[1, 2]", "payload is not a JSON object"),
    ("spring-boot", {"service": " ", "message": "m"}, "service must not be blank"),
    ("kafka", {"error": "  "}, "message must not be blank"),
    ("kafka", {"topic": 5}, "text field holds another type"),
    ("mainframe", {}, "unknown source_system"),
])
def test_quarantine(spark, source, payload, reason):
    assert reason in event(spark, source, payload).reasons


def test_good_and_bad_make_up_the_input(spark):
    df = spark.createDataFrame([("{}", s) for s in ("spring-boot", "kafka", "generic", "x")] * 3, "raw string, source_system string")
    out = nz.normalize(df.withColumn("arrival_ts", F.current_timestamp()))
    assert nz.accepted(out).count() + nz.rejected(out).count() == 12


def test_own_normalizer(spark):
    df = spark.createDataFrame([('{"host": "db1", "note": "slow_query"}', "mysql")], "raw string, source_system string")
    mine = {"mysql": lambda p: {
        "severity": F.lit("low"), "service": p.text("host"), "message": p.text("note"), "timestamp": p.first_value("at"),
        "error_type": p.text("note"), "affected_resource": F.lit(None).cast("string")}}
    out = nz.to_standard_incident(nz.accepted(nz.normalize(df.withColumn("arrival_ts", F.current_timestamp()), mine)))
    r = out.collect()[0]
    assert (r.workflow, r.stage, r.incident_type, r.context) == ("db1", "database", "degradation", {"error_type": "slow_query"})


TYPES = {
    "schema_error": ["schema_validation_failed", "json_parse_error", "validation_exception"],
    "semantic_error": ["semantic_drift_detected", "hallucination_detected", "factual_inconsistency", "quality_degradation"],
    "degradation": ["latency_spike", "timeout_exceeded", "slow_query_detected", "degradation_alert", "SLOW"],
    "technical_error": ["connection_refused", "out_of_memory", "unknown_error_xyz", None, ""],
}


def test_incident_types(spark, rows):
    df = spark.createDataFrame([(e, t) for t, es in TYPES.items() for e in es], "e string, t string")
    assert all(a == b for a, b in rows(df.select("t", nz.incident_type_from_error(F.col("e")))))


def test_validate_events(spark, rows):
    df = spark.sql("""SELECT * FROM VALUES ('a', 'm', 'mysql', 'low', now()), (' ', 'm', 'kafka', 'high', now()),
      ('a', '', 'kafka', 'high', now()), ('a', 'm', 'x', 'high', now()), ('a', 'm', 'kafka', 'x', NULL) AS t(service, message, source_system, severity, timestamp)""")
    assert sorted(len(r[0]) for r in rows(nz.validate_events(df), "reasons")) == [0, 1, 1, 1, 2]


def test_no_python_and_no_shuffle_in_the_plan(spark):
    df = spark.createDataFrame([("{}", "kafka")], "raw string, source_system string").withColumn("arrival_ts", F.current_timestamp())
    plan = nz.accepted(nz.normalize(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
