import pytest
from pyspark.sql import functions as F

from faultline import fixed
from faultline.operators import grounding as gr
from faultline.operators import slo
from faultline.operators import trends as tr
from faultline.operators import windows as wn


def events(spark, severities, service="checkout-api", kind="technical_error"):
    rows = [(1, service, s, kind, i) for i, s in enumerate(severities)]
    return spark.createDataFrame(rows, "batch_id int, service string, severity string, incident_type string, n int")


def report(spark, severities):
    return wn.window_report(wn.window_service_summary(events(spark, severities)), 300).collect()[0]


def test_urgent_and_calm(spark):
    r = report(spark, ["critical", "critical", "low"])
    assert "immediate attention" in r.overall_assessment and r.critical_pattern and len(r.recommended_actions) == 3
    assert (r.confidence_score, r.hallucination_risk, r.llm_used) == (40, "low", False)
    r = report(spark, ["low", "low"])
    assert r.critical_pattern is None and "last 5 minutes" in r.overall_assessment
    # exactly half is not more than half
    assert report(spark, ["critical", "low"]).critical_pattern is None


def test_dominant_severity_and_defaults(spark):
    df = spark.createDataFrame([(1, None, "odd", ""), (1, None, None, None), (1, "a", "medium", "x"), (1, "a", "critical", "x")],
                               "batch_id int, service string, severity string, incident_type string")
    got = {r.service: (r["count"], r.dominant_severity, r.incident_types) for r in wn.window_service_summary(df).collect()}
    assert got == {"unknown": (2, "low", ["technical_error"]), "a": (2, "critical", ["x"])}


def test_empty_window(spark):
    none = events(spark, ["low"]).where("false").withColumn("arrival_ts", F.current_timestamp())
    r = wn.analyze_window(none, F.current_timestamp(), 300).collect()[0]
    assert (r.event_count, r.confidence_score, r.overall_assessment, r.recommended_actions) == (0, 0, fixed.EMPTY_ASSESSMENT, [])
    with pytest.raises(ValueError):
        wn.analyze_window(none, F.current_timestamp(), 30)


REPORT = "batch_id int, services_affected array<string>, claimed_types array<string>, overall_assessment string, critical_pattern string"


def checked(spark, severities, services=("checkout-api",), types=("technical_error",), text="Critical failures", pattern=None, judge=None):
    rep = spark.createDataFrame([(1, list(services), list(types), text, pattern)], REPORT)
    j = None if judge is None else spark.createDataFrame([(1, judge)], "batch_id int, judge_json string")
    return gr.faithfulness(rep, events(spark, severities), j).collect()[0]


def test_grounded(spark):
    r = checked(spark, ["critical"] * 5, pattern="CHECKOUT-API is down")
    assert (r.faithfulness_score, r.verdict, r.ungrounded_claims) == (100, "faithful", [])


def test_each_check(spark):
    r = checked(spark, ["critical"] * 5, services=["checkout-api", "ghost"])
    assert r.services_ratio == 0.5 and r.faithfulness_score == 80 and r.ungrounded_claims == [fixed.CLAIM_SERVICE.format(name="ghost")]
    assert checked(spark, ["critical"] * 5, types=["technical_error", "x", "x"]).faithfulness_score == 85
    r = checked(spark, ["critical"] * 5, pattern="ghost-database corruption detected")
    assert r.faithfulness_score == 90 and r.ungrounded_claims == [fixed.CLAIM_PATTERN]
    r = checked(spark, ["low"] * 10)
    assert not r.severity_consistent and r.faithfulness_score == 80
    assert checked(spark, ["critical", "low"], text="fine").severity_consistent is False
    assert checked(spark, [], services=[], types=[], text="fine").faithfulness_score == 100


def test_golden_scores_of_rule_based_reports(spark):
    calm = "Received 2 incident event(s) across 1 service(s) in the last 5 minutes. No critical pattern detected by rule-based analysis."
    assert checked(spark, ["low", "low"], text=calm).faithfulness_score == 80
    urgent = "3 of 3 events require immediate attention."
    assert checked(spark, ["high"] * 3, text=urgent, pattern="Elevated error rate: 3/3 events are high/critical severity").faithfulness_score == 90


@pytest.mark.parametrize("judge, score, used", [
    ('{"faithfulness_score": 150, "ungrounded_claims": ["c"], "verdict": "nonsense"}', 100, True),
    ('{"faithfulness_score": 41}', 70, True), ('{"faithfulness_score": -5}', 50, True), ("{}", 75, True), ("broken", 100, False),
    ('{"faithfulness_score": "many"}', 100, False), ('{"faithfulness_score": 41.9, "ungrounded_claims": "x"}', 70, True),
])
def test_judge(spark, judge, score, used):
    r = checked(spark, ["critical"] * 5, judge=judge)
    assert (r.faithfulness_score, r.llm_used) == (score, used)


def test_verdicts(spark):
    df = spark.createDataFrame([(s,) for s in (80, 79, 40, 39, 0)], "s int").select(gr.verdict(F.col("s")))
    assert [r[0] for r in df.collect()] == ["faithful", "partially_faithful", "partially_faithful", "hallucinated", "hallucinated"]


# --- service levels -----------------------------------------------------------------------------------
def at(spark, seconds, **columns):
    df = spark.createDataFrame([(s,) for s in seconds], "s bigint").withColumn("ts", F.timestamp_seconds("s"))
    return df.withColumns(columns)


def test_rate_window_is_open_at_the_far_end(spark):
    got = {r.tick: r.rate for r in slo.rate(at(spark, [60, 120, 300, 600]), "ts", 60, 300, []).collect()}
    assert got[60] == 1 / 300 and got[300] == 3 / 300 and got[360] == 2 / 300 and got[600] == 1 / 300 and got[540] == 1 / 300


def test_one_far_off_date_does_not_stretch_the_grid(spark):
    df = at(spark, [60, 120, 300, 253_000_000_000])
    with pytest.raises(Exception, match="give a period"):
        slo.rate(df, "ts", 60, 300, []).collect()
    got = slo.rate(df, "ts", 60, 300, [], period=(0, 86_400))
    assert [r.tick for r in got.orderBy("tick").collect()] == [60, 120, 180, 240, 300]
    assert slo.target_down(df, "ts", 60, period=(0, 86_400)).where("breached").count() == 2
    assert [r.s for r in slo.outside(df.unionByName(df.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))), "ts", (0, 86_400)).orderBy("s").collect()] == [60, 253_000_000_000]


def test_limits_and_holds_per_row(spark):
    rows = [(k, t, v) for k in ("a", "b") for t, v in ((60, 5.0), (120, 5.0), (180, 5.0))]
    df = spark.createDataFrame(rows, "k string, tick bigint, value double")
    by_key = lambda a, b: F.when(F.col("k") == "a", a).otherwise(b)
    got = slo.alert_state(slo.breached(df, above=by_key(4.0, 6.0)), by_key(60, 0), ["k"]).orderBy("k", "tick").collect()
    assert [r.state for r in got] == ["pending", "firing", "firing", "inactive", "inactive", "inactive"]


def test_histogram_is_monotone_and_complete(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 1.3)
    counts = [r["count"] for r in slo.histogram_buckets(df, F.col("v"), fixed.SCORE_BOUNDS).orderBy("le").collect()]
    assert counts == sorted(counts) and counts[-1] == 100 and len(counts) == 11


@pytest.mark.parametrize("q, counts, total, want", [
    (0.5, [0, 10, 10], 10, 15.0), (0.95, [1, 2, 3], 100, 30.0), (0.5, [0, 0, 0], 0, None), (0.5, [10, 10, 10], 10, 5.0), (0.25, [2, 4, 8], 8, 10.0),
])
def test_bucket_quantile(spark, q, counts, total, want):
    df = spark.createDataFrame([(*counts, total)], "a int, b int, c int, n int")
    got = df.select(slo.bucket_quantile(q, [10, 20, 30], [F.col(c) for c in "abc"], F.col("n"))).collect()[0][0]
    assert got == want


def test_alert_states(spark):
    flags = [0, 1, 1, 1, 0, 1, 1, 0, 1, 1, 1, 1]
    df = spark.createDataFrame([(60 * i, bool(f)) for i, f in enumerate(flags)], "tick bigint, breached boolean")
    got = [r.state[0] for r in slo.alert_state(df, 120).orderBy("tick").collect()]
    assert "".join(got) == "ippfippippff"


def test_counter_resets(spark):
    df = at(spark, [1, 2, 3, 4, 5]).withColumn("c", F.element_at(F.array(*[F.lit(x) for x in (5, 8, 2, 2, 6)]), F.col("s").cast("int")))
    r = slo.counter_increase(df.withColumn("k", F.lit("a")), ["k"], "ts", "c").collect()[0]
    assert (r.samples, r.increase) == (5, 3 + 2 + 0 + 4)


def test_trends_edges(spark):
    empty = spark.createDataFrame([], "record_id string, received_at timestamp, score string, status string, workflow string")
    assert tr.average_score(empty.withColumn("score", F.col("score").cast("int"))).collect()[0][0] == 0.0
    df = spark.sql("SELECT * FROM VALUES ('a', timestamp '2024-01-01', '10', null, 'w'), ('b', timestamp '2024-01-01 23:00:00', 'x', 'ok', 'w') AS t(record_id, received_at, score, status, workflow)")
    assert [tuple(r) for r in tr.daily_score_trend(df).collect()] == [("2024-01-01", 5.0, 2)]
    assert [tuple(r) for r in tr.workflow_failure_rate(df).collect()] == [("w", 2, 0, 0.0)]
