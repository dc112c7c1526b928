import pytest
from pyspark.sql import functions as F

from faultline.functions.numeric import fixed_text, percent_text, round_half_even
from faultline.operators import evaluate as ev
from faultline.operators import outputs as ou
from faultline.operators import reliability as rl
from faultline.operators import routing as rt
from faultline.sources import payloads as pl


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize("kind, severity, status, score, action", [
    ("schema_error", "critical", "critical", 85, "inspect_schema"),
    ("schema_error", "low", "critical", 70, "inspect_schema"),
    ("degradation", "low", "needs_attention", 55, "monitor"),
    ("degradation", "high", "needs_attention", 70, "monitor"),
    ("technical_error", "high", "critical", 80, "check_provider"),
    ("technical_error", "medium", "needs_attention", 60, "monitor"),
    ("semantic_error", "medium", "needs_attention", 50, "inspect_prompt"),
    ("semantic_error", "critical", "needs_attention", 65, "inspect_prompt"),
    ("other", "critical", "needs_attention", 50, "escalate"),
])
def test_rules(spark, kind, severity, status, score, action):
    df = spark.createDataFrame(
        [(kind, severity, "wf", "st", "cat", "src")], "incident_type string, severity string, workflow string, stage string, category string, source string")
    r = ev.evaluate_incidents(df).collect()[0]
    assert (r.status, r.score, r.suggested_action) == (status, score, action)
    assert 0 <= r.score <= 100 and r.tags[0] in (kind, "unclassified")


@pytest.mark.parametrize("severity, tools, score, status", [
    ("low", 0, 10, "ok"), ("low", 1, 20, "ok"), ("low", 3, 35, "ok"), ("medium", 2, 40, "ok"), ("medium", 3, 55, "needs_attention"),
    ("high", 0, 50, "needs_attention"), ("critical", 3, 95, "critical"), ("critical", 0, 70, "needs_attention"), ("x", 1, 50, "needs_attention"),
])
def test_tool_score(spark, severity, tools, score, status):
    got = one(spark, ev.tool_score(F.col("s"), F.col("t")), s=severity, t=tools)
    assert got == score
    assert one(spark, ev.score_status(F.col("v")), v=got) == status


def test_unknown_tool(spark):
    df = spark.createDataFrame([("r", '[{"id":"1","function":"reboot","arguments":"{\\"workflow\\":\\"w\\",\\"severity\\":\\"low\\",\\"reason\\":\\"x\\"}"}]')],
                               "record_id string, tool_calls_json string")
    assert ev.dispatch_tool_calls(df).collect()[0].outcome == "failed"
    assert ev.dispatch_tool_calls(df, unknown_succeeds=True).collect()[0].outcome == "success"


@pytest.mark.parametrize("x", [0.125, 0.375, 2.675, 1.005, 0.0005, 1 / 16, 12.5, 0.15, 33.333333, 1e-9, 0.0, 99.95, 2 / 3])
def test_rounding_is_exact(spark, x):
    for digits in (0, 1, 2, 3):
        assert one(spark, round_half_even(F.col("v"), digits), v=x) == round(x, digits)
        # exact decimal expansion, ties up
        from decimal import ROUND_HALF_UP, Decimal

        want = str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
        assert one(spark, fixed_text(F.col("v"), digits), v=x) == want
    assert one(spark, percent_text(F.col("v")), v=x) == f"{x:.0%}"


@pytest.mark.parametrize("text, number", [("10", 10.0), (None, 0.0), ("", 0.0), (" 5 ", 5.0), ("0x1f", 31.0), ("1e3", 1000.0), (".5", 0.5), ("5px", None), ("abc", None), ("5.", 5.0), ("1d", None), ("NaN", None)])
def test_to_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(pl.to_number(F.col("t"))).collect()[0][0] == number


def test_health_levels(spark):
    def health(**kw):
        base = dict(requests=100, attempts=100, retries=0, fallbacks=0, recovery_attempts=0, recovery_successes=0, **{}) | kw
        df = spark.createDataFrame([tuple(base[c] for c in rl.COUNTERS)], ", ".join(f"{c} bigint" for c in rl.COUNTERS))
        return rl.health_report(rl.kpis(df)).collect()[0]

    assert health().health == "OK" and health().issues == []
    r = health(retries=5)
    assert r.health == "WARN" and r.issues == ["retry rate 5.0% is high"] and len(r.actions) == 2
    r = health(retries=20, fallbacks=5, recovery_attempts=10, recovery_successes=9)
    assert r.health == "CRITICAL" and len(r.issues) == 3 and len(r.actions) == 6
    assert health(requests=0, attempts=0).health == "OK"


def test_critical_alert_replaces_bad_rates(spark):
    df = spark.sql("""SELECT 'CRITICAL' AS health, timestamp '2024-01-01' AS ts, cast(null as array<string>) AS issues, cast(null as array<string>) AS actions,
      double('NaN') AS retry_rate, cast(null as double) AS fallback_rate, 1.5D AS avg_attempts""")
    r = rl.critical_alerts(df, "ts").collect()[0]
    assert (r.retry_rate, r.fallback_rate, r.avg_attempts, r.issues) == (0.0, 0.0, 1.5, [])


def test_copilot_sample(spark):
    df = spark.sql("""SELECT 'svc' AS service, 'dev' AS environment, 'CRITICAL' AS health, 0.2D AS retry_rate, 0.1D AS fallback_rate, 1.2D AS avg_attempts,
      array('timeout spike') AS issues, timestamp '2024-01-01 00:00:00' AS ts""")
    r = rl.copilot_report(df).collect()[0]
    assert r.confidence == 0.65 and r.probable_cause == "Most likely related to: timeout spike"
    assert r.summary == "Health is CRITICAL for svc (dev). retryRate=20%, fallbackRate=10%, avgAttempts=1.20."
    assert "Timestamp:     2024-01-01T00:00:00.000Z" in r.report and r.report.endswith("  - timeout spike\n" + "=" * 40)


@pytest.mark.parametrize("raw, ok", [
    ('{"testCases": []}', True),
    ('{"testCases": [{"id":"1","title":"t","steps":["s"],"expected":"e","createdFromFeatureId":"f"}]}', True),
    ('{"testCases": [{"id":"1","title":"t","steps":[],"expected":"e","createdFromFeatureId":"f"}]}', False),
    ('{"testCases": [{"id":"1","title":"t","steps":["s",""],"expected":"e","createdFromFeatureId":"f"}]}', False),
    ('{"testCases": [{"id":1,"title":"t","steps":["s"],"expected":"e","createdFromFeatureId":"f"}]}', False),
    ('{"testCases": [{"id":"1","title":"t","steps":["s"],"expected":"e","createdFromFeatureId":"f","tags":null}]}', False),
    ('{"testCases": [{"id":"1","title":"t","steps":["s"],"expected":"e","createdFromFeatureId":"f","risk":"high","tags":["a"]}]}', True),
    ('{"testCases": [{"id":"1","title":"t","steps":["s"],"expected":"e","createdFromFeatureId":"f","risk":"x"}]}', False),
    ('{"cases": []}', False), ("not json", False), (None, False),
])
def test_test_case_contract(spark, raw, ok):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert ou.validate_test_cases(df).collect()[0].valid is ok


def test_copilot_output(spark):
    texts = ['{"summary":"s","probableCause":"p","suggestedActions":["a"],"confidence":0.5}',
             '"{\\"summary\\":\\"s\\",\\"probableCause\\":\\"p\\",\\"suggestedActions\\":[\\"a\\"],\\"confidence\\":1}"',
             '{"summary":"","probableCause":"p","suggestedActions":["a"],"confidence":0.5}',
             '{"summary":"s","probableCause":"p","suggestedActions":["a"],"confidence":1.5}', "[]", "nope"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    got = [r.confidence for r in ou.parse_copilot_output(df).orderBy("i").collect()]
    assert got == [0.5, 1.0, 0.25, 0.25, 0.25, 0.2]


def test_routing(spark):
    cases = [("critical", "healthy", "normal", 0, "execute_action"), ("medium", "degraded", "high", 0, "prepare_staged_action"),
             ("medium", "degraded", "normal", 0, "conservative_action"), ("low", "healthy", "normal", 3, "escalate_incident"),
             ("critical", "unhealthy", "normal", 0, "conservative_action"), ("critical", "unknown", "low", 0, "execute_action"),
             ("low", "unknown", "low", 0, "evaluate"), ("bad", "healthy", "low", 9, "evaluate"), ("critical", "healthy", "overload", 5, "execute_action")]
    df = spark.createDataFrame(cases, "severity string, health_status string, workload string, similar_incidents_1h int, want string")
    assert all(r.node == r.want for r in rt.route_incidents(df).collect())
