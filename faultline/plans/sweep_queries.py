"""Queries: service levels and alert states as runs, each the islands of the step grid of its twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import fixed
from faultline.operators import slo, sweep
from faultline.plans.registry import query
from faultline.plans.service_queries import LATENCY_SLO, MINUTE, buckets_sql, grid, latency, quantile_sql, states_sql
from faultline.plans.workload import INC, REC, incidents, records


def _islands(source: str, step: int, columns: str, extra: str = "") -> str:
    """Longest stretches of equal `columns` (label among them) over the grid."""
    return f"""SELECT {columns}{extra}, CAST(min(tick) AS BIGINT) AS start, CAST(max(tick) AS BIGINT) AS stop FROM
      (SELECT *, tick - {step} * row_number() OVER (PARTITION BY {columns} ORDER BY tick) AS g FROM {source}) GROUP BY {columns}, g"""


def _state_islands(step: int, label: str | None) -> str:
    found = _islands("states", step, "label, state, active_since")
    name = f"label AS {label}, " if label else ""
    return f"SELECT {name}state, CAST(active_since AS BIGINT) AS active_since, start, stop FROM ({found})"


@query(
    "rate_runs",
    f"WITH {INC}, {grid('inc', MINUTE, 300, {'n': 'true'}, 'event_type')} SELECT label AS event_type, n / 300 AS rate, start, stop FROM ({_islands('tr', MINUTE, 'label, n')})",
)
def rate_runs(spark, folder):
    return sweep.rate_runs(incidents(spark, folder), "ts", MINUTE, 300, ["event_type"])


@query(
    "rate_per_minute_runs",
    f"WITH {INC}, {grid('inc', MINUTE, 300, {'n': 'true'})} SELECT n * 60 / 300 AS rate, start, stop FROM ({_islands('tr', MINUTE, 'n')})",
)
def rate_per_minute_runs(spark, folder):
    return sweep.rate_runs(incidents(spark, folder), "ts", MINUTE, 300, per=60)


_BUCKETS = ", ".join([f"b{i}" for i in range(len(fixed.SCORE_BOUNDS))] + ["n"])


@query(
    "quantile_panel_runs",
    f"""WITH {REC}, {grid('rec', 300, 3600, buckets_sql('score', fixed.SCORE_BOUNDS), None, 'received_at')}
    SELECT {quantile_sql(0.5, fixed.SCORE_BOUNDS)} AS p50, {quantile_sql(0.95, fixed.SCORE_BOUNDS)} AS p95, start, stop FROM ({_islands('tr', 300, _BUCKETS)})""",
)
def quantile_panel_runs(spark, folder):
    return sweep.quantile_runs(
        records(spark, folder), "received_at", 300, 3600, F.col("score"), fixed.SCORE_BOUNDS, {"p50": 0.5, "p95": 0.95}
    )


@query(
    "score_heatmap_runs",
    f"WITH {REC}, {grid('rec', 300, 900, buckets_sql('score', fixed.SCORE_BOUNDS), None, 'received_at')}, r AS ({_islands('tr', 300, _BUCKETS)}) "
    + " UNION ALL ".join(
        f"SELECT start, stop, CAST({float(b)!r} AS DOUBLE) AS le, (b{i} - {f'b{i - 1}' if i else '0'}) / 900 AS rate FROM r"
        for i, b in enumerate(fixed.SCORE_BOUNDS)
    ) + f" UNION ALL SELECT start, stop, CAST('Infinity' AS DOUBLE), (n - b{len(fixed.SCORE_BOUNDS) - 1}) / 900 FROM r",
)
def score_heatmap_runs(spark, folder):
    return sweep.heatmap_runs(records(spark, folder), "received_at", 300, 900, F.col("score"), fixed.SCORE_BOUNDS)


def _share_alert(name, window, part, test, hold, spark_part, above=None, below=None, whole="true", spark_whole=None):
    sql = f"""WITH {REC}, {grid('rec', MINUTE, window, {'p': part, 'n': whole}, None, 'received_at')},
      {states_sql(f"CASE WHEN n > 0 THEN p / n END {test}", hold, MINUTE)} {_state_islands(MINUTE, None)}"""

    @query(name, sql)
    def run(spark, folder):
        values = sweep.share_runs(records(spark, folder), "received_at", MINUTE, window, spark_part(), (), spark_whole and spark_whole())
        return sweep.alert_runs(slo.breached(values, above, below), hold, MINUTE)


_share_alert("alert_error_ratio_runs", 300, "event_type = 'error'", "> 0.01", 120, lambda: F.col("event_type") == "error", above=0.01)
_share_alert("alert_retrieval_hit_rate_runs", 900, "event_id % 6 > 1", "< 0.6", 600, lambda: F.col("event_id") % 6 > 1, below=0.6)
_share_alert("alert_critical_share_runs", 600, "status = 'critical'", "> 0.5", 300, lambda: F.col("status") == "critical", above=0.5)
_share_alert("alert_loop_error_ratio_runs", 300, "event_type = 'error'", "> 0.1", 300, lambda: F.col("event_type") == "error", above=0.1,
             whole="event_type IN ('error', 'view')", spark_whole=lambda: F.col("event_type").isin("error", "view"))


@query(
    "alert_median_score_runs",
    f"""WITH {REC}, {grid('rec', MINUTE, 600, buckets_sql('score', fixed.SCORE_BOUNDS), None, 'received_at')},
      {states_sql(quantile_sql(0.5, fixed.SCORE_BOUNDS) + ' < 40', 300, MINUTE)} {_state_islands(MINUTE, None)}""",
)
def alert_median_score_runs(spark, folder):
    values = sweep.quantile_runs(records(spark, folder), "received_at", MINUTE, 600, F.col("score"), fixed.SCORE_BOUNDS, {"value": 0.5})
    return sweep.alert_runs(slo.breached(values, below=40), 300, MINUTE)


def _of_handler(part: int):
    return F.element_at(F.create_map(*[F.lit(x) for h, v in LATENCY_SLO.items() for x in (h, v[part])]), F.col("event_type"))


def _latency_sql() -> str:
    limit = "CASE label " + " ".join(f"WHEN '{h}' THEN {v}" for h, (v, _) in LATENCY_SLO.items()) + " END"
    hold = "CASE label " + " ".join(f"WHEN '{h}' THEN {s}" for h, (_, s) in LATENCY_SLO.items()) + " END"
    q = quantile_sql(0.95, fixed.RETRIEVAL_BOUNDS)
    steps = grid("slow", MINUTE, 300, buckets_sql("value / 400", fixed.RETRIEVAL_BOUNDS), "event_type")
    return f"""WITH {INC}, slow AS (SELECT * FROM inc WHERE event_type IN ('click', 'view', 'purchase')), {steps},
      {states_sql(f"{q} > {limit}", 0, MINUTE).replace("tick - since >= 0", f"tick - since >= {hold}")} {_state_islands(MINUTE, "event_type")}"""


@query("alert_latency_runs", _latency_sql())
def alert_latency_runs(spark, folder):
    rows = incidents(spark, folder).where(F.col("event_type").isin(*LATENCY_SLO))
    values = sweep.quantile_runs(rows, "ts", MINUTE, 300, latency(), fixed.RETRIEVAL_BOUNDS, {"value": 0.95}, ["event_type"])
    return sweep.alert_runs(slo.breached(values, above=_of_handler(0)), _of_handler(1), MINUTE, ["event_type"])


@query(
    "alert_stalled_runs",
    f"""WITH {INC}, {grid('inc', MINUTE, 300, {'n': 'true'}, 'source_system')},
      seen AS (SELECT label, min(tick) AS first_seen FROM cnt GROUP BY label),
      {states_sql("n = 0 AND tick >= (SELECT first_seen FROM seen WHERE seen.label = tr.label)", 600, MINUTE)}
      {_state_islands(MINUTE, "source_system")}""",
)
def alert_stalled_runs(spark, folder):
    conditions = sweep.stalled_runs(incidents(spark, folder), "ts", MINUTE, 300, ["source_system"])
    return sweep.alert_runs(conditions, 600, MINUTE, ["source_system"])


@query(
    "alert_target_down_runs",
    f"""WITH {INC}, {grid('inc', MINUTE, MINUTE, {'n': 'true'}, 'source_system')}, {states_sql('n = 0', 60, MINUTE)}
      {_state_islands(MINUTE, "source_system")}""",
)
def alert_target_down_runs(spark, folder):
    down = sweep.target_down_runs(incidents(spark, folder), "ts", MINUTE, ["source_system"])
    return sweep.alert_runs(down, 60, MINUTE, ["source_system"])
