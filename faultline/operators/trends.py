"""Counts, averages and trends over evaluation records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.joins import join_with_nulls
from faultline.functions.numeric import ratio, round_half_even
from faultline.functions.text import cut
from faultline.operators.ordered import running_totals

SCORE = "score"


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "status")


def severity_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("severity").agg(F.count("*").alias("count"))


def _mean(value: Column, digits: int) -> Column:
    """Sums of whole scores are exact, so the mean does not hang on the order of rows."""
    return round_half_even(F.sum(value) / F.count("*"), digits)


def average_score(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(_mean(F.col(SCORE), 2), F.lit(0.0)).alias("average_score"))


def top_actions(records: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent actions; of equal ones the one seen first."""
    counted = records.where(F.col("suggested_action").isNotNull()).groupBy("suggested_action")
    counted = counted.agg(F.count("*").alias("count"), F.min("record_id").alias("first_seen"))
    return counted.orderBy(F.desc("count"), "first_seen", "suggested_action").limit(n).drop("first_seen")


def distinct_workflows(records: DataFrame) -> DataFrame:
    return records.select("workflow").distinct().orderBy("workflow")


def metrics_summary(records: DataFrame) -> DataFrame:
    """All counts in one scan: (metric, name, count, average_score, place), grouped by each label and by none.

    The five most common actions have a place, of equal counts the one seen first, as in `top_actions`.
    """
    sets = [["status"], ["severity"], ["suggested_action"], ["workflow"], []]
    labels = ["status", "severity", "suggested_action", "workflow"]
    grouped = records.groupingSets([[F.col(c) for c in s] for s in sets], *labels).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("count"), _mean(F.col(SCORE), 2).alias("average"),
        F.min("record_id").alias("first_seen"),
    )
    # grouping_id has a bit per label, set where the label is not grouped by
    metric = (
        F.when(F.col("gid") == 7, "status")
        .when(F.col("gid") == 11, "severity")
        .when(F.col("gid") == 13, "suggested_action")
        .when(F.col("gid") == 14, "workflow")
        .otherwise("total")
    )
    name = F.coalesce("status", "severity", "suggested_action", "workflow")
    named = grouped.select(metric.alias("metric"), name.alias("name"), "count", "average", "first_seen")
    action = F.col("metric") == "suggested_action"
    # the few actions are one group; each other row is one of its own
    order = Window.partitionBy("metric", F.when(~action, F.col("name"))).orderBy(F.desc("count"), "first_seen", "name")
    placed = named.where(~action | F.col("name").isNotNull()).withColumn("place", F.row_number().over(order))
    return placed.select(
        "metric", "name", "count", F.when(F.col("metric") == "total", F.coalesce("average", F.lit(0.0))).alias("average_score"),
        F.when(action & (F.col("place") <= 5), F.col("place")).alias("place"),
    )


def numeric_score(score: Column) -> Column:
    """The score as a number; text that is no number counts as 0."""
    return F.coalesce(score.try_cast("double"), F.lit(0.0))


def daily_score_trend(records: DataFrame) -> DataFrame:
    """Mean score and count per UTC day; days without rows are absent."""
    day = F.date_format("received_at", "yyyy-MM-dd")
    return records.groupBy(day.alias("date")).agg(
        round_half_even(F.sum(numeric_score(F.col(SCORE))) / F.count("*"), 2).alias("avg_score"),
        F.count("*").alias("count"),
    )


def rolling_score(records: DataFrame, window: int = 7, last: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the last `window` scores, for the newest `last` records (of each group).

    Only the newest last + window - 1 records matter, so they are picked first: a top-n without
    groups, a row-number limit that is applied before the shuffle with groups.
    """
    need = last + window - 1
    newest_first = [F.desc("received_at"), F.desc("record_id")]
    small = records.select(*by, "record_id", "received_at", numeric_score(F.col(SCORE)).alias("_score"))
    if not by:
        small = small.orderBy(*newest_first).limit(need)
    rank = Window.partitionBy(*by).orderBy(*newest_first)
    small = small.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= need)
    frame = Window.partitionBy(*by).orderBy("received_at", "record_id").rowsBetween(-(window - 1), 0)
    mean = round_half_even(F.sum("_score").over(frame) / F.count("*").over(frame), 2)
    return small.withColumn("rolling_avg", mean).where(F.col("_rank") <= last).select(
        *by, "record_id", "received_at", "rolling_avg"
    )


def severity_distribution(records: DataFrame) -> DataFrame:
    counted = records.groupBy("severity").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counted.withColumn("pct", round_half_even(F.col("count") / total * 100, 1)).orderBy(F.desc("count"), "severity")


def workflow_failure_rate(records: DataFrame) -> DataFrame:
    """A status other than ok is a failure; a missing status is not."""
    failed = F.sum(F.when(F.col("status") != "ok", 1).otherwise(0))
    counted = records.groupBy("workflow").agg(F.count("*").alias("total"), failed.alias("failed"))
    rate = round_half_even(F.col("failed") / F.col("total"), 4)
    return counted.withColumn("failure_rate", rate).orderBy(F.desc("failure_rate"), "workflow")


def failure_rate_percent(records: DataFrame) -> DataFrame:
    rates = workflow_failure_rate(records)
    return rates.select("workflow", (F.col("failure_rate") * 100).alias("failure_rate_percent"))


def status_shares(records: DataFrame) -> DataFrame:
    counted = status_counts(records)
    total = F.sum("count").over(Window.partitionBy())
    return counted.withColumn("share", ratio(F.col("count"), total))


def analytics_report(records: DataFrame) -> dict[str, DataFrame]:
    """The four trend tables over one projection, and the projection as `rows`."""
    rows = records.select("record_id", "received_at", "workflow", "severity", "status", "score")
    return {
        "rows": rows,
        "daily_score_trend": daily_score_trend(rows),
        "rolling_score": rolling_score(rows),
        "severity_distribution": severity_distribution(rows),
        "workflow_failure_rate": workflow_failure_rate(rows),
    }


def recent_actions_table(actions: DataFrame, n: int = 10) -> DataFrame:
    """The newest actions as a table row: time to the second, detail cut to 50 characters."""
    detail = F.when(F.length("detail") > 50, F.concat(cut(F.col("detail"), 50), F.lit("..."))).otherwise(F.col("detail"))
    return actions.orderBy(F.desc("executed_at"), F.desc("action_id")).limit(n).select(
        F.date_format("executed_at", "yyyy-MM-dd HH:mm:ss").alias("time"), "action_type", "workflow", "severity",
        "outcome", detail.alias("detail"),
    )


def action_timeline(actions: DataFrame, n: int = 100) -> DataFrame:
    newest = actions.orderBy(F.desc("executed_at"), F.desc("action_id")).limit(n)
    return newest.select("executed_at", "action_type", "workflow", "severity", "outcome")


QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_summary(
    requests: DataFrame, by: Sequence[str], latency: str = "latency_ms", ok: str = "ok", seconds: Column | None = None
) -> DataFrame:
    """Exact p50, p95, p99 (value at index floor(q * n)), totals and throughput per group.

    Equal latencies are counted before anything is sorted, and the running count is made in range
    blocks, so a hot group is not sorted in one task.
    """
    counted = requests.groupBy(*by, latency).agg(
        F.count("*").alias("_n"), F.count_if(ok).alias("_ok")
    )
    totals = counted.groupBy(*by).agg(F.sum("_n").alias("total"), F.sum("_ok").alias("success"))
    ranked = running_totals(counted, by, [latency], {"_upto": F.col("_n")})
    joined = join_with_nulls(ranked, totals, by)
    picks = [
        # the value whose run of ranks (upto - n, upto] holds the wanted 1-based rank
        F.min(
            F.when(F.col("_upto") >= F.floor(F.col("total") * q) + 1, F.col(latency))
        ).alias(name)
        for name, q in QUANTILES.items()
    ]
    out = joined.groupBy(*by, "total", "success").agg(*picks)
    out = out.withColumn("errors", F.col("total") - F.col("success"))
    if seconds is not None:
        out = out.withColumn("throughput", F.col("total") / seconds)
    return out
