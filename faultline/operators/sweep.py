"""Service levels as runs: one row for a stretch of steps with the same values, instead of a row per step.

A count enters a trailing window at its step and leaves it `window` seconds later. Between these change points nothing
changes, so a running total over them gives all windows, and the rows follow the events and not the time covered: a wrong
date makes one long run. Running totals go over blocks of the time axis with a carry, so a series without labels, or a label
that holds most events, is many tasks. Runs cover, for every label, the steps from the first to the last one seen of all
labels, like the grid of `slo`, and `at_steps` turns a stretch of them into that grid.

Rows without a time are left out; `slo.outside` gives them. A null label is a label.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.numeric import ratio
from faultline.operators.ordered import running
from faultline.operators.slo import DAY, TICK, Period, bucket_counts, bucket_names, bucket_quantile, step_counts
from faultline.session import stable

START, STOP = "start", "stop"


def trailing_runs(
    df: DataFrame, ts: str, step: int, window: int, by: Sequence[str], measures: Mapping[str, Column], period: Period | None = None
) -> DataFrame:
    """(by..., start, stop, measures..., seen): the sums of the trailing window at all steps from start to stop.

    `seen` says whether the label had a row at or before the run.
    """
    values = list(measures)
    counts = stable(step_counts(df, ts, step, by, measures, period).where(F.col(TICK).isNotNull()))
    first, last = counts.agg(F.min(TICK), F.max(TICK)).first()
    begin, end = F.lit(first).cast("bigint"), F.lit(last).cast("bigint")
    leave = counts.select(*by, (F.col(TICK) + window).alias(TICK), *[(-F.col(v)).alias(v) for v in values])
    points = counts.unionByName(leave).groupBy(*by, TICK).agg(*[F.sum(v).alias(f"_d_{v}") for v in values])
    changed = points.where(" OR ".join(f"_d_{v} <> 0" for v in values))
    total = running(changed, by, [TICK], {v: F.col(f"_d_{v}") for v in values}, {"_prev": F.col(TICK)})
    # a point ends the run before it, whose values are those without its own change
    before = total.select(
        *by, F.coalesce("_prev", begin).alias(START), F.least(F.col(TICK) - step, end).alias(STOP),
        *[(F.col(v) - F.col(f"_d_{v}")).alias(v) for v in values], F.col("_prev").isNotNull().alias("seen"),
    )
    # after its last change a label has nothing in the window; one whose rows count for no measure never changes
    last_change = F.max(F.when(F.greatest(*[F.abs(F.col(v)) for v in values], F.lit(0)) > 0, F.col(TICK) + window))
    after = counts.groupBy(*by).agg(last_change.alias("_end")).select(
        *by, F.coalesce("_end", begin).alias(START), end.alias(STOP), *[F.lit(0).cast("bigint").alias(v) for v in values],
        F.col("_end").isNotNull().alias("seen"),
    )
    return before.unionByName(after).where(F.col(START) <= F.col(STOP))


def at_steps(runs: DataFrame, step: int) -> DataFrame:
    """A row per step of each run; by days first, so that no long run is one array."""
    stride = max(1, DAY // step) * step
    kept = [c for c in runs.columns if c not in (START, STOP)]
    days = runs.select(*kept, STOP, F.explode(F.sequence(START, STOP, F.lit(stride).cast("bigint"))).alias("_d"))
    last = F.least(F.col("_d") + stride - step, F.col(STOP))
    return days.select(*kept, F.explode(F.sequence("_d", last, F.lit(step).cast("bigint"))).alias(TICK))


def rate_runs(
    df: DataFrame, ts: str, step: int, window: int, by: Sequence[str] = (), per: int = 1, period: Period | None = None
) -> DataFrame:
    """Rows per `per` seconds over the trailing window."""
    runs = trailing_runs(df, ts, step, window, by, {"n": F.lit(True)}, period)
    return runs.select(*by, START, STOP, (F.col("n") * per / window).alias("rate"))


def share_runs(
    df: DataFrame, ts: str, step: int, window: int, part: Column, by: Sequence[str] = (), whole: Column | None = None,
    period: Period | None = None,
) -> DataFrame:
    """Share of rows where `part` holds among all (or `whole`) rows of the trailing window; null without rows."""
    runs = trailing_runs(df, ts, step, window, by, {"part": part, "whole": F.lit(True) if whole is None else whole}, period)
    return runs.select(*by, START, STOP, ratio(F.col("part"), F.col("whole"), None).alias("value"))


def quantile_runs(
    df: DataFrame, ts: str, step: int, window: int, value: Column, bounds: Sequence[float], quantiles: Mapping[str, float],
    by: Sequence[str] = (), period: Period | None = None,
) -> DataFrame:
    """Quantiles of the trailing window from its bucket counts."""
    runs = trailing_runs(df, ts, step, window, by, {**bucket_counts(value, bounds), "n": value.isNotNull()}, period)
    counts = [F.col(n) for n in bucket_names(bounds)]
    return runs.select(*by, START, STOP, *[bucket_quantile(q, bounds, counts, F.col("n")).alias(n) for n, q in quantiles.items()])


def heatmap_runs(
    df: DataFrame, ts: str, step: int, window: int, value: Column, bounds: Sequence[float], period: Period | None = None
) -> DataFrame:
    """Observations per second that fall into each single bucket."""
    runs = trailing_runs(df, ts, step, window, [], {**bucket_counts(value, bounds), "n": value.isNotNull()}, period)
    cells, below = [], F.lit(0)
    for name, bound in zip([*bucket_names(bounds), "n"], [*map(float, bounds), float("inf")], strict=True):
        cells.append(F.struct(F.lit(bound).alias("le"), ((F.col(name) - below) / window).alias("rate")))
        below = F.col(name)
    return runs.select(START, STOP, F.explode(F.array(*cells)).alias("c")).select(START, STOP, "c.le", "c.rate")


def stalled_runs(df: DataFrame, ts: str, step: int, window: int, by: Sequence[str] = (), period: Period | None = None) -> DataFrame:
    """Whether a series that has been seen shows nothing in the trailing window."""
    runs = trailing_runs(df, ts, step, window, by, {"n": F.lit(True)}, period)
    return runs.select(*by, START, STOP, ((F.col("n") == 0) & F.col("seen")).alias("breached"))


def target_down_runs(heartbeats: DataFrame, ts: str, step: int, by: Sequence[str] = (), period: Period | None = None) -> DataFrame:
    """Whether a step has no heartbeat."""
    runs = trailing_runs(heartbeats, ts, step, step, by, {"n": F.lit(True)}, period)
    return runs.select(*by, START, STOP, (F.col("n") == 0).alias("breached"))


def alert_runs(conditions: DataFrame, hold: int | Column, step: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., state, active_since, start, stop): longest stretches of one state, from runs with `breached`.

    A scan over the runs finds where the other condition last held; a true stretch is pending until it has lasted `hold`
    seconds (one number, or one per row), then firing.
    """
    scanned = running(
        conditions.withColumn("_hold", (hold if isinstance(hold, Column) else F.lit(hold)).cast("bigint")), by, [START], {},
        {
            "_false": F.when(~F.col("breached"), F.col(STOP)), "_true": F.when(F.col("breached"), F.col(STOP)),
            "_none": -F.col(START),
        },
    )
    # the first start of the series is the negative of the highest negative start; a first run has none before it
    begin = F.coalesce(-F.col("_none"), F.col(START))
    since = F.when(F.col("breached"), F.coalesce(F.col("_false") + step, begin)).otherwise(F.coalesce(F.col("_true") + step, begin))
    fires = F.col("_since") + F.ceil(F.col("_hold") / step) * step

    def piece(state: str, start: Column, stop: Column) -> Column:
        return F.struct(F.lit(state).alias("state"), start.alias(START), stop.alias(STOP))

    pieces = F.when(~F.col("breached"), F.array(piece("inactive", F.col(START), F.col(STOP)))).otherwise(F.array(
        piece("pending", F.col(START), F.least(F.col(STOP), fires - step)), piece("firing", F.greatest(F.col(START), fires), F.col(STOP)),
    ))
    cut = scanned.withColumn("_since", since).select(*by, "_since", F.explode(pieces).alias("p")).where("p.start <= p.stop")
    merged = cut.groupBy(*by, "_since", "p.state").agg(F.min("p.start").alias(START), F.max("p.stop").alias(STOP))
    return merged.select(*by, "state", F.when(F.col("state") != "inactive", F.col("_since")).alias("active_since"), START, STOP)
