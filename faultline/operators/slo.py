"""Rates, histograms, quantiles and alert states on a step grid.

One input row stands for one increment. Rows are counted per step first; everything after works on
(label, step) rows, whose number depends on the time covered and not on the traffic. A step at time t
holds what happened in (t - step, t], and a trailing window of w seconds holds (t - w, t].

A `period` (first and last second) bounds the grid: rows outside it are left out, and `outside` gives them. Without
one the grid reaches from the first to the last time seen, and a span of more than MOST_STEPS steps is an error, so
one wrong date neither fills the cluster nor loses rows unseen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.joins import join_with_nulls
from faultline.functions.numeric import ratio

TICK = "tick"
DAY = 86400
MOST_STEPS = 5_000_000  # of a label: nine years of minutes
Period = tuple[int, int]


def tick_of(ts: Column | str, step: int) -> Column:
    """Epoch second of the step a timestamp belongs to."""
    # whole-number arithmetic: shift into the step that ends at or after the time
    micros = F.unix_micros(ts) + F.lit(step * 1000000 - 1)
    return F.floor((micros - F.pmod(micros, F.lit(step * 1000000))) / 1000000)


def _inside(ts: str, period: Period) -> Column:
    # compared as times, so that a scan can skip files
    return F.col(ts).between(F.timestamp_seconds(F.lit(period[0])), F.timestamp_seconds(F.lit(period[1])))


def outside(df: DataFrame, ts: str, period: Period) -> DataFrame:
    """The rows that a grid over `period` leaves out, those without a time among them."""
    return df.where(~F.coalesce(_inside(ts, period), F.lit(False)))


def step_counts(
    df: DataFrame, ts: str, step: int, by: Sequence[str], measures: Mapping[str, Column], period: Period | None = None
) -> DataFrame:
    """Counts per label and step, only where there is something; conditions are counted where true."""
    if period:
        df = df.where(_inside(ts, period))
    sums = [F.count_if(c).alias(n) for n, c in measures.items()]
    return df.groupBy(*by, tick_of(ts, step).alias(TICK)).agg(*sums)


def dense(counts: DataFrame, step: int, by: Sequence[str]) -> DataFrame:
    """A row for every label and every step between the first and the last step of all labels."""
    values = [c for c in counts.columns if c not in (*by, TICK)]
    everything = Window.partitionBy()
    spans = counts.groupBy(*by).agg(F.min(TICK).alias("_a"), F.max(TICK).alias("_b"))
    spans = spans.select(*by, F.min("_a").over(everything).alias("_a"), F.max("_b").over(everything).alias("_b"))
    steps = (F.col("_b") - F.col("_a")) / step
    wide = F.concat(F.lit("the times seen span "), steps.cast("bigint").cast("string"), F.lit(" steps: give a period"))
    spans = spans.withColumn("_b", F.when(steps > MOST_STEPS, F.raise_error(wide).cast("bigint")).otherwise(F.col("_b")))
    # by days first, so that no long span is one array
    stride = max(1, DAY // step) * step
    days = spans.select(*by, "_b", F.explode(F.sequence("_a", "_b", F.lit(stride).cast("bigint"))).alias("_d"))
    last = F.least(F.col("_d") + stride - step, F.col("_b"))
    grid = days.select(*by, F.explode(F.sequence("_d", last, F.lit(step).cast("bigint"))).alias(TICK))
    joined = join_with_nulls(grid, counts, [*by, TICK], "left")
    return joined.select(*by, TICK, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def trailing(series: DataFrame, step: int, window: int, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Replaces each value by its sum over the trailing window: PromQL increase without extrapolation."""
    frame = Window.partitionBy(*by).orderBy(TICK).rangeBetween(-(window - step), 0)
    return series.withColumns({v: F.sum(v).over(frame) for v in values})


def increase(
    df: DataFrame, ts: str, step: int, window: int, by: Sequence[str], measures: Mapping[str, Column], period: Period | None = None
) -> DataFrame:
    counts = dense(step_counts(df, ts, step, by, measures, period), step, by)
    return trailing(counts, step, window, by, list(measures))


def rate(df: DataFrame, ts: str, step: int, window: int, by: Sequence[str], per: int = 1, period: Period | None = None) -> DataFrame:
    """Rows per `per` seconds over the trailing window."""
    counted = increase(df, ts, step, window, by, {"n": F.lit(True)}, period)
    return counted.select(*by, TICK, (F.col("n") * per / window).alias("rate"))


def share(
    df: DataFrame, ts: str, step: int, window: int, part: Column, by: Sequence[str] = (), whole: Column | None = None,
    period: Period | None = None,
) -> DataFrame:
    """Share of rows where `part` holds among all (or `whole`) rows of the trailing window; null without rows."""
    counted = increase(df, ts, step, window, by, {"part": part, "whole": F.lit(True) if whole is None else whole}, period)
    return counted.select(*by, TICK, ratio(F.col("part"), F.col("whole"), None).alias("value"))


def counter_by_label(df: DataFrame, ts: str, step: int, by: Sequence[str]) -> DataFrame:
    """Running total per label at each step with an increment."""
    counts = step_counts(df, ts, step, by, {"n": F.lit(True)})
    if not by:
        # one series: in blocks of steps
        from faultline.operators.ordered import running_totals

        return running_totals(counts, [], [TICK], {"total": F.col("n")})
    upto = Window.partitionBy(*by).orderBy(TICK).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("total", F.sum("n").over(upto))


def counter_increase(samples: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """Total increase per series of sampled counters; a fall means a reset, and the new value counts whole.

    A series may hold most of the samples, so neighbours are found by position in overlapping runs.
    """
    from faultline.operators.ordered import row_numbers, sliding

    placed = row_numbers(samples, by, [ts, value], "_no")
    paired = sliding(placed, by, "_no", 1, {"_before": F.first(value)})
    now, before = F.col(value), F.col("_before")
    step = F.when(F.col("_no") == 1, F.lit(0)).when(now < before, now).otherwise(now - before)
    return paired.groupBy(*by).agg(F.count("*").alias("samples"), F.sum(step).alias("increase"))


# --- histograms ---------------------------------------------------------------------------------
def bucket_names(bounds: Sequence[float]) -> list[str]:
    return [f"b{i}" for i in range(len(bounds))]


def bucket_counts(value: Column, bounds: Sequence[float]) -> dict[str, Column]:
    """Name -> condition of each cumulative bucket, without the infinite one."""
    return {n: value <= float(b) for n, b in zip(bucket_names(bounds), bounds)}


def histogram_buckets(df: DataFrame, value: Column, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts as rows (le, count), the last one for infinity, with the total sum beside."""
    named = bucket_counts(value, bounds)
    wide = df.groupBy(*by).agg(
        *[F.count_if(c).alias(n) for n, c in named.items()], F.count(value).alias("all"),
        F.sum(value.cast("decimal(24,6)")).cast("double").alias("total"),
    )
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(n).alias("count")) for n, b in zip(named, bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("count")))
    return wide.select(*by, F.col("total").alias("sum"), F.explode(F.array(*pairs)).alias("b")).select(*by, "b.le", "b.count", "sum")


def bucket_quantile(q: float, bounds: Sequence[float], counts: Sequence[Column], total: Column) -> Column:
    """Quantile by linear interpolation inside the first bucket that reaches q * total.

    Above the highest bound it is that bound; null without observations.
    """
    rank = total * q
    result = F.when(total == 0, F.lit(None).cast("double"))
    low, below = 0.0, F.lit(0)
    for bound, count in zip(bounds, counts):
        bound = float(bound)
        inside = F.lit(bound) if bound <= 0 else F.lit(low) + F.lit(bound - low) * ((rank - below) / F.nullif(count - below, F.lit(0)))
        result = result.when(count >= rank, inside)
        low, below = bound, count
    return result.otherwise(float(bounds[-1]))


def trailing_quantiles(
    df: DataFrame, ts: str, step: int, window: int, value: Column, bounds: Sequence[float],
    quantiles: Mapping[str, float], by: Sequence[str] = (), period: Period | None = None,
) -> DataFrame:
    """Quantiles of the trailing window from its bucket counts, as histogram_quantile(q, rate(...))."""
    measures = {**bucket_counts(value, bounds), "n": value.isNotNull()}
    summed = increase(df, ts, step, window, by, measures, period)
    counts = [F.col(n) for n in bucket_names(bounds)]
    return summed.select(
        *by, TICK, *[bucket_quantile(q, bounds, counts, F.col("n")).alias(n) for n, q in quantiles.items()]
    )


def bucket_heatmap(
    df: DataFrame, ts: str, step: int, window: int, value: Column, bounds: Sequence[float], period: Period | None = None
) -> DataFrame:
    """Observations per second that fall into each single bucket, per step."""
    measures = {**bucket_counts(value, bounds), "n": value.isNotNull()}
    summed = increase(df, ts, step, window, [], measures, period)
    names = [*bucket_names(bounds), "n"]
    cells, below = [], F.lit(0)
    for name, bound in zip(names, [*map(float, bounds), float("inf")]):
        cells.append(F.struct(F.lit(bound).alias("le"), ((F.col(name) - below) / window).alias("rate")))
        below = F.col(name)
    return summed.select(TICK, F.explode(F.array(*cells)).alias("c")).select(TICK, "c.le", "c.rate")


# --- alerts -------------------------------------------------------------------------------------
def stalled(df: DataFrame, ts: str, step: int, window: int, by: Sequence[str] = (), period: Period | None = None) -> DataFrame:
    """Steps at which a series that has been seen shows nothing in the trailing window."""
    counts = dense(step_counts(df, ts, step, by, {"n": F.lit(True)}, period), step, by)
    seen = Window.partitionBy(*by).orderBy(TICK).rowsBetween(Window.unboundedPreceding, 0)
    marked = counts.withColumn("_seen", F.sum("n").over(seen))
    summed = trailing(marked, step, window, by, ["n"])
    return summed.select(*by, TICK, ((F.col("n") == 0) & (F.col("_seen") > 0)).alias("breached"))


def target_down(heartbeats: DataFrame, ts: str, step: int, by: Sequence[str] = (), period: Period | None = None) -> DataFrame:
    """Steps without any heartbeat."""
    counts = dense(step_counts(heartbeats, ts, step, by, {"n": F.lit(True)}, period), step, by)
    return counts.select(*by, TICK, (F.col("n") == 0).alias("breached"))


def breached(
    values: DataFrame, above: float | Column | None = None, below: float | Column | None = None, value: str = "value"
) -> DataFrame:
    """Adds the condition of a threshold alert, one limit or one per row; no value means it does not hold."""
    test = F.col(value) > above if above is not None else F.col(value) < below
    return values.withColumn("breached", F.coalesce(test, F.lit(False)))


def alert_state(conditions: DataFrame, hold: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """inactive, pending or firing per step: firing once the condition has held for `hold` seconds, one number or one per row."""
    order = Window.partitionBy(*by).orderBy(TICK).rowsBetween(Window.unboundedPreceding, 0)
    # the number of false steps so far names the run a true step belongs to
    marked = conditions.withColumn("_run", F.sum(F.when(F.col("breached"), 0).otherwise(1)).over(order))
    run = Window.partitionBy(*by, "_run")
    since = F.min(F.when(F.col("breached"), F.col(TICK))).over(run)
    state = (
        F.when(~F.col("breached"), "inactive").when(F.col(TICK) - F.col("_since") >= hold, "firing").otherwise("pending")
    )
    return marked.withColumn("_since", since).withColumn("state", state).withColumn(
        "active_since", F.when(F.col("breached"), F.col("_since"))
    ).drop("_run", "_since")
