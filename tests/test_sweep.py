"""Runs against the step grid, with a wrong date, and without labels over many tasks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.operators import slo, sweep

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(START + timedelta(seconds=(i * i * 37) % 40000), "a" if i % 3 else ("b" if i % 2 else None), float(i % 9)) for i in range(400)]
    rows += [(START + timedelta(seconds=90000 + i), "c", 1.0) for i in range(50)]
    return spark.createDataFrame(rows, "ts timestamp, label string, v double").persist()


def grid(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("by", [[], ["label"]], ids=["all", "label"])
@pytest.mark.parametrize("window", [60, 600])
def test_runs_are_the_grid(events, by, window):
    measures = {"p": F.col("v") > 4, "n": F.lit(True)}
    runs = sweep.trailing_runs(events, "ts", 60, window, by, measures)
    want = slo.increase(events, "ts", 60, window, by, measures)
    assert grid(sweep.at_steps(runs, 60), *by, "tick", "p", "n") == grid(want, *by, "tick", "p", "n")
    assert runs.count() < want.count() / (1.2 if window == 60 else 2)


@pytest.mark.parametrize("by", [[], ["label"]], ids=["all", "label"])
@pytest.mark.parametrize("hold", [0, 60, 150, 600])
def test_alert_runs_are_the_states(events, by, hold):
    share = lambda module, name: getattr(module, name)(events, "ts", 60, 300, F.col("v") > 3, by)
    runs = sweep.alert_runs(slo.breached(share(sweep, "share_runs"), above=0.5), hold, 60, by)
    states = slo.alert_state(slo.breached(share(slo, "share"), above=0.5), hold, by)
    columns = [*by, "tick", "state", "active_since"]
    assert grid(sweep.at_steps(runs, 60), *columns) == grid(states, *columns)
    # no two runs of one state touch
    pairs = runs.alias("a").join(runs.alias("b"), F.col("a.stop") + 60 == F.col("b.start")).where("a.state = b.state AND a.active_since <=> b.active_since")
    same = F.lit(True) if not by else F.col("a.label").eqNullSafe(F.col("b.label"))
    assert pairs.where(same).count() == 0


def test_stalled_and_down(events):
    for by in ([], ["label"]):
        got = sweep.at_steps(sweep.stalled_runs(events, "ts", 60, 300, by), 60)
        assert grid(got, *by, "tick", "breached") == grid(slo.stalled(events, "ts", 60, 300, by), *by, "tick", "breached")
        got = sweep.at_steps(sweep.target_down_runs(events, "ts", 60, by), 60)
        assert grid(got, *by, "tick", "breached") == grid(slo.target_down(events, "ts", 60, by), *by, "tick", "breached")


def test_a_wrong_date_neither_fails_nor_fills(spark, events):
    far = events.unionByName(spark.createDataFrame([(datetime(9999, 12, 31), "a", 9.0), (None, "a", 1.0)], events.schema))
    for by in ([], ["label"]):
        near = sweep.trailing_runs(events, "ts", 60, 300, by, {"n": F.lit(True)}).count()
        runs = sweep.trailing_runs(far, "ts", 60, 300, by, {"n": F.lit(True)})
        assert near <= runs.count() <= near + 12
        states = sweep.alert_runs(sweep.stalled_runs(far, "ts", 60, 300, by), 600, 60, by)
        assert states.where("state = 'firing' AND stop - start > 86400 * 365").count() >= 1


def test_one_series_is_many_tasks(spark):
    day = spark.range(200_000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 61).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = sweep.trailing_runs(day, "ts", 60, 300, [], {"n": F.col("ts").isNotNull()})
        blocks = runs.withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    total = sum(r["count"] for r in blocks)
    assert total > 1000 and max(r["count"] for r in blocks) < 0.6 * total


def test_nothing_gives_nothing(spark, events):
    none = events.where("label = 'nobody'")
    assert sweep.trailing_runs(none, "ts", 60, 300, [], {"n": F.lit(True)}).count() == 0
    assert sweep.alert_runs(sweep.stalled_runs(none, "ts", 60, 300), 60, 60).count() == 0
    # rows that count for no measure still open their label's series
    zero = sweep.trailing_runs(events, "ts", 60, 300, ["label"], {"n": F.lit(False)})
    assert zero.count() == 4 and zero.agg(F.sum("n")).first()[0] == 0
