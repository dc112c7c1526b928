import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.operators import cooldown as cd
from faultline.operators import slo
from faultline.operators.ingest import ingest
from faultline.operators.windows import window_service_summary, window_start
from faultline.sources import buffer as bf
from faultline.sources import payloads as pl
from faultline.sources import store as st
from faultline.streaming import alerts as sa
from faultline.streaming.ingest import start_ingest
from faultline.streaming.state import VersionedTable
from faultline.streaming.windows import flush, run_windows, start_windows, window_reports, window_summaries

START = datetime(2024, 1, 1)


SEVERITIES = ["low", "high", "critical"]


def window_rows(spark, folder, parts):
    """Files of events, each its own micro-batch; rows of one file lie up to hours before those of the file before."""
    schema = "timestamp timestamp, service string, severity string, incident_type string"
    for k, minutes in enumerate(parts):
        rows = [(START + timedelta(minutes=m) if m is not None else None, f"s{j % 3}", SEVERITIES[j % 3 if j % 5 else 0], f"t{j % 2}")
                for j, m in enumerate(minutes)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return schema


def batch_summary(spark, folder):
    rows = spark.read.parquet(f"{folder}/in").withColumn("batch_id", window_start("timestamp", 3600))
    return window_service_summary(rows).select(
        F.col("batch_id").alias("window_start"), "service", "count", "dominant_severity", "incident_types", "urgent")


def test_stream_windows_keep_rows_however_late(spark, tmp_path):
    parts = [range(0, 700, 7), [650, 720, 3, 65], [900, 1, 2, 3, 700], [5000], [10, 4999, 2000, None]]
    schema = window_rows(spark, tmp_path, parts)
    root = str(tmp_path / "out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start_windows(stream, root, 3600, every=None).awaitTermination()
    want = batch_summary(spark, tmp_path)
    closed = START + timedelta(minutes=5000 - 10) - timedelta(hours=1)
    got = window_summaries(spark, root)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.where(F.col("window_start") <= F.lit(closed)).collect()))
    assert spark.read.parquet(f"{root}/late").agg(F.sum("count")).first()[0] >= 8
    flush(spark, root, 3600)
    timed = window_summaries(spark, root).where("window_start IS NOT NULL")
    assert sorted(map(str, timed.collect())) == sorted(map(str, want.collect()))
    # a row without a time is in a window without a start, which the batch leaves out
    assert window_summaries(spark, root).where("window_start IS NULL").first()["count"] == 1
    # two versions of each touched day at most
    days = spark.read.parquet(f"{tmp_path}/in").select(F.to_date("timestamp")).distinct().count()
    assert VersionedTable(spark, f"{root}/sums", "x int").size() <= 2 * days
    report = {r.window_start: r for r in window_reports(spark, root, 3600).collect()}
    assert report[START].event_count == want.where(F.col("window_start") == F.lit(START)).agg(F.sum("count")).first()[0]
    # input that comes after all takes the flush back and gives the whole again
    window_rows(spark, tmp_path, [[5001, 5100, 8]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start_windows(stream, root, 3600, every=None).awaitTermination()
    flush(spark, root, 3600)
    timed = window_summaries(spark, root).where("window_start IS NOT NULL")
    assert sorted(map(str, timed.collect())) == sorted(map(str, batch_summary(spark, tmp_path).collect()))


def test_a_micro_batch_may_run_again(spark, tmp_path):
    rows = [(START + timedelta(minutes=m), f"s{m % 2}", "high", "t") for m in (0, 30, 200, 5)]
    df = spark.createDataFrame(rows, "timestamp timestamp, service string, severity string, incident_type string")
    root = str(tmp_path)
    run_windows(df, 0, root, 3600)
    for _ in range(3):
        run_windows(df, 1, root, 3600)
    flush(spark, root, 3600)
    assert window_summaries(spark, root).agg(F.sum("count")).first()[0] == 8


@pytest.mark.parametrize("by", [["series"], []], ids=["label", "none"])
def test_alert_states_of_a_stream(spark, tmp_path, by):
    names = ("a", "bb", "ccc") if by else ("a",)
    rows = [(s, 60 * i, (i * 7 + len(s)) % 11 > 2 and not (s == "ccc" and i >= 20)) for s in names for i in range(60)]
    schema = "series string, tick bigint, breached boolean"
    df = spark.createDataFrame(rows, schema)
    for k in range(6):
        df.where(F.col("tick").between(600 * k, 600 * k + 599)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = sa.alert_states(stream, 180, by, expiry=None).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    running = writer.option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    key = [*by, "tick", "state", "active_since"]
    got = spark.read.parquet(f"{tmp_path}/out").select(key)
    assert sorted(map(str, got.collect())) == sorted(map(str, slo.alert_state(df, 180, by).select(key).collect()))
    # state is kept where the condition holds, and nowhere else
    holding = df.where("tick = 3540 AND breached").count()
    assert holding < 3
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
    assert kept and kept[-1] <= 2 * holding and max(kept) <= 2 * len(names)


def test_stream_ingest_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        lines = [json.dumps({"service": f"s{i % 4}", "message": f"m{part}-{i}", "level": "ERROR", "timestamp": "2024-01-01T00:00:00Z"}) for i in range(20)]
        (folder / f"{part}.json").write_text("\n".join([*lines, "{broken"]))
    stream = pl.read_raw_payloads(spark, str(folder), "spring-boot", streaming=True)
    start_ingest(stream, str(tmp_path / "out"), None).awaitTermination()
    want = ingest(pl.read_raw_payloads(spark, str(folder), "spring-boot"))
    got = spark.read.parquet(str(tmp_path / "out" / "records"))
    # ids hold the place in the source, which a stream numbers by micro-batch
    names = ["workflow", "status", "score"]
    assert got.select("record_id").distinct().count() == 60
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.records.select(names).collect()))
    assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == want.quarantine.count() == 3
    assert spark.read.parquet(str(tmp_path / "out" / "actions")).count() == 60
    assert spark.read.parquet(str(tmp_path / "out" / "cycles")).agg(F.sum("records"), F.sum("actions")).collect()[0][0] == 60


def test_cooldown_batches_equal_one_batch(spark):
    rows = [(f"n{i % 2 if i % 7 else 0}", START + timedelta(seconds=i * 13 % 5000), f"{i:04d}") for i in range(400)]
    df = spark.createDataFrame(rows, "name string, ts timestamp, alert_id string").persist()
    want = sorted(r.alert_id for r in cd.cooldown_alerts(df, 60).collect())
    got, state = [], None
    for lo in range(0, 5000, 900):
        part = df.where(F.col("ts").between(START + timedelta(seconds=lo), START + timedelta(seconds=lo + 899)))
        fired, state = sa.cooldown_batch(part, state, 60)
        got += [r.alert_id for r in fired.collect()]
    assert sorted(got) == want


def test_alert_state_batches_equal_one_batch(spark):
    rows = [(s, 60 * i, (i * 7 + len(s)) % 11 > 2) for s in ("a", "bb") for i in range(60)]
    df = spark.createDataFrame(rows, "series string, tick bigint, breached boolean")
    key = ["series", "tick", "state", "active_since"]
    want = sorted(map(str, slo.alert_state(df, 180, ["series"]).select(key).collect()))
    got, state = [], None
    for lo in range(0, 3600, 600):
        states, state = sa.alert_state_batch(df.where(F.col("tick").between(lo, lo + 599)), state, 180, ["series"])
        got += map(str, states.select(key).collect())
    assert sorted(got) == want


def test_cooldown_stream(spark, tmp_path):
    schema = "name string, ts timestamp, alert_id string"
    for part in range(3):
        rows = [("n", START + timedelta(seconds=part * 300 + 20 * i), f"{part}-{i:02d}") for i in range(15)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    sa.start_cooldown(stream, str(tmp_path / "out"), 60, None).awaitTermination()
    fired = spark.read.parquet(str(tmp_path / "out" / "fired"))
    assert fired.count() == 15


def test_buffer_and_stores(spark, tmp_path):
    raw = '{"message": "m", "service": "s", "timestamp": "2024-01-01T00:00:00Z"}'
    df = spark.createDataFrame([(raw, "spring-boot", START + timedelta(seconds=i)) for i in range(3)],
                               "raw string, source_system string, arrival_ts timestamp")
    done = ingest(df)
    typed = done.events.withColumn("incident_type", F.lit("technical_error"))
    bf.append_stream(typed, str(tmp_path / "buffer"))
    bf.append_stream(typed, str(tmp_path / "buffer"))
    buffer = spark.read.parquet(str(tmp_path / "buffer"))
    assert buffer.count() == 6
    newest = buffer.agg(F.max("arrival_ts")).collect()[0][0]
    window = bf.scan_window(buffer, F.lit(newest), 3600)
    assert window.count() == 6 and window.collect()[0].error_type == ""
    assert bf.cap_buffer(buffer, 4).count() == 4
    st.write_evaluations(done.records, str(tmp_path / "records"))
    stored = st.read_table(spark, str(tmp_path / "records"))
    assert stored.count() == 3 and stored.select("result.score").distinct().count() == 1
    assert st.list_incidents(stored, "s", limit=2).count() == 2 and st.list_incidents(stored, status="ok").count() == 0
    st.write_actions(done.actions(), str(tmp_path / "actions"))
    assert st.list_actions(st.read_table(spark, str(tmp_path / "actions")), action_type="monitor").count() == 3
    with pytest.raises(ValueError):
        st.list_incidents(stored, limit=501)
