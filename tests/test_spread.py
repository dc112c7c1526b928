"""Rows of a small file are dealt over all cores before work that is heavy per row."""

from pyspark.sql import functions as F

from faultline.operators.ingest import ingest
from faultline.plans.workload import incidents, payloads, payloads_of
from faultline.streaming.ingest import FEW, run_cycle


def test_one_file_is_many_tasks(spark, tmp_path):
    kinds = F.element_at(F.array(*map(F.lit, ("error", "purchase", "view", "click", "signup"))), (F.col("id") % 5 + 1).cast("int"))
    events = spark.range(4000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), (F.col("id") % 90).alias("user_id"),
        kinds.alias("event_type"), (F.col("id") % 200).cast("double").alias("value"), F.lit('{"k": 7}').alias("props"),
    )
    # ids may be null or stand there twice
    odd = events.where("event_id < 5").unionByName(events.where("event_id < 5").withColumn("event_id", F.lit(None).cast("bigint")))
    events.unionByName(odd).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    dealt, plain = payloads(spark, str(tmp_path)), payloads_of(incidents(spark, str(tmp_path)))
    tasks = dealt.groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in tasks) < 4010 / 4
    assert dealt.count() == 4010 and dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()


def test_a_cycle_over_one_file_is_many_tasks(spark, tmp_path):
    raw = F.concat(F.lit('{"level": "ERROR", "service": "svc-'), F.col("id") % 40, F.lit('", "message": "m '), F.col("id"), F.lit('"}'))
    rows = spark.range(0, FEW + 2000, 1, 1).select(
        F.col("id").cast("string").alias("incident_id"), F.lit("spring-boot").alias("source_system"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("arrival_ts"), F.when(F.col("id") % 97 > 0, raw).alias("raw"),
    )
    rows = rows.unionByName(rows.where("arrival_ts < timestamp_seconds(1700000005)")).coalesce(1)
    few = rows.where("arrival_ts < timestamp_seconds(1700000500)")
    for batch, payloads in enumerate((rows, few)):
        run_cycle(payloads, batch, str(tmp_path))
    done, small = ingest(rows), ingest(few)
    for name, whole, part in (("records", done.records, small.records), ("quarantine", done.quarantine, small.quarantine)):
        written = [spark.read.parquet(f"{tmp_path}/{name}/batch_id={batch}") for batch in (0, 1)]
        for found, wanted in zip(written, (whole, part), strict=True):
            # maps cannot be compared
            found, wanted = (df.select([c for c in whole.columns if c != "context"]) for df in (found, wanted))
            assert found.count() == wanted.count() and found.exceptAll(wanted).isEmpty()
        tasks = [df.groupBy(F.input_file_name().alias("f")).count().collect() for df in written]
        assert len(tasks[0]) >= spark.sparkContext.defaultParallelism and len(tasks[1]) == 1
        assert max(r["count"] for r in tasks[0]) <= 0.5 * whole.count()
