"""Window summaries over a stream of events, with every row however late.

Each micro-batch is summed per window and service and merged into a table of sums, so neither state nor reports hold single
events. A window closes when the highest time seen is `lateness` past its end. A batch reports the windows that it closes,
and again those closed earlier that it has late rows for; what came late is kept beside. `flush` reports the windows still
open when the input ends, and a stream that goes on after it takes that back. The newest report of each window and service
is what the batch operators give over all rows so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.windows import is_urgent, nested_report, severity_rank, window_report, with_defaults
from faultline.session import folders
from faultline.streaming.state import BUCKET, VersionedTable, touched

LATENESS = 600
SUMS = "window_start timestamp, service string, count bigint, urgent bigint, best struct<rank:int,name:string>, kinds array<string>"
MARK = "high timestamp"


def _day(start: Column) -> Column:
    return F.coalesce(F.date_format(start, "yyyy-MM-dd"), F.lit("none"))


def _summed(events: DataFrame, seconds: int, ts: str) -> DataFrame:
    severity = F.col("severity")
    best = F.min(F.struct((-severity_rank(severity)).cast("int").alias("rank"), severity.alias("name")))
    # rows without a time are in a window without a start
    rows = with_defaults(events).withColumn("window_start", F.when(F.col(ts).isNotNull(), _start(F.col(ts), seconds)))
    return rows.groupBy("window_start", "service").agg(
        F.count("*").alias("count"), F.count_if(is_urgent(severity)).alias("urgent"), best.alias("best"),
        F.collect_set("incident_type").alias("kinds"),
    )


def _start(ts: Column, seconds: int) -> Column:
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def _merged(sums: DataFrame) -> DataFrame:
    return sums.groupBy("window_start", "service").agg(
        F.sum("count").alias("count"), F.sum("urgent").alias("urgent"), F.min("best").alias("best"),
        F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"),
    )


class _Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.sums = VersionedTable(spark, f"{root}/sums", SUMS)
        self.marks = VersionedTable(spark, f"{root}/marks", MARK)

    def high(self, before: int):
        row = self.marks.read(before).first()
        return row.high if row else None


def _ended(seconds: int, lateness: int, high) -> Column:
    """Windows that are closed once `high` was seen."""
    if high is None:
        return F.lit(False)
    end = F.col("window_start") + F.make_dt_interval(secs=F.lit(seconds + lateness))
    return F.coalesce(end <= F.lit(high), F.lit(False))


def run_windows(events: DataFrame, batch_id: int, root: str, seconds: int, lateness: int = LATENESS, ts: str = "timestamp") -> None:
    """One micro-batch."""
    store = _Store(events.sparkSession, root)
    new = _summed(events, seconds, ts).withColumn(BUCKET, _day(F.col("window_start"))).persist()
    days = touched(new)
    before = store.high(batch_id)
    # the time itself, not its window: a window may close by a row inside the next one
    seen = events.agg(F.max(ts)).first()[0]
    high = max((x for x in (before, seen) if x is not None), default=None)
    merged = _merged(store.sums.read(batch_id, days).unionByName(new.drop(BUCKET)))
    store.sums.write(merged.withColumn(BUCKET, _day(F.col("window_start"))), batch_id)
    mark = events.sparkSession.createDataFrame([(high,)], MARK).withColumn(BUCKET, F.lit("all"))
    store.marks.write(mark.coalesce(1), batch_id)

    closed, was_closed = _ended(seconds, lateness, high), _ended(seconds, lateness, before)
    late = new.where(was_closed).drop(BUCKET)
    # windows without rows now close too: those of the days between the two marks
    span = "none" if before is None else f"{before:%Y-%m-%d}"
    known = [b for b in (n.split("=", 1)[1] for n in store.sums._versions()) if b in days or (b != "none" and b >= _day_before(span, seconds + lateness))]
    state = store.sums.read(batch_id + 1, known).where(closed)
    again = late.select(F.col("window_start").alias("_w"), F.col("service").alias("_s")).distinct()
    fresh = state.where(~was_closed)
    revised = state.where(was_closed).join(again, (F.col("window_start") == F.col("_w")) & (F.col("service") == F.col("_s")), "left_semi")
    fresh.unionByName(revised).write.mode("overwrite").parquet(f"{root}/closed/batch_id={batch_id}")
    late.write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
    new.unpersist()


def _day_before(day: str, reach: int) -> str:
    """The first day whose windows may have been open when `day` was seen."""
    import datetime

    if day == "none":
        return ""
    return (datetime.date.fromisoformat(day) - datetime.timedelta(seconds=reach, days=1)).isoformat()


def flush(spark: SparkSession, root: str, seconds: int, lateness: int = LATENESS) -> None:
    """Report the windows that are still open; to be called when the input has ended and the stream has stopped."""
    store = _Store(spark, root)
    after = 1 + max((int(n.split("=")[1]) for n in folders(spark, f"{root}/closed")), default=-1)
    rows = store.sums.read(after).where(~_ended(seconds, lateness, store.high(after)))
    rows.write.mode("overwrite").parquet(f"{root}/closed/batch_id={after}")


def start_windows(
    events: DataFrame, root: str, seconds: int, lateness: int = LATENESS, ts: str = "timestamp", every: int | None = 10
) -> StreamingQuery:
    """Keep the sums and reports of windows of `seconds` under `root`; None takes what is there now and stops."""
    trigger = {"availableNow": True} if every is None else {"processingTime": f"{every} seconds"}
    writer = events.writeStream.foreachBatch(lambda df, batch_id: run_windows(df, batch_id, root, seconds, lateness, ts))
    return writer.option("checkpointLocation", f"{root}/_progress").trigger(**trigger).start()


def window_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Per reported window and service the newest summary, as the batch operator gives it."""
    reports = spark.read.schema(f"{SUMS}, batch_id int").parquet(f"{root}/closed")
    fields = ("count", "urgent", "best", "kinds")
    newest = reports.groupBy("window_start", "service").agg(F.max_by(F.struct(*fields), "batch_id").alias("r"))
    return newest.select(
        "window_start", "service", "r.count", F.col("r.best.name").alias("dominant_severity"),
        F.sort_array("r.kinds").alias("incident_types"), "r.urgent",
    )


def window_reports(spark: SparkSession, root: str, seconds: int) -> DataFrame:
    """The nested report of each reported window."""
    summary = window_summaries(spark, root)
    return nested_report(window_report(summary, seconds, "window_start"), summary, "window_start")
