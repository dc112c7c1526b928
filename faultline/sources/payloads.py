"""Reading raw payloads and numeric texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.session import stable

BROADCAST_SPLITS = 100_000


def read_raw_payloads(
    spark: SparkSession, path: str | Sequence[str], source_system: str, streaming: bool = False
) -> DataFrame:
    """One JSON payload per line -> raw, source_system, arrival_ts (time the file was written) and position.

    The position is the file and the number of the line in it, so it stays the same when files are added, when
    lines are added to a file, and however the file is split. On a stream the parts that give it (`file`, `split`)
    come instead, and `with_positions` is called per micro-batch, see `streaming.ingest`.
    """
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("text").load(path if isinstance(path, str) else list(path))
    lines = lines.select(
        F.col("value").alias("raw"),
        F.lit(source_system).alias("source_system"),
        F.col("_metadata.file_modification_time").alias("arrival_ts"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
    )
    return lines if streaming else with_positions(lines)


def with_positions(lines: DataFrame) -> DataFrame:
    """Lines with `file` and `split` -> the same with `position` instead; blank lines are counted and left out.

    A split is read by one task in order, so a line's number is its rank in the split plus the lines of the splits before.
    These are counted in a scan of their own: one row per split, which is one per 128 MB by default.
    """
    rows = lines.withColumn("_row", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = stable(splits.select(
        F.col("file").alias("_file"), F.col("split").alias("_split"), "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    ))
    if splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    numbered = rows.join(splits, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    line = F.col("_row") - F.col("_first") + F.col("_before") + 1
    numbered = numbered.withColumn("position", F.concat_ws(":", "file", line)).where(F.trim("raw") != "")
    return numbered.select(*[c for c in lines.columns if c not in ("file", "split")], "position")


def read_kafka_payloads(spark: SparkSession, servers: str, topic: str, source_system: str) -> DataFrame:
    """A topic of JSON payloads as a stream (needs the Kafka connector on the class path)."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return stream.select(
        F.col("value").cast("string").alias("raw"), F.lit(source_system).alias("source_system"),
        F.col("timestamp").alias("arrival_ts"), F.concat_ws(":", "topic", "partition", "offset").alias("position"),
    )


def to_number(text: Column) -> Column:
    """Text as a number the way JavaScript's Number does: null and blank are 0, hex and friends count."""
    stripped = F.trim(text)
    based = (
        F.when(stripped.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(stripped, F.lit(3), F.length(stripped)), 16, 10))
        .when(stripped.rlike("^0[bB][01]+$"), F.conv(F.substring(stripped, F.lit(3), F.length(stripped)), 2, 10))
        .when(stripped.rlike("^0[oO][0-7]+$"), F.conv(F.substring(stripped, F.lit(3), F.length(stripped)), 8, 10))
    )
    decimal = F.when(stripped.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)$"), stripped)
    return F.when(text.isNull() | (stripped == ""), 0.0).otherwise(F.coalesce(based, decimal).try_cast("double"))


def split_numeric(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a number, largest first; rows whose text is no number)."""
    number = to_number(F.col(column))
    invalid = df.where(number.isNull())
    valid = df.withColumn(column, number).where(F.col(column).isNotNull())
    return valid.orderBy(F.desc(column)), invalid
