"""Word patterns, saved intermediate tables and connected components, shared by the operators here."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import shared_folder

# space and the five control characters that part words; in both Spark's and DuckDB's notation
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words of a text in order; none for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def saved(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, same rows at each read, short lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 100_000


def beside(small: DataFrame) -> DataFrame:
    """`small`, saved and of a few short columns, with a broadcast hint if its rows are few enough."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def beta_prior(counts: DataFrame, least: float = 2.0, most: float = 1000.0) -> tuple[Column, Column]:
    """(mean, strength) of a beta prior for the rates failed / n of the groups in `counts` (n, failed).

    The mean is that of all trials; the strength, in trials, comes from the spread of the rates by the method of
    moments, held between `least` and `most`, and is `most` where the rates do not spread beyond chance. One row of
    sums goes to the driver. Without trials both are null.
    """
    rate = F.col("failed") / F.col("n")
    total = counts.where("n > 0").agg(
        F.sum("n").cast("double").alias("tn"), F.sum("failed").cast("double").alias("tf"), F.count("*").cast("double").alias("g"),
        F.sum(1 / F.col("n")).alias("inv"), F.sum(F.col("failed") * rate).alias("sq"),
    )
    tn, tf, g, inv, sq = total.first()
    if not tn:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    mean = tf / tn
    noise = mean * (1 - mean)
    strength = most
    if g > 1:
        # weighted variance of the rates: sum n (rate - mean)^2 = sum failed * rate - tf^2 / tn
        spread = g * (sq - tf * tf / tn) / ((g - 1) * tn)
        between = spread - noise * inv / g
        if between > 0:
            strength = (noise - spread) / between
    return F.lit(mean), F.lit(min(max(strength, least), most))


def beta_prior_sql(counts: str, least: float = 2.0, most: float = 1000.0) -> str:
    """The same as a DuckDB query with one row (m, k) over the table `counts`."""
    return f"""
SELECT m, least(greatest(CASE WHEN g > 1 AND spread - noise * inv / g > 0
    THEN (noise - spread) / (spread - noise * inv / g) ELSE {most} END, {least}), {most}) AS k
FROM (SELECT tf / tn AS m, inv, g, (tf / tn) * (1 - tf / tn) AS noise, CASE WHEN g > 1 THEN g * (sq - tf * tf / tn) / ((g - 1) * tn) END AS spread
  FROM (SELECT sum(n)::DOUBLE AS tn, sum(failed)::DOUBLE AS tf, count(*)::DOUBLE AS g, sum(1.0 / n)::DOUBLE AS inv,
    sum(failed::DOUBLE * failed / n) AS sq FROM {counts} WHERE n > 0))"""


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b: bigint); component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortens the chains twice and replaces the ends of
    the links by what they hang on; links inside a component go. A chain shrinks at least four times a round,
    so the number of rounds follows the logarithm of the longest chain. All state is in saved tables.
    """
    links = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a"))
        hooked = saved(ends.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("up")), "hooked")
        for _ in range(2):
            above = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hooked = saved(hooked.join(above, "up").select("node", F.col("top").alias("up")), "hooked")
        if labels is None:
            labels = hooked.select("node", F.col("up").alias("component"))
        else:
            step = hooked.select(F.col("node").alias("component"), "up")
            labels = saved(
                labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")),
                "labels",
            )
        low = hooked.select(F.col("node").alias("a"), F.col("up").alias("x"))
        high = hooked.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = links.join(low, "a").join(high, "b").where("x <> y")
        links = saved(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
