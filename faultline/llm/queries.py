"""The numbered queries over whole tables, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    classifier, embeddings, fingerprints, licenses, minhash, mixing, packing, periodic_runs, pii, quality_rules, tokens, url_filters, whitening,
)
from faultline.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, folder: build(prepare(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"))


@query("op2_url_filters", url_filters.ORACLE_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    # a page and a label of one number belong together
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return url_filters.judge_urls(table(spark, folder, "pages"), outcomes)


@query("op3_quality_rules", quality_rules.ORACLE_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, folder, "documents"))


@query("op4_near_duplicates", minhash.ORACLE_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_near_vectors", embeddings.ORACLE_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.link_vectors(table(spark, folder, "embeddings"))


@query("op6_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op7_quality_scores")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_licenses")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # the tables have no paths: a document lies in the directory of its language, inside that of its source
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = licenses.find_licenses(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return found.withColumnRenamed("file_id", "doc_id")


@query("op9_pseudonyms")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymize(table(spark, folder, "documents")).select("doc_id", "text", *pii.COUNTS)


@query("op10_mixing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings"))
    each = white.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        "part.whitened", "part.explained", "identity_error",
    )


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, folder, "documents")))
    found = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


@query("op13_fingerprints")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))
