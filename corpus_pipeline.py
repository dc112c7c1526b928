"""Raw documents to packed training sequences: quality rules, near copies, personal data, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import minhash, mixing, packing, pii, quality_rules
from faultline.llm.common import saved
from faultline.session import prepare


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the verdict on their host keep."""
    return quality_rules.keep_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.one_of_each(docs, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data and secrets."""
    return pii.mask_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequences that hold them."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", keep_good),
    ("near copies", drop_copies),
    ("personal data", mask_personal_data),
    ("source mix", mix_sources),
    ("packing", pack),
]

# token ids and the balanced draw are beyond SQL; tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each on the written result of the one before."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
