"""Queries over folders of raw files that are made from the tables first."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from faultline.operators.normalize import NORMALIZERS
from faultline.plans.registry import query
from faultline.plans.workload import EVT, incidents, payloads_of
from faultline.session import shared_folder
from faultline.sources.ledger import ingest_folder
from faultline.sources.payloads import read_raw_payloads


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/faultline-{name}-{uuid.uuid4().hex[:12]}"


@query(
    "read_raw_payloads",
    f"""WITH {EVT} SELECT source_system, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS places,
      CAST(sum(CASE WHEN reasons = 'payload is not a JSON object' THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM evt GROUP BY 1""",
)
def raw_payloads(spark, folder):
    root = _scratch(spark, "raw")
    parts = []
    for source in NORMALIZERS:
        mine = payloads_of(incidents(spark, folder)).where(F.col("source_system") == source)
        mine.select("raw").write.text(f"{root}/{source}")
        parts.append(read_raw_payloads(spark, f"{root}/{source}", source))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("source_system").agg(
        F.count("*").alias("lines"), F.count_distinct("position").alias("places"),
        F.count_if(F.try_parse_json("raw").isNull()).alias("broken"),
    )


@query(
    "reingest_grown_folder",
    f"""WITH {EVT} SELECT source_system, service, severity, incident_type, batch, CAST(count(*) AS BIGINT) AS records,
        CAST(count(*) AS BIGINT) AS ids, TRUE AS old_ids_stay FROM
      (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'later' ELSE 'first' END AS batch FROM
        (SELECT source_system, service, severity, incident_type, event_id // 3 AS event_id FROM good)) GROUP BY ALL""",
)
def reingest_grown_folder(spark, folder):
    """Files are ingested, the folders grow, and they are ingested twice more."""
    root = _scratch(spark, "grown")
    # every third event of a source comes later
    later = F.expr("CAST(substring(incident_id, 5, 12) AS BIGINT) DIV 3 % 3 = 0")
    all_rows = payloads_of(incidents(spark, folder)).withColumn("later", later)
    seen = []
    for arrives in (~F.col("later"), F.col("later"), None):
        for source in NORMALIZERS:
            if arrives is not None:
                all_rows.where(arrives & (F.col("source_system") == source)).select("raw").write.mode("append").text(f"{root}/in/{source}")
            ingest_folder(spark, f"{root}/in/{source}", f"{root}/out", source)
        seen.append(spark.read.parquet(f"{root}/out/records").select("record_id"))
    stored = spark.read.parquet(f"{root}/out/records")
    # the first three batches are the folders as they were, one per source
    first = F.when(F.col("batch_id") < 3, "first").otherwise("later")
    kept = seen[0].select("record_id", F.lit(True).alias("_kept")).distinct()
    marked = stored.withColumn("batch", first).join(kept, "record_id", "left")
    return marked.groupBy(F.col("source").alias("source_system"), F.col("workflow").alias("service"), "severity", "incident_type", "batch").agg(
        F.count("*").alias("records"), F.count_distinct("record_id").alias("ids"),
        F.bool_and((F.col("batch") == "later") | F.coalesce("_kept", F.lit(False))).alias("old_ids_stay"),
    )
