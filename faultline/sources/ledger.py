"""Ingesting folders that grow: each file once, each line once.

A ledger lists the files already taken, with length and modification time. A run takes the files that are not in it in
that state, in batches; a file that was taken before in another state has changed, and of its lines only those are taken whose
id, which says file, line number and text, is not stored yet. A batch writes its results into folders of its own and its
ledger entries last, so a batch that was cut off is done again over its own output, and nothing is stored twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.ingest import ingest
from faultline.operators.normalize import with_ids
from faultline.session import exists
from faultline.sources.payloads import read_raw_payloads

FILES_AT_ONCE = 10_000
ENTRY = "file string, length bigint, modified timestamp, source_system string"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, length, modified) of the files in a folder; their contents are not read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(
        "path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """All entries so far, with the batch that made them."""
    path = f"{root}/ledger"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{ENTRY}, batch_id int")
    return spark.read.schema(f"{ENTRY}, batch_id int").parquet(path)


def pending(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """Files that are not in the ledger as they are now, with the batches that took them in an earlier state."""
    taken = ledger(spark, root)
    waiting = listed(spark, folder).join(taken.select("file", "length", "modified"), ["file", "length", "modified"], "left_anti")
    before = taken.groupBy("file").agg(F.collect_set("batch_id").alias("batches"))
    return waiting.join(before, "file", "left")


def _stored_ids(spark: SparkSession, root: str, batches: list[int]) -> DataFrame:
    """Ids of what some batches stored, accepted or not."""
    parts = []
    for name, key in (("records", "record_id"), ("quarantine", "incident_id")):
        stored = spark.read.parquet(f"{root}/{name}").where(F.col("batch_id").isin(batches))
        parts.append(stored.select(F.col(key).alias("incident_id")))
    return parts[0].union(parts[1])


def ingest_folder(spark: SparkSession, folder: str, root: str, source_system: str, files_at_once: int = FILES_AT_ONCE) -> int:
    """Take what a folder holds and `root` does not: records, quarantine and the ledger under `root`. Gives the number of batches.

    Folders of several source systems may go into one `root`.
    """
    done = 0
    while True:
        last = ledger(spark, root).agg(F.max("batch_id")).first()[0]
        batch_id = 0 if last is None else last + 1
        files = pending(spark, folder, root).orderBy("modified", "file").limit(files_at_once).collect()
        if not files:
            return done
        payloads = with_ids(read_raw_payloads(spark, [f.path for f in files], source_system))
        earlier = sorted({b for f in files for b in f.batches or []})
        if earlier:
            # a new file's lines cannot be stored, so they find nothing here
            payloads = payloads.join(_stored_ids(spark, root, earlier), "incident_id", "left_anti")
        made = ingest(payloads)
        for name, rows in (("records", made.records), ("quarantine", made.quarantine)):
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
        entries = spark.createDataFrame([(f.file, f.length, f.modified, source_system) for f in files], ENTRY)
        entries.coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/batch_id={batch_id}")
        done += 1
