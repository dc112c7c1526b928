"""A table in buckets that micro-batches change.

Batch n reads the newest version below n of the buckets it touches and writes these whole as version n; other buckets are
neither read nor written. A batch that runs again reads the same versions and overwrites its own. Of each bucket the newest
version and the one before it stay, so the table grows with its buckets and not with the batches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import delete, folders

BUCKET = "bucket"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> dict[str, list[int]]:
        """The versions of each bucket, oldest first, from the names of the folders."""
        found: dict[str, list[int]] = {}
        for version in sorted(int(v.split("=")[1]) for v in folders(self.spark, self.path)):
            for name in folders(self.spark, f"{self.path}/version={version}"):
                if name.startswith(f"{BUCKET}="):
                    found.setdefault(name, []).append(version)
        return found

    def read(self, before: int, buckets: Iterable[str] | None = None) -> DataFrame:
        """The rows as they were before a batch, of all buckets or of some."""
        wanted = None if buckets is None else {f"{BUCKET}={b}" for b in buckets}
        paths = []
        for name, versions in self._versions().items():
            older = [v for v in versions if v < before]
            if older and (wanted is None or name in wanted):
                paths.append(f"{self.path}/version={older[-1]}/{name}")
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """All rows of the touched buckets, with the bucket in `bucket`; then older versions go."""
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/version={batch_id}")
        self.prune(batch_id)

    def prune(self, batch_id: int) -> None:
        versions = self._versions()
        for name, known in versions.items():
            # batch_id itself may be written again from the one before it
            older = [v for v in known if v < batch_id]
            for version in older[:-1]:
                delete(self.spark, f"{self.path}/version={version}/{name}")
        for version in {v for known in versions.values() for v in known if v < batch_id}:
            if not any(n.startswith(f"{BUCKET}=") for n in folders(self.spark, f"{self.path}/version={version}")):
                delete(self.spark, f"{self.path}/version={version}")

    def size(self) -> int:
        """Number of stored bucket versions."""
        return sum(len(v) for v in self._versions().values())


def touched(rows: DataFrame, bucket: str = BUCKET) -> list[str]:
    """The buckets that some rows are in; buckets are days or a fixed number of hash values, so they are few."""
    return [r[0] for r in rows.select(F.col(bucket)).distinct().collect()]
