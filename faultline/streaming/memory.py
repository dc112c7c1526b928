"""What the cycle remembers: records of earlier cycles, found by their vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.operators.inverted import InvertedFile
from faultline.operators.similarity import PER_CELL

# what the context of an evaluation says about a neighbour
FIELDS = ("workflow", "incident_type", "severity", "status", "score", "summary", "suggested_action")


class CycleMemory:
    """An inverted file beside the cycle's records; `embed` maps records to (record_id, embedding)."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[DataFrame], DataFrame], k: int = 3, per_cell: int = PER_CELL):
        self.embed = embed
        self.file = InvertedFile(spark, f"{root}/memory", FIELDS, per_cell, k)

    def recall(self, records: DataFrame, batch_id: int) -> DataFrame | None:
        """The neighbours of the records among those of earlier cycles; None in the first one."""
        return self.file.search(self.embed(records).withColumnRenamed("record_id", "query_id"), batch_id)

    def remember(self, records: DataFrame, batch_id: int) -> None:
        vectors = self.embed(records).select("record_id", "embedding")
        self.file.extend(records.select("record_id", *FIELDS).join(vectors, "record_id"), batch_id)
