"""Payloads to records in one narrow pass; the parts are DataFrames on one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.evaluate import dispatch_actions, evaluate_incidents
from faultline.operators.normalize import accepted, normalize, rejected, to_standard_incident


@dataclass(frozen=True)
class Ingested:
    """What one set of payloads turns into."""

    events: DataFrame
    quarantine: DataFrame
    records: DataFrame

    def response(self) -> DataFrame:
        """The short answer per payload."""
        return self.records.select(
            F.col("record_id").alias("incident_id"),
            F.col("source").alias("source_system"),
            F.col("workflow").alias("service"),
            "severity",
            "incident_type",
            F.col("status").alias("evaluation_status"),
            F.col("score").alias("evaluation_score"),
            "suggested_action",
        )

    def actions(self) -> DataFrame:
        return dispatch_actions(self.records)


def ingest(payloads: DataFrame, rules: DataFrame | None = None) -> Ingested:
    """raw, source_system, arrival_ts -> events, quarantine and evaluated records; no shuffle."""
    return ingest_normalized(normalize(payloads), rules)


def ingest_normalized(events: DataFrame, rules: DataFrame | None = None) -> Ingested:
    """The same from what `normalize` gave, for callers that keep it."""
    good = accepted(events)
    incidents = to_standard_incident(good).withColumnsRenamed({"id": "record_id", "timestamp": "event_time"})
    records = evaluate_incidents(incidents.withColumnRenamed("arrival_ts", "received_at"), rules)
    return Ingested(good, rejected(events), records)
