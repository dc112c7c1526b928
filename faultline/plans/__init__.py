"""All named queries."""

from faultline.plans import (  # noqa: F401
    folder_queries,
    ingest_queries,
    service_queries,
    state_queries,
    stream_queries,
    sweep_queries,
    trend_queries,
    window_queries,
)
from faultline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
