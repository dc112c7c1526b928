"""Bounded samples that are the same at each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """The `rows` rows of `df`, of `total`, whose `key` has the smallest hash; equal hashes go by key.

    Rows whose hash is surely too large (by ten deviations of the count below it) are dropped in the tasks, so what
    the last sort takes from all tasks together is little more than `rows`, however many tasks there are.
    """
    hashed = F.xxhash64(key)
    share = (rows + 10 * rows**0.5 + 10) / max(1, total)
    if share < 1:
        df = df.where(hashed < int(share * 2**64) - 2**63)
    return df.orderBy(hashed, key).limit(rows)
