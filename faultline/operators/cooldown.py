"""Greedy hold-off: an alert fires only if the last one that fired under its name is long enough ago.

Which alert fires depends on all before it, so a name is a chain. Rows are range-partitioned on
(name, time) into blocks. One scan finds for each block what becomes of any time that may have fired last
before it: a step function with a step per alert in the first hold of the block, fewer where chains meet.
The driver follows these functions from block to block, and a second scan gives the rows. Only a block
with more than STEPS steps is scanned again for a certain start, as often as that start changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.ordered import BLOCK, ordered_blocks

STEPS = 1024  # of a block's step function; what is sent to the driver per block is 16 bytes for each


def first_in_hold(times: np.ndarray, hold: int, last: int | None) -> tuple[list[int], int | None]:
    """Positions that fire among sorted times, given the last time that fired, and the new last one."""
    fired = []
    at = 0 if last is None else int(np.searchsorted(times, last + hold, "left"))
    while at < len(times):
        fired.append(at)
        last = int(times[at])
        at = int(np.searchsorted(times, last + hold, "left"))
    return fired, last


class Steps:
    """The last firing of a block of one name, by the first one: `last[i]` if that is `upper[i]` or before it."""

    def __init__(self, hold: int, most: int = STEPS):
        self.hold, self.most = hold, most
        self.upper, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.until: int | None = None
        self.fit = True

    def add(self, times: np.ndarray) -> None:
        """The next sorted times of the block."""
        if not self.fit or not len(times):
            return
        n = len(times)
        # where a chain through each time leaves this batch, by doubled jumps
        jump = np.append(np.searchsorted(times, times + self.hold, "left"), n)
        end = np.append(np.arange(n), n)
        while (jump[:n] < n).any():
            end = np.where(jump < n, end[jump], end)
            jump = jump[jump]
        at = np.searchsorted(times, self.last + self.hold, "left")
        self.last = np.where(at < n, times[end[np.minimum(at, n - 1)]], self.last)
        if self.until is None:
            self.until = int(times[0]) + self.hold
        if not len(self.upper) or self.upper[-1] < self.until:
            # whatever fired before the block, the first to fire is no later than the first time after one hold
            m = min(n, int(np.searchsorted(times, self.until, "left")) + 1)
            self.upper, self.last = np.append(self.upper, times[:m]), np.append(self.last, times[end[:m]])
        steps = np.append(self.last[1:] != self.last[:-1], True)
        self.upper, self.last = self.upper[steps], self.last[steps]
        # chains may still meet, but what a task holds must stay small
        self.fit = len(self.upper) <= 64 * self.most


def last_after(upper: np.ndarray, last: np.ndarray, hold: int, before: int) -> int:
    """The last firing after a block, given the last one before it."""
    k = int(np.searchsorted(upper, before + hold, "left"))
    return int(last[k]) if k < len(upper) else before


def _scan(
    batches: Iterator[pd.DataFrame], hold: int, starts: dict[int, int]
) -> Iterator[tuple[int, str, pd.DataFrame, list[int], int]]:
    """Yields (block, name, rows, positions that fire, last fired) per run of a name; a block's rows come sorted."""
    name, last, begun = None, None, False
    for batch in batches:
        if batch.empty:
            continue
        block = int(batch[BLOCK].iloc[0])
        values = batch["name"].to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(values)]):
            if not begun or values[lo] != name:
                # only the first name of a block may have begun in an earlier block
                last = None if begun else starts.get(block)
                name, begun = values[lo], True
            part = batch.iloc[lo:hi]
            fired, last = first_in_hold(part["at"].to_numpy(), hold, last)
            yield block, name, part, fired, last


def hold_off(df: DataFrame, name: str, ts: str, row_id: str, seconds: float, blocks: int | None = None, steps: int = STEPS) -> DataFrame:
    """The rows (name, ts, row_id) that fire when a firing row blocks its name for `seconds`.

    Of rows at one instant the lowest id counts. Rows of other columns are found by joining on row_id.
    """
    hold = int(seconds * 1000000)
    # only the first row of an instant can fire
    instants = df.groupBy(F.col(name).cast("string").alias("name"), F.unix_micros(ts).alias("at")).agg(
        F.min(row_id).alias("row_id")
    )
    ranged = ordered_blocks(instants, ["name"], ["at"], blocks)

    return _settle(ranged, hold, steps).select(
        F.col("name").alias(name), F.timestamp_micros("at").alias(ts), F.col("row_id").alias(row_id)
    )


def _settle(ranged: DataFrame, hold: int, most: int) -> DataFrame:
    """Finds the starting state of each block; the driver holds one row per block, of `most` steps at most."""

    def summaries(starts: dict[int, int], wanted: frozenset[int] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first, final, steps = None, None, Steps(hold, most)
            for block, label, rows, _, last in _scan(_only(batches, wanted), hold, starts):
                first = first or (block, label)
                # a block that ends in another name leaves the same state from any start
                if label == first[1] and wanted is None:
                    steps.add(rows["at"].to_numpy())
                final = (label, last)
            if first is not None:
                whole = wanted is None and first[1] == final[0] and steps.fit and len(steps.upper) <= most
                maps = (steps.upper.tobytes(), steps.last.tobytes()) if whole else (None, None)
                yield pd.DataFrame([(*first, *final, *maps)], columns=["block", "first", "final", "last", "upper", "lasts"])

        return run

    def fired(starts: dict[int, int]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, _, rows, at, _ in _scan(batches, hold, starts):
                yield rows.iloc[at][["name", "at", "row_id"]]

        return run

    schema = "block int, first string, final string, last bigint, upper binary, lasts binary"
    blocks = sorted(ranged.mapInPandas(summaries({}, None), schema).collect(), key=lambda row: row.block)
    scanned: dict[tuple[int, int | None], int] = {(row.block, None): row.last for row in blocks}
    while True:
        starts: dict[int, int] = {}
        unknown = set()
        name, last = None, None
        for row in blocks:
            start = last if last is not None and name == row.first else None
            if start is not None:
                starts[row.block] = start
            name = row.final
            if row.first != row.final or (row.block, start) in scanned:
                last = scanned.get((row.block, start), row.last)
            elif row.upper is not None:
                last = last_after(np.frombuffer(row.upper, np.int64), np.frombuffer(row.lasts, np.int64), hold, start)
            else:
                unknown.add(row.block)
                last = row.last
        if not unknown:
            break
        for row in ranged.mapInPandas(summaries(starts, frozenset(unknown)), schema).collect():
            scanned[row.block, starts[row.block]] = row.last
    schema = f"name string, at bigint, row_id {ranged.schema['row_id'].dataType.simpleString()}"
    return ranged.mapInPandas(fired(starts), schema)


def _only(batches: Iterator[pd.DataFrame], wanted: frozenset[int] | None) -> Iterator[pd.DataFrame]:
    """The batches of a block, none if the block is not asked for."""
    for batch in batches:
        if wanted is not None and len(batch) and int(batch[BLOCK].iloc[0]) not in wanted:
            return
        yield batch


def cooldown_alerts(alerts: DataFrame, seconds: float = 60, name: str = "name", ts: str = "ts", row_id: str = "alert_id") -> DataFrame:
    """Alerts that are sent on when each name is silent for `seconds` after one was sent."""
    return hold_off(alerts, name, ts, row_id, seconds)


def claim_actions(claims: DataFrame, seconds: float = 30, key: str = "key", ts: str = "ts", row_id: str = "claim_id") -> DataFrame:
    """Claims that get their key, which is then held for `seconds`."""
    return hold_off(claims, key, ts, row_id, seconds)
