"""Documents packed into training sequences of several context sizes.

A document's ids are cut into full windows and one rest. Rests are routed to the smallest context size that holds
them. From the longest size to the shortest, each rest is completed with shorter ones; a sequence of a shorter
size is made only where it comes out exactly full, as a full one needs no padding, and what is left over is packed
into the longest windows. All of this is planned on the counts per length, at most one per token of the window,
and the plan gives, for every length, which ranks go to which run of sequences. Ranks come from counts per length
and slice, so a length that a third of the pieces share is spread like any other. Sequences of one size are
numbered together and cut into step groups of equal tokens.

Defined results: null text is empty and gives one piece, the closing id; repeated rows are packed each; null ids
pass through; equal pieces are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import saved
from faultline.llm.tokens import VOCABULARY, vocabulary

WINDOWS = (2048, 1024, 512, 256)
CLOSING_ID = 1
STEP_TOKENS = 131_072
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def document_pieces(docs: DataFrame, window: int = WINDOWS[0], name: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) for the full windows and the rest of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, step = vocabulary(name), 4 * window
        for batch in batches:
            rows, columns = [], ([], [], [], [])
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = coder.ids(text or "") + CLOSING_ID.to_bytes(4, "little")
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    rows.append(k)
                    for column, value in zip(columns, (at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                        column.append(value)
            ids_column = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids_column, *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, {PIECE}")


class Plan:
    """Sequences planned from the number of pieces of each length: (window, {length: pieces each}, how many)."""

    def __init__(self, counts: dict[int, int], windows: Sequence[int] = WINDOWS):
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.made: list[tuple[int, dict[int, int], int]] = []
        longest = windows[0]
        for window in windows:
            if self.left.get(window):
                self._make(window, {window: 1})
        for window in windows:
            for length in sorted((x for x in self.left if window // 2 < x < window), reverse=True):
                while self.left.get(length):
                    filled = {length: 1}
                    gap = self._fill(filled, window - length, window // 2)
                    if gap and window != longest:
                        break
                    self._make(window, filled)
        while self.left:
            length = max(self.left)
            filled = {length: 1}
            self._fill(filled, longest - length, longest)
            self._make(longest, filled)

    def _fill(self, filled: dict[int, int], gap: int, most: int) -> int:
        """Add lengths up to `most` to `filled`, one that fits exactly before the longest; what stays open."""
        def free(length: int) -> int:
            return self.left.get(length, 0) - filled.get(length, 0)

        while gap > 0:
            if gap <= most and free(gap) > 0:
                choice = gap
            else:
                fits = [x for x in self.left if x <= min(gap, most) and free(x) > 0]
                if not fits:
                    return gap
                # a pair that fits exactly, if there is one, else the longest
                paired = [x for x in fits if gap - x <= most and gap > x and free(gap - x) > (gap - x == x)]
                choice = max(paired or fits)
            times = min(free(choice), gap // choice) if choice < gap // 2 else 1
            filled[choice] = filled.get(choice, 0) + times
            gap -= choice * times
        return gap

    def _make(self, window: int, filled: dict[int, int]) -> None:
        times = min(self.left[length] // each for length, each in filled.items())
        for length, each in filled.items():
            self.left[length] -= each * times
            if not self.left[length]:
                del self.left[length]
        self.made.append((window, filled, times))

    def slots(self, step_tokens: int = STEP_TOKENS) -> list[tuple[int, ...]]:
        """Per length and run of sequences: the ranks it takes and where they go."""
        ranks: dict[int, int] = {}
        out, sequence, group, tier = [], 0, 0, None
        for window, filled, times in sorted(self.made, key=lambda m: -m[0]):
            if window != tier:
                group = group + -(-(sequence - first) // per_group) if tier else 0
                tier, first, per_group = window, sequence, max(1, step_tokens // window)
            offset = 0
            for length, each in sorted(filled.items(), reverse=True):
                rank = ranks.get(length, 0)
                ranks[length] = rank + each * times
                out.append((length, rank, rank + each * times, each, sequence, offset, window, first, per_group, group))
                offset += length * each
            sequence += times
        return out


SLOTS = ("slot_length int, low bigint, high bigint, each int, sequence bigint, at int, window int, first bigint, per_group int, groups bigint")


def pack_documents(docs: DataFrame, windows: Sequence[int] = WINDOWS, step_tokens: int = STEP_TOKENS, name: str = VOCABULARY) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group."""
    return pack_pieces(saved(document_pieces(docs, windows[0], name), "pieces"), windows, step_tokens)


def pack_pieces(pieces: DataFrame, windows: Sequence[int] = WINDOWS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    spark = pieces.sparkSession
    slices = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slices)))
    counts = saved(sliced.groupBy("length", "slice").agg(F.count("*").alias("n")), "lengths")
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(Plan(histogram, windows).slots(step_tokens), SLOTS)

    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = sliced.withColumn("own", F.row_number().over(own)).join(offsets, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") - 1).drop("slice", "own", "before")
    # the plan has a few rows per length, and there are no more lengths than tokens in a window
    placed = ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    turn = F.col("rank") - F.col("low")
    sequence = F.col("sequence") + F.floor(turn / F.col("each"))
    return placed.select(
        *[c for c in pieces.columns],
        sequence.cast("bigint").alias("sequence_id"),
        (F.col("at") + (turn % F.col("each")) * F.col("length")).cast("bigint").alias("offset"),
        F.col("window").cast("bigint").alias("window"),
        (F.col("groups") + F.floor((sequence - F.col("first")) / F.col("per_group"))).cast("bigint").alias("step_group"),
    )
