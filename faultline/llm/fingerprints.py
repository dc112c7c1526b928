"""Fingerprints from improbable features.

A feature is a window of 64 bytes. Its entropy falls into one of 1001 bins, and the rarer a bin is in the whole corpus the
better its rank. Each frame of 64 neighbouring windows votes for its best ranked one, the leftmost of equals; windows with 16
votes or more are a text's features. They go in order of place into Bloom filters of 2048 bits, 160 features to a filter,
and a full filter is followed by a next one. Likeness compares every filter of the shorter chain with all of the longer
and takes the best overlap, counted from what chance gives (0) to all bits of the smaller filter (1); filters weigh by their
bits, and chains of one length are compared both ways.

Ranks are counted over all documents; given ranks can be used instead, so later tables stay comparable. Windows of less than
a tenth of the possible entropy are no features. A text with no feature has one, its whole self.

To edit a text with the start of the next one, documents are cut into buckets by quantiles of doc_id; in each, rows are
sorted, and a copy of the following bucket's first row ends it. So texts are shuffled once, and a task holds one batch and one
row. A doc_id that covers several quantiles is cut further by the hash of its texts.

Defined results: null text is empty; empty texts have an empty chain, which is like another empty one (1) and unlike all others
(0); the order is doc_id, null first, then hash of the text, then text; after the last row comes the first, so a lone row is
its own next; repeated rows give a row each, equal ones follow each other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 64  # bytes of a feature
FRAME = 64  # windows that vote together
VOTES = 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
BINS = 1000
WEAK = 100  # bins below are no features
SLAB = 1 << 17  # bytes worked on at once
NO_RANK = 1023
_POINT = 1 << 20

_gain = [round(_POINT * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
_GAINS = np.array([b - a for a, b in zip(_gain, _gain[1:], strict=False)], np.int32)
_FULL = round(_POINT * WINDOW * math.log2(WINDOW))


# --- features -----------------------------------------------------------------------------------------
def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The entropy bin (0 to 1000) of the window that starts at each byte, as far as it fits."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    # a byte that comes in adds a gain by how often the window has it, one that leaves takes the same away
    step = _GAINS[before]
    step[WINDOW:] -= _GAINS[after[:-WINDOW]]
    total = np.cumsum(step, dtype=np.int64)[WINDOW - 1 :]
    return (_FULL - total) * BINS // _FULL


class _Buffer:
    """Texts one after another, in slabs that overlap by what windows and frames need."""

    def __init__(self, texts: Sequence[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)

    def bins(self, first: int, last: int) -> np.ndarray:
        """Bins of the windows that start at bytes first to last - 1; -1 where a window leaves its text."""
        found = entropy_bins(self.data[first : last + WINDOW - 1])
        found = np.concatenate([found, np.full(last - first - len(found), -1)])
        a, b = np.searchsorted(self.ends, [first, last - 1], "right")
        ends = self.ends[a : b + 1]
        spans = np.diff(np.concatenate([[first], np.minimum(ends, last)]))
        found[np.repeat(ends, spans) - np.arange(first, last) < WINDOW] = -1
        return found

    def slabs(self) -> Iterator[tuple[int, int]]:
        return ((at, min(at + SLAB, len(self.data))) for at in range(0, len(self.data), SLAB))

    def features(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of all features in order."""
        texts, hashes = [], []
        wide = np.concatenate([ranks, [NO_RANK]]).astype(np.uint32)
        for start, end in self.slabs():
            first, last = max(0, start - FRAME + 1), min(end + FRAME - 1, len(self.data))
            rank = wide[self.bins(first, last)]
            # windows that are none stand before the first byte and after the last
            left, right = FRAME - 1 - (start - first), FRAME - 1 - (last - end)
            rank = np.concatenate([np.full(left, NO_RANK, np.uint32), rank, np.full(right, NO_RANK, np.uint32)])
            best = rank << 20 | np.arange(len(rank), dtype=np.uint32)
            reach = 1
            while reach < FRAME:
                best = np.minimum(best[:-reach], best[reach:])
                reach *= 2
            best = best[best >> 20 < NO_RANK] & ((1 << 20) - 1)
            votes = np.bincount(best, minlength=len(rank))[FRAME - 1 : FRAME - 1 + end - start]
            chosen = start + np.flatnonzero(votes >= VOTES)
            texts.append(np.searchsorted(self.ends, chosen, "right"))
            hashes.append(_window_hashes(self.data, chosen))
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(texts), np.concatenate(hashes)


def _window_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    whole = data[places[:, None] + np.arange(WINDOW)].view("<u8").astype(np.uint64)
    mixed = np.zeros(len(places), np.uint64)
    for k in range(whole.shape[1]):
        mixed = (mixed ^ whole[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


# --- chains of Bloom filters ----------------------------------------------------------------------------
def chains(texts: Sequence[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Per text its filters, one row of 64-bit words each."""
    text, hashed = _Buffer(texts).features(ranks)
    bare = np.ones(len(texts), bool)
    bare[text] = False
    alone = [k for k in np.flatnonzero(bare).tolist() if texts[k]]
    text = np.concatenate([text, np.array(alone, np.int64)])
    hashed = np.concatenate([hashed, np.array([xxhash.xxh3_64_intdigest(texts[k]) for k in alone], np.uint64)])
    # a feature that a text repeats counts once, at its first place
    order = np.lexsort((hashed, text))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (hashed[order[1:]] == hashed[order[:-1]])
    place = np.argsort(text[~again], kind="stable")
    text, hashed = text[~again][place], hashed[~again][place]
    each = np.bincount(text, minlength=len(texts))
    ordinal = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    filters = -(-each // PER_FILTER)
    base = np.cumsum(filters) - filters
    row = base[text] + ordinal // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(HASHES):
        bits[row, (hashed >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1).view("<u8")
    return [packed[b : b + f] for b, f in zip(base.tolist(), filters.tolist(), strict=True)]


def write(chain: np.ndarray) -> str:
    """A chain as text: number of filters, then their bits."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.split(":", 1)[1]), "<u8").reshape(-1, BITS // 64)


def _best(a: np.ndarray, b: np.ndarray) -> float:
    """The filters of `a` against their best partners in `b`, weighed by bits."""
    size_a, size_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    scores = []
    for k, size in enumerate(size_a.tolist()):
        both = np.bitwise_count(a[k] & b).sum(axis=1, dtype=np.int64)
        chance = size * size_b / BITS
        scores.append(max(0.0, float(np.max((both - chance) / (np.minimum(size, size_b) - chance)))))
    return scores[0] if len(scores) == 1 else min(1.0, float(np.average(scores, weights=size_a)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b):
        return (_best(a, b) + _best(b, a)) / 2 if len(a) > 1 else _best(a, b)
    return _best(a, b) if len(a) < len(b) else _best(b, a)


# --- the corpus ---------------------------------------------------------------------------------------
def rarity_ranks(docs: DataFrame) -> list[int]:
    """Rank of every entropy bin, 0 for the rarest among all windows of all texts; the weak bins have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BINS + 2, np.int64)
        for batch in batches:
            buffer = _Buffer([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist() if t])
            for start, end in buffer.slabs():
                seen += np.bincount(buffer.bins(start, end) + 1, minlength=BINS + 2)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS + 1), pa.int32()), pa.array(seen[1:])], ["bin", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bin int, n bigint")
    totals = dict.fromkeys(range(BINS + 1), 0) | {r.bin: r.n for r in counted.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    ranks = [NO_RANK] * (BINS + 1)
    for rank, (_, found) in enumerate(sorted((n, b) for b, n in totals.items() if b >= WEAK)):
        ranks[found] = rank
    return ranks


def _cuts_below(cuts: Sequence[int], value: Column, also_equal: bool = False) -> Column:
    """How many of the sorted cuts are below `value`, found by halving."""
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    padded = F.array(*[F.lit(c).cast("bigint") for c in [*cuts, *[2**63 - 1] * (2 * steps[0] - len(cuts))]]) if cuts else None
    if padded is None:
        return F.lit(0)
    at = lambda low, step: F.get(padded, low + step - 1)
    fits = (lambda low, step: (low + step <= len(cuts)) & (at(low, step) <= value)) if also_equal else (lambda low, step: at(low, step) < value)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, step: F.when(fits(low, step), low + step).otherwise(low))


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, ahead, doc_id, text), sorted inside partitions that hold whole buckets; `ahead` rows are copies of what comes
    after the bucket's last row. Buckets cover doc_id in order."""
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shares = [k / buckets for k in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx(key, shares or [0.5], 20 * buckets)).first()[0] or []
    cuts = cuts if shares else []
    # a doc_id that is several cuts has as many buckets, by hash of the text
    heavy = len(set(cuts)) < len(cuts)
    hashed = F.xxhash64("text")
    bucket = _cuts_below(cuts, key)
    if heavy:
        parts = _cuts_below(cuts, key, also_equal=True) - bucket
        bucket = bucket + F.when(parts > 1, F.least(F.floor((hashed / 2.0**64 + 0.5) * parts).cast("int"), parts - 1)).otherwise(0)
    rows = rows.withColumn("bucket", bucket)
    first = F.struct(key.alias("key"), *([hashed.alias("hash")] if heavy else []))
    found = {r.bucket: r.first for r in rows.groupBy("bucket").agg(F.min(first).alias("first")).collect()}
    filled = sorted(found)
    previous = {b: filled[k - 1] for k, b in enumerate(filled)}
    # one entry per bucket
    width = filled[-1] + 1 if filled else 1
    entry = lambda get, kind: F.get(F.array(*[F.lit(get(b) if b in found else None).cast(kind) for b in range(width)]), F.col("bucket"))
    leads = key == entry(lambda b: found[b].key, "bigint")
    if heavy:
        leads = leads & (hashed == entry(lambda b: found[b].hash, "bigint"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("ahead"))
    before = F.struct(entry(lambda b: previous[b], "int").alias("bucket"), F.lit(True).alias("ahead"))
    placed = rows.withColumn("place", F.explode(F.when(leads, F.array(own, before)).otherwise(F.array(own))))
    placed = placed.select("place.bucket", "place.ahead", "doc_id", "text").repartition("bucket")
    return placed.sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")


def edit(text: str, following: str) -> str:
    """`text` with its second half replaced by as much of the start of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, ranks: Sequence[int] | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rank = np.array(rarity_ranks(docs) if ranks is None else ranks)

    def encode(text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            new = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text")), strict=True))
            made = chains([encode(r[3]) for r in new], rank)
            rows = held + [(*r, c) for r, c in zip(new, made, strict=True)]
            held = rows[-1:]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
            edited = [encode(edit(a[3], b[3])) for a, b in pairs]
            changed = chains(edited, rank)
            columns = {
                "doc_id": pa.array([a[2] for a, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array([write(a[4]) for a, _ in pairs], pa.string()),
                "edited_fingerprint": pa.array([write(c) for c in changed], pa.string()),
                "near_edited": pa.array([likeness(a[4], c) for (a, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        if held and not held[0][1]:
            raise ValueError("a bucket ends without the row that follows it")

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(compare, schema)
