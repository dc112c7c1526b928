"""Near-duplicate documents by circulant MinHash, bands, and exact Jaccard similarity on full shingle sets.

Sketch: a first permutation of a universe of 2^20 cells scatters a text's shingles; the second permutation,
shifted circularly by k, gives signature coordinate k. All shifts of a cell lie side by side, so the whole
signature is a minimum over short slices. Bands of the signature give candidates.

Candidates are never all pairs of a bucket. Texts with the same words are one node. In each bucket every node
is compared with the bucket's first node; that joins tight groups with one pair per member. Only nodes of one
bucket that are still in different components are then compared with one another, block by block, by a longer
signature held as bytes; pairs whose estimate is six deviations below the threshold go, and what is left is
confirmed on the full sets. So a link between different texts is lost only if no band holds both (below
10^-6 at the threshold) or the estimate is that far off.

Defined results: null or blank texts have an empty set and stay alone; a null doc_id stays alone with a null
component and is kept; a node is a text, so rows that share a doc_id are linked only if their texts are, and a
component is named by the smallest doc_id of its rows; repeated rows each give a row; other columns are ignored.
Of each component `one_of_each` keeps the row with the smallest doc_id, of several texts under it the one with the
smallest hash, of equal texts the first by the other columns; rows without words stay, one per doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import components, saved

SHINGLE = 5
CELLS = 1 << 20
BANDS, ROWS = 30, 6
BYTES = 1024  # coordinates of the longer signature
BLOCK = 256  # nodes compared in one task at most, against as many
SEED = 20
_WORDS_KEPT = 200_000

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words, kept per worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and for each cell the second one's `width` shifted values."""
    if width not in _tables:
        rng = np.random.default_rng(SEED + 1)
        scatter = rng.permutation(CELLS).astype(np.int32)
        second = rng.permutation(CELLS).astype(np.uint32)
        ring = np.concatenate([second, second[:width]])
        _tables[width] = scatter, np.lib.stride_tricks.sliding_window_view(ring, width)
    return _tables[width]


def text_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split parts at just the six blanks that part words."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows; one for a shorter text, none for an empty one."""
    if not tokens:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    windows = max(1, len(tokens) - size + 1)
    total = np.full(windows, np.uint64(min(len(tokens), size)))
    for k in range(min(size, len(tokens))):
        total += hashed[k : k + windows] * _FACTORS[k]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0x9E3779B97F4A7C15)
    total ^= total >> np.uint64(29)
    return np.unique(total)


def signature(cells: np.ndarray, width: int) -> np.ndarray:
    scatter, shifted = _permutations(width)
    at = scatter[(cells >> np.uint64(44)).astype(np.int64)]
    low = shifted[at[:1024]].min(axis=0)
    for k in range(1024, len(at), 1024):
        np.minimum(low, shifted[at[k : k + 1024]].min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> list[int]:
    """One 64-bit key per band of a signature's first coordinates."""
    bands = low[: BANDS * ROWS].reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(bands[b].tobytes(), b) - 2**63 for b in range(BANDS)]


def text_key(tokens: list[bytes]) -> bytes | None:
    """128 bits, the same for texts of the same words."""
    return xxhash.xxh3_128_digest(b" ".join(tokens)) if tokens else None


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, bands = [], [], []
        for text in batch.column("text").to_pylist():
            tokens = text_words(text)
            cells = shingles(tokens)
            sizes.append(len(cells))
            keys.append(text_key(tokens))
            bands.append(band_keys(signature(cells, BANDS * ROWS)) if tokens else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "text_hash", "n_shingles", "text_key", "bands"],
        )


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        cells = [shingles(text_words(t)) for t in batch["text"]]
        lows = [signature(c, BYTES) for c in cells]
        yield pd.DataFrame({
            "node": batch["node"],
            "n": [len(c) for c in cells],
            "cells": [c.tobytes() for c in cells],
            "sig": [x.astype(np.uint8).tobytes() for x in lows],
            "keys": [np.array(band_keys(x), np.int64).tobytes() for x in lows],
        })


def estimate_floor(percent: int, width: int = BYTES) -> float:
    """Share of equal bytes of a signature below which a pair is surely not linked (six deviations)."""
    s = percent / 100
    return s - 6 * (s * (1 - s) / width) ** 0.5


def _estimated(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) whose sizes and signatures allow a link."""
    for batch in batches:
        if len(batch):
            x = np.frombuffer(b"".join(batch["sig_a"]), np.uint8).reshape(-1, BYTES)
            y = np.frombuffer(b"".join(batch["sig_b"]), np.uint8).reshape(-1, BYTES)
            likely = (x == y).mean(axis=1) >= estimate_floor(percent)
            small = np.minimum(batch["n_a"], batch["n_b"]) * 100 >= np.maximum(batch["n_a"], batch["n_b"]) * percent
            yield batch.loc[likely & small.to_numpy(), ["a", "b"]]


def _confirmed(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for left, right in zip(batch["cells_a"], batch["cells_b"], strict=True):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.loc[np.array(keep, bool), ["a", "b"]]


def _block_pairs(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Likely pairs of different components between two blocks of a bucket, or inside one.

    A pair that shares an earlier band's bucket is left to that bucket, so it is compared and reported once.
    """
    group = group.drop_duplicates(["node", "side"])
    left, right = group[group["side"] <= 1], group[group["side"] != 1]
    a, b = left["node"].to_numpy(), right["node"].to_numpy()
    if not len(a) or not len(b):
        return pd.DataFrame({"a": a[:0], "b": b[:0]})

    def matrix(rows: pd.DataFrame, column: str, kind: type, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(rows[column]), kind).reshape(-1, width)

    x, y = matrix(left, "sig", np.uint8, BYTES), matrix(right, "sig", np.uint8, BYTES)
    p, q = matrix(left, "keys", np.int64, BANDS), matrix(right, "keys", np.int64, BANDS)
    band = int(np.flatnonzero(p[0] == group["bucket"].iloc[0])[0])
    n, m = left["n"].to_numpy(), right["n"].to_numpy()
    c, d = left["component"].to_numpy(), right["component"].to_numpy()
    inside = group["side"].iloc[0] == 0
    head = BYTES // 8
    out_a, out_b = [], []
    for k in range(len(a)):
        fit = np.flatnonzero((d != c[k]) & (np.minimum(m, n[k]) * 100 >= np.maximum(m, n[k]) * percent) & ((b > a[k]) | (not inside)))
        fit = fit[~(q[fit, :band] == p[k, :band]).any(axis=1)]
        fit = fit[(y[fit, :head] == x[k, :head]).mean(axis=1) >= estimate_floor(percent, head)] if len(fit) else fit
        near = fit[(y[fit] == x[k]).mean(axis=1) >= estimate_floor(percent)] if len(fit) else fit
        out_a.append(np.full(len(near), a[k]))
        out_b.append(b[near])
    first, second = np.concatenate(out_a), np.concatenate(out_b)
    return pd.DataFrame({"a": np.minimum(first, second), "b": np.maximum(first, second)})


def _pairs_with(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = sets.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.join(left, "a").join(right, "b")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    both = _pairs_with(pairs, sets, "cells")
    return both.mapInPandas(lambda it: _confirmed(it, percent), "a bigint, b bigint").distinct()


def _cross_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Likely pairs between components inside the buckets of `rows` (bucket, node, component), in even blocks."""
    many = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    many = many.where("lo <> hi").select("bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(many, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets each other block once: task (i, j) with i <= j, side 0 if it meets itself
    meet = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select(
        "bucket", "node", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    meet = meet.join(sets.select("node", "n", "sig", "keys"), "node")
    return meet.groupBy("bucket", "i", "j").applyInPandas(lambda g: _block_pairs(g, percent), "a bigint, b bigint").distinct()


def text_hash() -> Column:
    """Tells texts apart, null and empty ones too."""
    return F.md5(F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("n")))


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """Per row of `docs`: doc_id, text_hash, n_shingles, node and component (a node; null for rows that link with nothing)
    and low, the smallest doc_id of the component."""
    pairs_schema = "a bigint, b bigint"
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = source.select("doc_id", "text", text_hash().alias("text_hash"))
    sketches = saved(
        sketched.mapInArrow(_sketches, "doc_id bigint, text_hash string, n_shingles bigint, text_key binary, bands array<bigint>"), "sketches"
    )
    # every doc_id here is known; texts with the same words are one node, whose number is that of its row in the saved table
    known = sketches.where("doc_id IS NOT NULL AND text_key IS NOT NULL")
    # each is read again from one row that holds it: the one with the smallest doc_id, and of its texts the smallest hash
    texts = known.groupBy("text_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("held"), F.first("bands").alias("bands"))
    nodes = saved(texts.select("text_key", F.col("held.doc_id").alias("low"), F.col("held.text_hash").alias("held_hash"), "bands").withColumn(
        "node", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("node", "low", F.explode("bands").alias("bucket"))
    # a bucket's first node is its oldest: that is more often what the others were copied from than any other node
    first = rows.groupBy("bucket").agg(F.min(F.struct("low", "node"))["node"].alias("first"), F.min("node").alias("a"), F.max("node").alias("b"))
    first = first.where("a <> b")
    shared = saved(rows.drop("low").join(first.select("bucket", "first"), "bucket"), "buckets")

    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "low", "held_hash")
    read = sketched.join(wanted, (F.col("doc_id") == F.col("low")) & (F.col("text_hash") == F.col("held_hash")))
    # repeated rows; the rows are where the join has put them
    read = read.groupBy("doc_id", "text_hash").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    sets = saved(read.select("node", "text").mapInPandas(_sets, "node bigint, n bigint, cells binary, sig binary, keys binary"), "sets")
    stars = shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    likely = _pairs_with(stars, sets, "n", "sig").mapInPandas(lambda it: _estimated(it, percent), pairs_schema)
    links = saved(confirm(likely, sets, percent), "links")
    tight = components(links)

    labelled = shared.select("bucket", "node").distinct().join(tight, "node", "left")
    labelled = labelled.select("bucket", "node", F.coalesce("component", "node").alias("component"))
    cross = saved(confirm(_cross_pairs(labelled, sets, percent), sets, percent), "links")
    # what the first links joined is one node for the second ones
    bridges = cross.join(tight.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left")
    bridges = bridges.join(tight.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
    joined = components(bridges.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))

    final = nodes.select("text_key", "node", "low").join(tight, "node", "left").withColumn("near", F.coalesce("component", "node")).drop("component")
    final = final.join(joined.select(F.col("node").alias("near"), "component"), "near", "left")
    final = saved(final.select("text_key", "low", F.coalesce("component", "near").alias("component")), "texts")
    lowest = final.groupBy("component").agg(F.min("low").alias("low"))
    named = final.select("text_key", "component").join(lowest, "component")
    # rows without a key stay out of the join, where they would all meet in one task
    linked = known.select("doc_id", "text_hash", "n_shingles", "text_key").join(named, "text_key", "left").drop("text_key")
    alone = sketches.where("doc_id IS NULL OR text_key IS NULL").select("doc_id", "text_hash", "n_shingles")
    return linked.unionByName(alone, allowMissingColumns=True)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    component = F.coalesce("low", "doc_id")
    return _grouped(docs, percent).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of `docs` that stay, one per group of near copies; rows with a null doc_id stay."""
    rows = _grouped(docs.where("doc_id IS NOT NULL"), percent)
    best = F.min(F.struct("doc_id", "text_hash"))
    chosen = rows.where("component IS NOT NULL").groupBy("component").agg(best.alias("best")).select("best.*")
    chosen = saved(chosen.union(rows.where("component IS NULL").select("doc_id", "text_hash").distinct()), "chosen")
    mine = chosen.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
    hashed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_d"), text_hash().alias("_h"))
    kept = hashed.join(mine, (F.col("_d") == F.col("_doc_id")) & (F.col("_h") == F.col("_text_hash")), "left_semi")
    # repeated rows: the limit on the rank is applied before the shuffle
    order = Window.partitionBy("_d", "_h").orderBy(F.to_json("_row"))
    kept = kept.withColumn("_no", F.row_number().over(order)).where("_no = 1")
    columns = [F.col(f"_row.`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(docs.where("doc_id IS NULL"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(c.low, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
