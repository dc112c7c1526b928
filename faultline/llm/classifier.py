"""A text quality classifier: naive Bayes weights times a linear hinge-loss model (NB-SVM).

Features are indicators of n-grams of 1 to 3 word shapes (capitals, small letters and digits as runs, other signs
as they are, a word equal to the one before it as a repeat), for each of these a second indicator if it covers a
twentieth of the text, and the 3-grams of characters of all words, with a mark at both ends. Each indicator is scaled by
its class log-count ratio, each text to length one, and a linear model is fitted by dual coordinate descent, each class
with equal total weight. The weights are then drawn halfway to their mean size, so that an indicator the fit has
never seen still counts by its ratio: text of letters that no labelled text has is no good text.

The fit takes at most SAMPLE labelled rows, those with the smallest hash of their id among the rows that are not
held out; that bounds the rows that the driver holds, each of at most 2^18 indicators. The model is 2^18 numbers.
Everything is scored by one narrow pass.

Defined results: empty and null texts have no feature and get the score of the bias alone; labels that are null or
have no document are left out; a doc_id labelled twice, or with several texts, counts with each; without both classes every score is 0.5;
a null doc_id is scored and not held out; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 18
SAMPLE = 20_000
EPOCHS = 60  # rounds at most
SLACK = 0.02  # the fit ends with the round in which no slope is above this
COST = 1.0
SHARE = 20  # an n-gram is frequent from a twentieth of the words on
TRUST = 0.5  # share of a weight that comes from the fit, the rest being the mean size of all weights
_SHAPES_KEPT = 200_000
_FACTORS = np.random.default_rng(7).integers(0, 2**64, 3, dtype=np.uint64) | np.uint64(1)
_REPEAT = np.uint64(xxhash.xxh3_64_intdigest(b"same as before"))


class _Shapes(dict):
    """The hashed shape of a word, kept per worker up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _SHAPES_KEPT:
            self.clear()
        shape = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
        value = self[word] = xxhash.xxh3_64_intdigest(re.sub(r"(.)\1+", r"\1+", shape))
        return value


_shapes = _Shapes()


def spelling(words: list[str]) -> np.ndarray:
    """The numbers of all 3-grams of characters of words, a blank being the mark at both ends of a word."""
    signs = np.frombuffer(f" {' '.join(words).lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one, two, three = (signs[k : len(signs) - 2 + k].astype(np.uint64) for k in range(3))
    grams = (one * _FACTORS[0] + two * _FACTORS[1] + three * _FACTORS[2])[two != ord(" ")]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    held = np.zeros(DIMENSIONS, bool)
    held[grams >> np.uint64(46)] = True
    return np.flatnonzero(held)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct numbers of the indicators that hold for a text."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint32)
    shapes = np.fromiter(map(_shapes.__getitem__, words), np.uint64, len(words))
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, len(words) - 1)
    shapes[1:][same] = _REPEAT
    out = []
    for n in range(1, min(3, len(words)) + 1):
        grams = np.full(len(words) - n + 1, np.uint64(n))
        for k in range(n):
            grams += shapes[k : k + len(grams)] * _FACTORS[k]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0x9E3779B97F4A7C15)
        found, counts = np.unique(grams, return_counts=True)
        often = found[counts * SHARE >= len(words)]
        out += [found >> np.uint64(46), (often * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)]
    out.append(spelling(words).astype(np.uint64))
    return np.unique(np.concatenate(out)).astype(np.uint32)


def fit(rows: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight per indicator, log-count ratio included, and the bias."""
    if not good.any() or good.all():
        return np.zeros(DIMENSIONS), 0.0
    counts = np.ones((2, DIMENSIONS))
    for row, g in zip(rows, good, strict=True):
        counts[int(g), row] += 1
    # an indicator that no text has is no part of the vocabulary
    known = counts[:, counts.sum(axis=0) > 2].sum(axis=1)
    ratio = np.log((counts[1] / known[1]) / (counts[0] / known[0]))
    sign = np.where(good, 1.0, -1.0)
    limit = COST * np.where(good, len(good) / (2 * good.sum()), len(good) / (2 * (~good).sum()))
    scaled = [ratio[row] for row in rows]
    scaled = [x / (np.linalg.norm(x) or 1.0) for x in scaled]
    weights, bias, dual = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    curve = np.array([x @ x + 1 for x in scaled])
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        worst = 0.0
        for k in order.permutation(len(rows)):
            row, x = rows[k], scaled[k]
            slope = sign[k] * (weights[row] @ x + bias) - 1
            new = min(max(dual[k] - slope / curve[k], 0.0), limit[k])
            if new != dual[k]:
                worst = max(worst, abs(new - dual[k]) * curve[k])
                step = (new - dual[k]) * sign[k]
                weights[row] += step * x
                bias += step
                dual[k] = new
        if worst <= SLACK:
            break
    return np.stack([weights, ratio]), bias


def drawn_to_mean(model: np.ndarray, trust: float = TRUST) -> np.ndarray:
    """The weights, each drawn to the mean size of those that the fit has moved."""
    moved = np.abs(model[0][model[0] != 0])
    mean = float(moved.mean()) if len(moved) else 0.0
    return np.stack([(1 - trust) * mean + trust * model[0], model[1]])


def score(row: np.ndarray, model: np.ndarray, bias: float) -> float:
    weights, ratio = model
    x = ratio[row]
    margin = float(weights[row] @ x) / (float(np.linalg.norm(x)) or 1.0) + bias
    return 1.0 / (1.0 + np.exp(-2.0 * min(max(margin, -30.0), 30.0)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model from `labels` (doc_id, quality) that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "row"])

    # the labels are bounded by `sample` short rows, and so are the texts, of which an id may have several
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    found = texts.select("doc_id", "quality", "text").mapInArrow(coded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, row binary")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "row").limit(sample)
    taken = sorted((r.doc_id, r.quality, bytes(r.row)) for r in found.collect())
    model, bias = fit([np.frombuffer(r[2], np.uint32) for r in taken], np.array([r[1] == 1 for r in taken], bool))
    return (drawn_to_mean(model) if model.ndim == 2 else np.stack([model, model])).astype(np.float32), bias


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, score, predicted."""
    model, bias = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(features(t), shared.value, bias) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
