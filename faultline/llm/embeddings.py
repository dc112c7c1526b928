"""Near-duplicate embeddings through an inverted multi-index.

Each half of a unit vector has a codebook of its own; the pair of nearest code words is the vector's cell in the
product grid. A query walks both sorted lists of code words at once and visits cells in the order of a lower bound
for their distance, up to a reach. The reach is set so that a vector at just the threshold, in a random direction
from a sampled one, lies in a visited cell with the target probability; closer vectors are found more surely. All
pairs of a visited cell are compared in double precision.

Codebooks and reach come from at most SAMPLE vectors, those with the smallest hash; every vector is indexed and
every vector is a query. Equal vectors of a label are one class, searched once. A pair is looked for from its
smaller id, and counts for both. Cells are cut into blocks; a task compares a block of members with a block of
queries and reports counts and one row per vector with the smallest id it hangs together with, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers, rows with a null label and
rows with a null id have no links, and are kept; vectors of different lengths are not compared; rows that share an
id are one node; repeated rows are copies of each other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.sampling import smallest_hashes
from faultline.llm.common import beside, components, saved

THRESHOLD = 0.98
TARGET_RECALL = 0.9999
SAMPLE = 8192
PER_CELL = 512
MOST_WORDS = 1024  # of a codebook
BLOCK = 512
ROUNDS = 10
NEAREST = 8  # code words whose border with a cell is looked at

FOUND = "node bigint, n bigint, root bigint"


def _squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1)


def code_words(half: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """A codebook by k-means; a word without vectors moves to a random one."""
    words = half[rng.permutation(len(half))[:count]]
    for _ in range(ROUNDS):
        nearest = _squared(half, words).argmin(axis=1)
        sums, sizes = np.zeros_like(words), np.bincount(nearest, minlength=len(words))
        np.add.at(sums, nearest, half)
        words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], half[rng.integers(len(half), size=len(words))])
    return words


class Grid:
    """Two codebooks and the reach of a search."""

    def __init__(self, sample: np.ndarray, count: int, threshold: float, target: float):
        rng = np.random.default_rng(5)
        self.width = sample.shape[1]
        self.cut = self.width // 2
        self.words = [code_words(h, min(count, len(sample)), rng) for h in (sample[:, : self.cut], sample[:, self.cut :])]
        away = rng.normal(size=sample.shape)
        away -= (away * sample).sum(axis=1)[:, None] * sample
        away /= np.maximum(np.linalg.norm(away, axis=1), 1e-300)[:, None]
        near = threshold * sample + np.sqrt(1 - threshold**2) * away
        bounds = self.bounds(sample)
        ends = self.nearest(near)
        rows = np.arange(len(sample))
        self.reach = float(np.quantile(bounds[0][rows, ends[0]] + bounds[1][rows, ends[1]], target)) + 1e-12

    def _halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit[:, : self.cut], unit[:, self.cut :]

    def nearest(self, unit: np.ndarray) -> list[np.ndarray]:
        return [_squared(x, w).argmin(axis=1) for x, w in zip(self._halves(unit), self.words, strict=True)]

    def bounds(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per half, squared lower bounds of the distance to each word's cell: that to the farthest border
        between the cell and those of the words nearest to the vector."""
        out = []
        for x, words in zip(self._halves(unit), self.words, strict=True):
            far = _squared(x, words)
            best = np.argsort(far, axis=1)[:, :NEAREST]
            apart = np.sqrt(np.maximum(_squared(words, words), 0)) + 1e-12
            bound = np.zeros_like(far)
            for k in range(best.shape[1]):
                near = best[:, k]
                border = (far - far[np.arange(len(x)), near][:, None]) / (2 * apart[near])
                np.maximum(bound, np.where(np.arange(len(words)) == near[:, None], 0, border), out=bound)
            out.append(bound * bound)
        return out

    def visited(self, unit: np.ndarray) -> list[np.ndarray]:
        """The cells within reach of each vector, nearest first."""
        first, second = self.bounds(unit)
        out = []
        for a, b in zip(first, second, strict=True):
            i, j = np.argsort(a), np.argsort(b)
            i, j = i[a[i] <= self.reach], j[b[j] <= self.reach]
            total = a[i][:, None] + b[j]
            cells = i[:, None] * len(self.words[1]) + j
            inside = total <= self.reach
            out.append(cells[inside][np.argsort(total[inside], kind="stable")])
        return out

    def cells(self, unit: np.ndarray) -> np.ndarray:
        first, second = self.nearest(unit)
        return first * len(self.words[1]) + second


def units(vectors: list, width: int) -> np.ndarray:
    """Vectors scaled to length one, padded with zeros; numbers of extreme size are scaled first."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    out /= np.abs(out).max(axis=1)[:, None]
    return out / np.linalg.norm(out, axis=1)[:, None]


def _block(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    members, queries = group[group["role"] == 0], group[group["role"] == 1]
    if members.empty or queries.empty:
        return pd.DataFrame({"node": [], "n": [], "root": []}, dtype="int64")

    def matrix(rows: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), -1)

    a, b = queries["node"].to_numpy(), members["node"].to_numpy()
    linked = (matrix(queries) @ matrix(members).T >= threshold) & (a[:, None] < b)
    top_a, top_b = a.copy(), b.copy()
    none = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(top_b, np.where(linked, top_a[:, None], none).min(axis=0))
        new_a = np.minimum(top_a, np.where(linked, new_b, none).min(axis=1))
        if (new_a == top_a).all() and (new_b == top_b).all():
            break
        top_a, top_b = new_a, new_b
    counts = np.concatenate([linked @ members["copies"].to_numpy(), queries["copies"].to_numpy() @ linked])
    out = pd.DataFrame({"node": np.concatenate([a, b]), "n": counts, "root": np.concatenate([top_a, top_b])})
    return out[out["n"] > 0]


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # not-a-number and infinity are no plain numbers, and so is null
    sound = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    sound = sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = saved(rows.where(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "classes")
    size = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not size[0]:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(2, size[1])
    sample = smallest_hashes(classes, "node", SAMPLE, size[0]).collect()
    count = min(MOST_WORDS, max(4, round((size[0] / PER_CELL) ** 0.5)))
    grid = Grid(units([r.embedding for r in sample], width), count, threshold, target)
    shared = rows.sparkSession.sparkContext.broadcast(grid)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column("embedding").to_pylist()
                unit = units(lists, width)
                packed = [u.tobytes() for u in unit]
                reached = shared.value.visited(unit)
                index = np.concatenate([np.arange(len(unit)), np.repeat(np.arange(len(unit)), [len(c) for c in reached])])
                cells = np.concatenate([shared.value.cells(unit), *reached])
                role = np.repeat([0, 1], [len(unit), len(index) - len(unit)])
                take = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("group").take(take), pa.array(cells, pa.int64()), pa.array(role, pa.int32()), batch.column("node").take(take),
                     batch.column("copies").take(take), pa.array(packed, pa.binary()).take(take)],
                    ["group", "cell", "role", "node", "copies", "unit"],
                )

    # a label and a length make a group: nothing is compared across groups
    keyed = classes.select(F.concat_ws(":", F.col("label").cast("string"), F.size("embedding")).alias("group"), "node", "copies", "embedding")
    placed = saved(keyed.mapInArrow(place, "group string, cell bigint, role int, node bigint, copies bigint, unit binary"), "cells")
    cells = placed.groupBy("group", "cell").agg(
        F.ceil(F.sum(1 - F.col("role")) / BLOCK).cast("int").alias("members"), F.ceil(F.sum("role") / BLOCK).cast("int").alias("queries")
    ).where("members > 0 AND queries > 0")
    # the few cells go to the vectors: a full cell is dealt out in blocks before its vectors travel
    cells = beside(saved(cells, "cell-sizes"))
    mine = F.when(F.col("role") == 0, F.col("members")).otherwise(F.col("queries"))
    other = F.when(F.col("role") == 0, F.col("queries")).otherwise(F.col("members"))
    dealt = placed.join(cells, ["group", "cell"]).withColumn("own", F.pmod(F.xxhash64("node"), mine)).withColumn("with", F.explode(F.sequence(F.lit(0), other - 1)))
    dealt = dealt.withColumn("i", F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("with")))
    dealt = dealt.withColumn("j", F.when(F.col("role") == 0, F.col("with")).otherwise(F.col("own")))
    dealt = dealt.select("group", "cell", "i", "j", "role", "node", "copies", "unit")
    found = saved(dealt.groupBy("group", "cell", "i", "j").applyInPandas(lambda g: _block(g, threshold), FOUND), "found")

    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    final = classes.join(counts, "node", "left").join(joined, "node", "left").select(
        "label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    return rows.withColumn("sound", sound).join(final.withColumn("sound", F.lit(True)), ["label", "embedding", "sound"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= {THRESHOLD}),
r(vec_id, other) AS (SELECT a, b FROM p UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.other),
c AS (SELECT vec_id, min(other) AS low FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(c.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
