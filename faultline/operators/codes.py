"""Exact nearest incidents by filter and refine over 8-bit codes.

A unit vector v is stored as whole numbers c in -127..127, a scale s and the length e of what s*c leaves out. For a unit
query u, u.v lies within e of s * u.c, so codes alone give a lower and an upper bound of every similarity. A corpus vector
is a candidate if its upper bound reaches the k-th largest lower bound found for the query; only candidates are
compared in full. That needs no structure in the vectors: codes are an eighth of doubles, and the bounds of a few
candidates overlap whatever their number.

The k-th lower bound is found in three steps, each over more of the corpus: a first look at a sample of FIRST_LOOK codes
while the queries are read, then the block of codes at hand, then all blocks. Queries and codes are cut into blocks of
BLOCK_BYTES, and a task multiplies one with another, so pairs never become rows and no key holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.sampling import smallest_hashes
from faultline.operators.similarity import DIGITS, _lowest_ids, _matrix, _no_rows, _per_query, _unit, _with_vector, cosine_distance
from faultline.session import stable

BLOCK_BYTES = 32 * 1024 * 1024  # of codes or queries in one block
LEAST_ROWS = 1024  # vectors in a block, however many tasks there are
FIRST_LOOK = 1024  # codes that give the first threshold
STRIP = 4_000_000  # similarities at hand at a time
TIE = 1e-11  # equal distances are equal to 12 digits


def similar_by_codes(queries: DataFrame, corpus: DataFrame, k: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """queries (query_id, embedding), corpus (record_id, embedding) -> query_id, rank, record_id, distance, similarity.

    The rows of `similar_incidents`: a query is not its own neighbour, and equal distances go by id. Vectors that are null,
    zero, or hold null or non-finite numbers are skipped.
    """
    asked, distinct, stored = _sides(queries, corpus, k)
    near = candidates(distinct, stored, k + 1, block_bytes)
    full = near.select("_q", "record_id").join(stored.withColumnRenamed("embedding", "_v"), "record_id").join(distinct, "_q")
    full = full.select("_q", "record_id", F.round(cosine_distance(F.col("embedding"), F.col("_v")), DIGITS).alias("distance"))
    place = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "record_id"))
    return _per_query(asked, distinct, full.withColumn("_r", place).where(F.col("_r") <= k + 1).drop("_r"), k)


def compared(queries: DataFrame, corpus: DataFrame, k: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row: pairs, and how many of them are compared in full."""
    _, distinct, stored = _sides(queries, corpus, k)
    pairs = distinct.count() * stored.count()
    return candidates(distinct, stored, k + 1, block_bytes).agg(F.lit(pairs).cast("bigint").alias("pairs"), F.count("*").alias("compared"))


def _sides(queries: DataFrame, corpus: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = stable(_with_vector(queries, "query_id").where(sound))
    stored = stable(_lowest_ids(_with_vector(corpus, "record_id").where(sound), k + 1))
    return asked, stable(asked.groupBy("embedding").agg(F.min("query_id").alias("_q")).select("_q", "embedding")), stored


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and the bound of the error of a similarity, rounding of the products included."""
    scale = np.abs(units).max(axis=1) / 127.0
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    left_out = np.linalg.norm(units - codes * scale[:, None], axis=1)
    return codes, scale, left_out + (units.shape[1] + 4) * 2.0**-23


def bounds(units: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (units @ codes.astype(np.float32).T) * scale
    return middle - error, middle + error


def _kth(lower: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest number per row; without k numbers nothing is ruled out."""
    columns = lower.shape[1]
    return np.partition(lower, columns - k, axis=1)[:, columns - k] if columns >= k else np.full(len(lower), -np.inf)


def _strips(rows: int, columns: int) -> list[slice]:
    step = max(1, STRIP // max(1, columns))
    return [slice(lo, lo + step) for lo in range(0, rows, step)]


def _codes(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(frame["code"]), np.int8).reshape(len(frame), -1)
    return codes, frame["scale"].to_numpy(), frame["error"].to_numpy()


def candidates(queries: DataFrame, corpus: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """queries (_q, embedding), corpus (record_id, embedding) -> the pairs (_q, record_id) that may be among the k nearest."""
    q_type, id_type = queries.schema["_q"].dataType.simpleString(), corpus.schema["record_id"].dataType.simpleString()

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes, scale, error = encode(_unit(_matrix(batch["embedding"])))
                yield pd.DataFrame({"record_id": batch["record_id"], "code": [c.tobytes() for c in codes], "scale": scale, "error": error})

    coded = stable(corpus.select("record_id", "embedding").mapInPandas(code, f"record_id {id_type}, code binary, scale double, error double"))
    sizes = coded.agg(F.count("*"), F.max(F.length("code"))).first()
    if not sizes[0]:
        return _no_rows(queries, corpus).select("_q", "record_id")
    total, width = sizes
    look = _codes(smallest_hashes(coded, "record_id", FIRST_LOOK, total).toPandas())  # FIRST_LOOK codes

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                units = _unit(_matrix(batch["embedding"])).astype(np.float32)
                floor = np.concatenate([_kth(bounds(units[part], *look)[0], k) for part in _strips(len(units), len(look[0]))])
                yield pd.DataFrame({"_q": batch["_q"], "unit": [u.tobytes() for u in units], "floor": floor})

    asked = stable(queries.select("_q", "embedding").mapInPandas(ask, f"_q {q_type}, unit binary, floor double"))
    tasks = queries.sparkSession.sparkContext.defaultParallelism

    def parts(rows: int, row_bytes: int) -> int:
        return max(1, -(-rows * row_bytes // block_bytes), min(tasks, rows // LEAST_ROWS))

    q_parts, c_parts = -(-asked.count() * (4 * width + 16) // block_bytes) or 1, parts(total, width + 32)
    # each query goes to every block of codes, each code to every block of queries
    left = asked.select(
        "_q", "unit", "floor", F.pmod(F.xxhash64("_q"), F.lit(q_parts)).cast("int").alias("q_part"),
        F.explode(F.sequence(F.lit(0), F.lit(c_parts - 1))).alias("c_part"),
    )
    right = coded.select(
        "record_id", "code", "scale", "error", F.pmod(F.xxhash64("record_id"), F.lit(c_parts)).cast("int").alias("c_part"),
        F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("q_part"),
    )

    def survivors(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"_q": some["_q"][:0], "record_id": block["record_id"][:0], "lower": [], "upper": []})]
        if len(some) and len(block):
            units = np.frombuffer(b"".join(some["unit"]), np.float32).reshape(len(some), -1)
            codes, floor = _codes(block), some["floor"].to_numpy()
            asked_ids, ids = some["_q"].to_numpy(), block["record_id"].to_numpy()
            for part in _strips(len(units), len(block)):
                lower, upper = bounds(units[part], *codes)
                least = np.maximum(floor[part], _kth(lower, k)) - TIE
                rows, columns = np.nonzero(upper >= least[:, None])
                found.append(pd.DataFrame({
                    "_q": asked_ids[part][rows], "record_id": ids[columns], "lower": lower[rows, columns], "upper": upper[rows, columns],
                }))
        return pd.concat(found[1:] or found)

    schema = f"_q {q_type}, record_id {id_type}, lower double, upper double"
    kept = left.groupBy("q_part", "c_part").cogroup(right.groupBy("q_part", "c_part")).applyInPandas(survivors, schema)
    mine = Window.partitionBy("_q")
    place = F.row_number().over(mine.orderBy(F.desc("lower"), "record_id"))
    least = F.max(F.when(F.col("_r") == k, F.col("lower"))).over(mine)
    kept = kept.withColumn("_r", place).withColumn("_least", least)
    return kept.where(F.col("_least").isNull() | (F.col("upper") >= F.col("_least") - TIE)).select("_q", "record_id")
