"""The exact search by codes against all pairs."""

import numpy as np
import pytest

from faultline.operators import codes
from faultline.operators.similarity import similar_incidents


def vectors(spark, matrix, name):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(matrix)], f"{name} int, embedding array<float>")


def brute(asked, stored, k, own):
    a, b = (m.astype(np.float32).astype(np.float64) for m in (asked, stored))
    d = np.round(1 - (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)), 12)
    return {i: [j for j in np.lexsort((np.arange(len(b)), d[i]))[: k + 1].tolist() if not (own and j == i)][:k] for i in range(len(a))}


def neighbours(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.record_id)
    return got


@pytest.mark.parametrize("k, block", [(3, 2000), (5, codes.BLOCK_BYTES), (1, 400)])
def test_equals_all_pairs_with_copies(spark, monkeypatch, k, block):
    monkeypatch.setattr(codes, "FIRST_LOOK", 16)
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 8)) * 4
    matrix = np.vstack([centers[rng.integers(0, 6, 120)] + rng.standard_normal((120, 8)), np.tile(centers[0], (60, 1)), -centers])
    q, c = vectors(spark, matrix, "query_id"), vectors(spark, matrix, "record_id")
    assert neighbours(codes.similar_by_codes(q, c, k, block)) == brute(matrix, matrix, k, True)
    assert sorted(codes.similar_by_codes(q, c, k, block).collect()) == sorted(similar_incidents(q, c, k).collect())


def test_bounds_hold(spark):
    rng = np.random.default_rng(8)
    for width in (1, 2, 64, 1536):
        v = rng.standard_normal((300, width)) * rng.choice([1e-3, 1, 50], (300, width))
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        lower, upper = codes.bounds(u.astype(np.float32), *codes.encode(u))
        exact = u @ u.T
        assert (lower <= exact).all() and (exact <= upper).all()


def test_few_full_comparisons_without_structure(spark):
    rng = np.random.default_rng(9)
    matrix = rng.standard_normal((40_000, 64)).astype(np.float32)
    path = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(matrix)], "record_id int, embedding array<float>")
    asked = path.where("record_id < 300").withColumnRenamed("record_id", "query_id")
    got = codes.compared(asked, path).first()
    assert got.pairs == 300 * 40_000 and got.compared < 0.001 * got.pairs
    assert neighbours(codes.similar_by_codes(asked, path)) == brute(matrix[:300], matrix, 3, True)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [])]
    corpus = spark.createDataFrame(rows, "record_id int, embedding array<float>")
    asked = spark.createDataFrame([(9, [2.0, 0.0]), (10, None), (11, [nan, 0.0])], "query_id int, embedding array<float>")
    got = [(r.query_id, r.rank, r.record_id, r.similarity) for r in codes.similar_by_codes(asked, corpus).orderBy("rank").collect()]
    assert got == [(9, 1, 1, 1.0), (9, 2, 2, 0.0)]
    assert codes.similar_by_codes(asked, corpus.where("record_id > 2")).count() == 0
    assert codes.similar_by_codes(asked.limit(0), corpus).count() == 0
