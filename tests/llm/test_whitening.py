"""Whitening against dense linear algebra, and its solver on hard matrices."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import vectors

from faultline.llm import whitening
from faultline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 40), st.sampled_from(["plain", "graded", "zero", "equal", "low", "whole"]), st.integers(0, 2**32 - 1))
def test_directions_are_the_singular_vectors(size, kind, seed):
    rows = np.random.default_rng(seed).standard_normal((120, size))
    if kind == "graded":
        rows *= np.logspace(0, -7, size)
    elif kind == "zero":
        rows[:, : size // 2] = 0
    elif kind == "equal":
        rows = np.vstack([np.eye(size)] * 3)
    elif kind == "low":
        rows = rows[:, :3] @ np.random.default_rng(seed + 1).standard_normal((rows[:, :3].shape[1], size))
    elif kind == "whole":
        rows = np.round(rows)
    values, v = whitening.directions(np.linalg.qr(rows, mode="r"))
    want = np.linalg.svd(rows, compute_uv=False)
    want = want[want > whitening.FLAT * want[0]][:16]
    assert len(values) == len(want)
    assert np.allclose(values, want, rtol=1e-6 if kind == "graded" else 1e-10)
    assert np.allclose(v.T @ v, np.eye(len(want)), atol=1e-9)
    white = rows @ v / values
    assert np.allclose(white.T @ white, np.eye(len(want)), atol=1e-6)


def test_values_that_nearly_meet():
    tri = np.diag(np.abs(np.arange(-10, 11)) + 2.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    values, v = whitening.directions(np.linalg.cholesky(tri).T)
    assert np.allclose(v.T @ v, np.eye(16), atol=1e-12)
    assert np.allclose(tri @ v, v * values**2, atol=1e-12)


def brute(rows):
    """(vec_id, component) -> n, deviation, whitened (as |value|), explained of the rows of one length."""
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000 for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    out = {}
    for i, v in x.items():
        deviation = sum((n * int(a) - s) ** 2 for a, s in zip(v, sums, strict=True))
        for k in range(min(16, len(values))):
            if values[k] > 1e-15 * values[0]:
                out[i, k + 1] = n, deviation, abs((v - fit.mean(axis=0)) @ vectors_[:, k] / np.sqrt(values[k])), values[k] / values.sum()
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(white, abs=1e-7) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_query_against_brute_force(spark):
    rows = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    usable = [(i, v) for i, v in zip(rows.vec_id, rows.embedding, strict=True) if v is not None and np.isfinite(np.array(v, float)).all()]
    check(QUERIES["op11_whitening"](spark, FOLDER).collect(), brute(usable))


def test_many_triangles_are_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * np.arange(1, 7)]) for i in range(400)]
    table = vectors(spark, [*rows, *[(1000 + k, rows[0][1]) for k in range(200)]]).repartition(100)
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = whitening.whiten(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute(rows)
    assert len(got) == 600 and {r.n for r in got} == {len({tuple(v) for _, v in rows})}
    for r in got:
        i = r.vec_id if r.vec_id < 1000 else 0
        assert int(r.deviation) == want[i, 1][1]
        assert np.allclose(np.abs(r.whitened), [want[i, k][2] for k in range(1, 7)], atol=1e-8)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, -inf]), (5, []), (None, [1.0, 2.0]), (6, [3.0, -2.0]), (6, [3.0, -2.0]),
            (7, [0.0, 0.5]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.n, len(r.whitened)) for r in got) == [
        ("6", 3, 2), ("6", 3, 2), ("7", 3, 2), ("8", 1, 0), ("9", 1, 0), ("None", 3, 2)]
    assert {r.deviation for r in got if r.vec_id in (8, 9)} == {0}
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, rows[:5])).count() == 0


def test_large_entries_are_exact_or_held(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e10, 5.0]), (4, [1e10, -5.0])]
    got = {r.vec_id: r for r in whitening.whiten(vectors(spark, rows)).collect()}
    x = [[whitening.HELD + 1_000_000, 1_000_064], [-whitening.HELD + 1_000_000, 1_000_128]]
    x += [[64 * int(np.float32(1e10)) + 1_000_000, 1_000_000 + 320], [64 * int(np.float32(1e10)) + 1_000_000, 1_000_000 - 320]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert int(got[3].deviation) == sum((4 * a - s) ** 2 for a, s in zip(x[2], sums, strict=True))
