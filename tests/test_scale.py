"""Operators that split hot keys, against brute force on small skewed data."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.functions.sampling import smallest_hashes
from faultline.operators import cooldown as cd
from faultline.operators import ordered as od
from faultline.operators import reliability as rl
from faultline.operators import routing as rt
from faultline.operators import similarity as sm
from faultline.operators import trends as tr
from faultline.plans import window_queries


def skewed(seed, n=600, keys=4, span=2000, ties=False):
    """(key, second, id): most rows belong to key 0."""
    rnd = random.Random(seed)
    seconds = [rnd.randrange(span) for _ in range(n)] if ties else rnd.sample(range(span * 2), n)
    return [(0 if rnd.random() < 0.7 else rnd.randrange(keys), s, i) for i, s in enumerate(seconds)]


def frame(spark, data):
    return spark.createDataFrame(data, "k int, s bigint, id int").withColumn("ts", F.timestamp_seconds("s"))


@pytest.mark.parametrize("seed", range(3))
def test_running_totals(spark, seed):
    data = skewed(seed, ties=True)
    got = od.running_totals(frame(spark, data), ["k"], ["s", "id"], {"t": F.col("id")}, blocks=7)
    got = {r.id: r.t for r in got.collect()}
    want, sums = {}, {}
    for k, s, i in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        sums[k] = sums.get(k, 0) + i
        want[i] = sums[k]
    assert got == want


def test_running_totals_without_keys_and_with_null_keys(spark):
    df = spark.sql("SELECT id, if(id % 3 = 0, null, id % 3) AS k FROM range(50)")
    assert sorted(r.n for r in od.row_numbers(df, [], ["id"], "n", blocks=5).collect()) == list(range(1, 51))
    got = od.row_numbers(df, ["k"], ["id"], "n", blocks=5).where("k is null").collect()
    assert sorted(r.n for r in got) == list(range(1, 18))


def test_hot_key_is_spread_over_blocks(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), "id")
    sizes = od.ordered_blocks(df, ["k"], ["id"], blocks=8).groupBy("_block").count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 300


@pytest.mark.parametrize("reach, size", [(0, 5), (3, 10), (9, 10), (4, 1000)])
def test_sliding(spark, reach, size):
    df = od.row_numbers(frame(spark, skewed(5)), ["k"], ["s", "id"], "n", blocks=6)
    rows = df.collect()
    got = {r.id: r.t for r in od.sliding(df, ["k"], "n", reach, {"t": F.sum("id")}, size=size).collect()}
    by = {}
    for r in rows:
        by.setdefault(r.k, {})[r.n] = r.id
    assert got == {r.id: sum(by[r.k][m] for m in range(max(1, r.n - reach), r.n + 1)) for r in rows}


def test_trailing_totals(spark):
    data = skewed(9, ties=True)
    got = od.trailing_totals(frame(spark, data), ["k"], "ts", "id", 100, {"n": F.lit(1)}, blocks=6)
    got = {r.id: r.n for r in got.collect()}
    want = {i: sum(1 for k2, s2, i2 in data if k2 == k and (s - 100 < s2 < s or (s2 == s and i2 <= i))) for k, s, i in data}
    assert got == want


def greedy(data, hold):
    fired, last = [], {}
    for k, s, i in sorted(data, key=lambda r: (r[1], r[2])):
        if k not in last or s - last[k] >= hold:
            last[k] = s
            fired.append(i)
    return sorted(fired)


@pytest.mark.parametrize("seed, hold, blocks", [(0, 60, 8), (1, 7, 16), (2, 500, 12), (3, 100000, 8), (4, 1, 5)])
def test_cooldown(spark, seed, hold, blocks):
    data = skewed(seed, ties=seed % 2 == 0)
    df = frame(spark, data).withColumn("k", F.col("k").cast("string"))
    got = cd.hold_off(df, "k", "ts", "id", hold, blocks).collect()
    assert sorted(r.id for r in got) == greedy(data, hold)


def test_cooldown_with_even_spacing(spark):
    """Evenly spaced alerts, where chains from different starts never meet."""
    data = [(0, 7 * i, i) for i in range(500)]
    df = frame(spark, data).withColumn("k", F.col("k").cast("string"))
    got = cd.hold_off(df, "k", "ts", "id", 50, 10).collect()
    assert sorted(r.id for r in got) == greedy(data, 50)


@pytest.mark.parametrize("steps", [1024, 2])
def test_cooldown_steps(spark, steps):
    """Step functions against plain scans from every start, with times in several batches; few steps force scans."""
    rnd = random.Random(steps)
    for hold in (1, 9, 50, 400):
        times = np.array(sorted(rnd.sample(range(300), 80)), np.int64)
        known = cd.Steps(hold)
        for part in np.split(times, [1, 7, 40]):
            known.add(part)
        for before in range(int(times[0]) - hold - 5, int(times[0])):
            want = cd.first_in_hold(times, hold, before)[1]
            assert cd.last_after(known.upper, known.last, hold, before) == want
    data = [(0, 7 * i, i) for i in range(500)]
    df = frame(spark, data).withColumn("k", F.col("k").cast("string"))
    assert sorted(r.id for r in cd.hold_off(df, "k", "ts", "id", 50, 10, steps).collect()) == greedy(data, 50)


@pytest.mark.parametrize("blocks", [4, 32])
def test_cooldown_jobs(spark, blocks):
    """Even spacing takes the same number of scans however many blocks there are."""
    data = [(0, 7 * i, i) for i in range(500)]
    df = frame(spark, data).withColumn("k", F.col("k").cast("string"))
    group = f"cooldown-{blocks}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert sorted(r.id for r in cd.hold_off(df, "k", "ts", "id", 50, blocks).collect()) == greedy(data, 50)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 8


def test_cooldown_sample(spark):
    data = [(0, s, s) for s in (0, 30, 60, 90, 130)]
    df = frame(spark, data).select(F.col("k").cast("string").alias("name"), "ts", F.col("id").alias("alert_id"))
    assert sorted(r.alert_id for r in cd.cooldown_alerts(df).collect()) == [0, 60, 130]


def vectors(spark, matrix, name):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} int, embedding array<float>")


def brute(matrix, k):
    m = matrix.astype(np.float32).astype(np.float64)
    n = np.linalg.norm(m, axis=1)
    d = np.round(1 - (m @ m.T) / np.outer(n, n), 12)
    return {i: [j for j in sorted(range(len(m)), key=lambda j: (d[i, j], j)) if j != i][:k] for i in range(len(m))}


def neighbours(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.record_id)
    return got


@pytest.mark.parametrize("k, pivots, block", [(3, 8, 400), (5, 4, 4_000_000), (1, 1, 64)])
def test_similar_incidents_with_copies(spark, k, pivots, block):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 8)) * 4
    matrix = np.vstack([centers[rng.integers(0, 6, 120)] + rng.standard_normal((120, 8)), np.tile(centers[0], (60, 1))])
    found = sm.similar_incidents(vectors(spark, matrix, "query_id"), vectors(spark, matrix, "record_id"), k, pivots, block)
    assert neighbours(found) == brute(matrix, k)


def test_similar_incidents_edges(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [0.0, 0.0])], "record_id int, embedding array<float>")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, embedding array<float>")
    got = [(r.rank, r.record_id, r.similarity) for r in sm.similar_incidents(asked, corpus, 3).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 0.0)]
    assert sm.similar_incidents(asked, corpus.where("record_id > 2"), 3).count() == 0


@pytest.mark.parametrize("spread, most", [(0.1, 0.2), (10.0, 0.95)])
def test_inverted_file_visits_what_its_recall_asks_for(spark, monkeypatch, spread, most):
    rng = np.random.default_rng(5)
    matrix = np.vstack([np.repeat(rng.standard_normal((40, 16)) * 5, 15, axis=0) + rng.standard_normal((600, 16)) * spread, np.ones((30, 16))])
    q, c = vectors(spark, matrix, "query_id"), vectors(spark, matrix, "record_id")
    seen, probes = [], sm._probes
    monkeypatch.setattr(sm, "_probes", lambda placed, sample, centers, k, target: seen.append((probes(placed, sample, centers, k, target), len(centers))) or seen[-1][0])
    r = sm.recall(sm.similar_incidents_ivf(q, c, per_cell=16), sm.similar_incidents(q, c)).collect()[0]
    assert r.expected == 1890 and r.recall >= 0.9
    visited, cells = seen[0]
    assert cells > 30 and visited <= most * cells


def test_inverted_file_of_one_cell_is_exact(spark):
    matrix = np.random.default_rng(6).standard_normal((90, 8))
    q, c = vectors(spark, matrix, "query_id"), vectors(spark, matrix, "record_id")
    assert neighbours(sm.similar_incidents_ivf(q, c)) == brute(matrix, 3)
    assert sm.similar_incidents_ivf(q, c.where("record_id < 0")).count() == 0


@pytest.mark.parametrize("spread", [0.1, 10.0])
def test_exact_inverted_file_goes_to_every_cell_that_may_hold_a_neighbour(spark, monkeypatch, spread):
    rng = np.random.default_rng(5)
    matrix = np.vstack([np.repeat(rng.standard_normal((40, 16)) * 5, 15, axis=0) + rng.standard_normal((600, 16)) * spread, np.ones((30, 16))])
    q, c = vectors(spark, matrix, "query_id"), vectors(spark, matrix, "record_id")
    # a vector that is no direction is nobody's neighbour, and takes no cell out of the search
    odd = spark.createDataFrame([(-1, [float("inf")] * 16), (-2, [float("nan")] * 16)], "record_id int, embedding array<float>")
    for target in (0.0, sm.TARGET):
        found = sm.similar_incidents_ivf(q, c.unionByName(odd), per_cell=16, target=target, exact=True)
        assert neighbours(found) == brute(matrix, 3)
    # some are missed without
    assert neighbours(sm.similar_incidents_ivf(q, c, per_cell=16, target=0.0)) != brute(matrix, 3)
    # cells are ruled out where vectors are in groups
    searched, search = [], sm._cell_search

    def counted(queries, corpus, sizes, centers, visits, *rest):
        def seen(far, *reach):
            wanted = visits(far, *reach)
            share.add(int(wanted.sum()))
            return wanted

        share = spark.sparkContext.accumulator(0)
        searched.append((share, len(sizes)))
        return search(queries, corpus, sizes, centers, seen, *rest)

    monkeypatch.setattr(sm, "_cell_search", counted)
    sm.similar_incidents_ivf(q, c, per_cell=16, exact=True).collect()
    (first, cells), (rest, _) = searched
    assert (first.value + rest.value < 0.3 * 601 * cells) == (spread < 1)


def test_neighbours_of_queries_are_all_found(spark, tmp_path):
    """Four cells, of which a query visits one for 98 % of the neighbours: 446 of 24,600 are in others."""
    matrix = np.random.default_rng(5).standard_normal((8200, 3)).astype(np.float32)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(8200), "embedding": list(matrix)}), "vec_id bigint, embedding array<float>")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {}
    for r in window_queries.neighbours(spark, str(tmp_path)).orderBy("rank").collect():
        found.setdefault(int(r.query_id[4:]), []).append(int(r.record_id[4:]))
    units = matrix.astype(np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    for lo in range(0, 8200, 1025):
        far = np.round(1 - units[lo : lo + 1025] @ units.T, 12)
        far[np.arange(1025), np.arange(lo, lo + 1025)] = np.inf
        nearest = np.argsort(far, axis=1, kind="stable")[:, :3]
        assert [found[lo + i] for i in range(1025)] == nearest.tolist()


def test_smallest_hashes_are_those_of_the_whole(spark):
    df = spark.range(20_000)
    got = {r.id for r in smallest_hashes(df, "id", 100, 20_000).collect()}
    assert got == {r.id for r in df.orderBy(F.xxhash64("id")).limit(100).collect()}


def test_lsh_finds_most_of_clustered_neighbours(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((20, 16)) * 5
    matrix = np.repeat(centers, 10, axis=0) + rng.standard_normal((200, 16)) * 0.1
    q, c = vectors(spark, matrix, "query_id"), vectors(spark, matrix, "record_id")
    r = sm.recall(sm.similar_incidents_lsh(q, c), sm.similar_incidents(q, c)).collect()[0]
    assert r.expected == 600 and r.recall > 0.9


def test_rolling_health(spark):
    rnd = random.Random(8)
    data = [("a" if rnd.random() < 0.8 else "b", i, rnd.random() < 0.9, rnd.random() < 0.1, rnd.randrange(100)) for i in range(300)]
    df = spark.createDataFrame([(s, i, ok, fb, float(ms)) for s, i, ok, fb, ms in data], "service string, request_id int, ok boolean, used_fallback boolean, latency_ms double")
    got = {(r.service, r.seq_no): (r.window_size, r.health, r.error_rate) for r in rl.rolling_health(df.withColumn("ts", F.timestamp_seconds("request_id")), 5).collect()}
    want = {}
    for s in "ab":
        mine = [r for r in data if r[0] == s]
        for n in range(5, len(mine) + 1, 5):
            window = mine[max(0, n - 10):n]
            rate = sum(not r[2] for r in window) / len(window)
            want[s, n] = (len(window), "OK" if rate <= 0.05 else "DEGRADED" if rate <= 0.15 else "CRITICAL", rate)
    assert got == want


def test_latency_percentiles(spark):
    rnd = random.Random(2)
    values = [rnd.randrange(50) for _ in range(501)]
    df = spark.createDataFrame([("g", v, v % 3 > 0) for v in values], "g string, latency_ms int, ok boolean")
    r = tr.latency_summary(df, ["g"]).collect()[0]
    s = sorted(values)
    assert (r.p50, r.p95, r.p99, r.total) == (s[501 // 2], s[int(501 * 0.95)], s[int(501 * 0.99)], 501)


def test_similar_in_last_is_strict_at_the_far_end(spark):
    df = spark.createDataFrame([(0, "x"), (3600, "x"), (3601, "x"), (3602, "y")], "s bigint, incident_type string")
    df = df.select(F.timestamp_seconds("s").alias("ts"), F.col("s").alias("record_id"), "incident_type")
    got = {r.record_id: r.similar for r in rt.similar_in_last(df, 1).collect()}
    assert got == {0: 1, 3600: 1, 3601: 2, 3602: 1}
    assert {r.record_id: r.similar for r in rt.similar_in_last(df, 1, include_self=False).collect()}[3601] == 1


def plain_pairs(a, b, spans, wanted, k):
    """The k nearest rows of b per row of a in the wanted spans, compared one by one."""
    out = []
    for i, x in enumerate(a.astype(np.float64)):
        near = []
        for s, (lo, hi) in enumerate(spans):
            for j in range(lo, hi if wanted[i, s] else lo):
                y = b[j].astype(np.float64)
                norm = np.linalg.norm(x) * np.linalg.norm(y)
                if np.isfinite(norm):
                    near.append((round(1 - float(x @ y) / norm, 12), j))
        out += [(i, j, d) for d, j in sorted(near)[:k]]
    return out


def test_products_of_floats_rule_out_no_neighbour(monkeypatch):
    monkeypatch.setattr(sm, "STRIP", 7)
    monkeypatch.setattr(sm, "COLUMNS", 9)
    rng = np.random.default_rng(1)
    b = rng.standard_normal((120, 5)).astype(np.float32)
    b[20:60] = b[20] + rng.standard_normal((40, 5)).astype(np.float32) * 1e-7  # closer than floats tell apart
    b[70, 2] = np.nan
    a = np.vstack([b[15:45], b[65:75], rng.standard_normal((20, 5))]).astype(np.float32)
    spans = [(0, 3), (3, 80), (80, 80), (80, 120)]
    wanted = rng.random((len(a), 4)) < 0.7
    rows, columns, distance = sm._nearest_pairs(a, b, spans, wanted, np.arange(len(b)), 4, False)
    got = sorted(zip(rows.tolist(), distance.tolist(), columns.tolist(), strict=True))
    assert [(i, j, d) for i, d, j in got] == plain_pairs(a, b, spans, wanted, 4)


def test_cells_are_packed_into_blocks():
    first, parts, blocks = sm._packed([3, 4, 25, 5, 5, 1], 10)
    assert blocks == [(0, 2), (2, 3), (2, 3), (2, 3), (3, 5), (5, 6)]
    assert first.tolist() == [0, 0, 1, 4, 4, 5] and parts.tolist() == [1, 1, 3, 1, 1, 1]


@pytest.mark.parametrize("block", [1_600, 4_000_000])
def test_small_cells_in_blocks_find_all(spark, block):
    matrix = np.random.default_rng(2).standard_normal((600, 16)).astype(np.float32)
    centers = sm._centers(sm._unit(matrix.astype(np.float64)), 60)
    cell = sm._to_pivots(sm._unit(matrix.astype(np.float64)), centers).argmin(axis=1)
    rows = [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(matrix, cell, strict=True))]
    corpus = spark.createDataFrame(rows, "record_id int, embedding array<float>, cell int")
    sizes = {int(c): int((cell == c).sum()) for c in np.unique(cell)}
    asked = vectors(spark, matrix, "_q")
    found = sm._cell_search(asked, corpus, sizes, centers, lambda far: np.ones((len(far), len(sizes)), dtype=bool), 4, block)
    got = {}
    for r in sorted(found.where("_q <> record_id").collect(), key=lambda r: (r.distance, r.record_id)):
        got.setdefault(r["_q"], []).append(r.record_id)
    assert got == brute(matrix, 3)


def test_a_block_of_retrieval_holds_no_distance_of_each_pair(spark, monkeypatch):
    """What retrieval_context and rag_evaluate hold in a Python worker: 3000 vectors are compared with 20,000."""
    q, c = (vectors(spark, np.eye(4), name) for name in ("query_id", "record_id"))
    ops, given = type(q.groupBy("query_id").cogroup(c.groupBy("record_id"))), []
    run = ops.applyInPandas
    monkeypatch.setattr(ops, "applyInPandas", lambda self, func, schema: given.append(func) or run(self, func, schema))
    sm.similar_incidents_ivf(q, c)
    matrix = np.random.default_rng(3).standard_normal((20_000, 16)).astype(np.float32)
    right = pd.DataFrame({"record_id": np.arange(20_000), "embedding": list(matrix), "cell": 0})
    left = pd.DataFrame({"_q": np.arange(3000), "embedding": list(matrix[:3000]), "block": 0, "visited": b"\x80", "cell": 0})
    tracemalloc.start()
    try:
        found = given[-1](left, right)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # a byte a pair would be 60 MB
    assert most < 50e6
    nearest = found[found["distance"] < 1e-9]
    assert len(found) == 12_000 and (nearest["_q"] == nearest["record_id"]).sum() == 3000
