"""The stored inverted file: grows by batches, refits as it grows, survives batches that run again, prunes cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import similarity as sm
from faultline.operators.inverted import InvertedFile
from faultline.session import folders


def vectors(spark, lo, hi, groups=20, size=16, seed=0):
    rng = np.random.default_rng(seed)
    heart = rng.standard_normal((groups, size)) * 3
    rows = []
    for k in range(lo, hi):
        v = heart[k % groups] + np.random.default_rng(k + 1).standard_normal(size)
        rows.append((f"r{k:06d}", [float(np.float32(x)) for x in v], f"n{k}"))
    return spark.createDataFrame(rows, "record_id string, embedding array<float>, name string")


def pairs(df):
    return {(r.query_id, r["rank"], r.record_id) for r in df.select("query_id", "rank", "record_id").collect()}


def test_grows_and_finds_what_an_exact_search_finds(spark, tmp_path):
    file = InvertedFile(spark, str(tmp_path), ["name"], per_cell=50)
    parts = [vectors(spark, 0, 300), vectors(spark, 300, 700), vectors(spark, 700, 2000)]
    for k, part in enumerate(parts):
        asked = part.select(F.col("record_id").alias("query_id"), "embedding")
        found = file.search(asked, k)
        if k == 0:
            assert found is None
        else:
            before = spark.createDataFrame([], parts[0].schema)
            for p in parts[:k]:
                before = before.unionByName(p)
            want = pairs(sm.similar_incidents(asked, before))
            got = pairs(found)
            assert len(got & want) / len(want) > 0.95
            assert {r.name for r in found.select("name").distinct().collect()} <= {f"n{i}" for i in range(2000)}
        file.extend(part, k)
    # grown more than fourfold since the first fit: one new generation
    assert file._generations(3) == [0, 2]
    centers, probes, fitted = file._centers(2)
    assert len(centers) == 40 and fitted == 2000 and probes < 20
    # a query visits its cells' folders only
    found = file.search(parts[0].limit(1).select(F.col("record_id").alias("query_id"), "embedding"), 3)
    scans = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scans and "cell#" in scans[scans.index("PartitionFilters: [") :][:200]
    file.extend(vectors(spark, 2000, 2100), 3)
    assert folders(spark, str(tmp_path)) == ["generation=2"]


def test_a_batch_may_run_again(spark, tmp_path):
    file = InvertedFile(spark, str(tmp_path), per_cell=20)
    file.extend(vectors(spark, 0, 100), 0)
    for _ in range(2):
        file.extend(vectors(spark, 100, 600), 1)
    for _ in range(2):
        file.extend(vectors(spark, 600, 650), 2)
    assert file.read(1, 3).count() == 650 == file.read(1, 3).select("record_id").distinct().count()
    asked = vectors(spark, 0, 50).select(F.col("record_id").alias("query_id"), "embedding")
    # a search of an earlier batch does not see later ones
    assert all(r[2] < "r000600" for r in pairs(file.search(asked, 2)))


def test_odd_vectors(spark, tmp_path):
    schema = "record_id string, embedding array<float>"
    file = InvertedFile(spark, str(tmp_path))
    file.extend(spark.createDataFrame([("a", None), ("b", [0.0, 0.0])], schema), 0)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("z", None)], "query_id string, embedding array<float>")
    assert file.search(asked, 1) is None
    file.extend(spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0])], schema), 1)
    assert pairs(file.search(asked, 2)) == {("a", 1, "d"), ("a", 2, "c")}


@pytest.mark.parametrize("size", [64])
def test_vectors_without_structure(spark, tmp_path, size):
    rows = [(f"r{k:05d}", [float(x) for x in np.random.default_rng(k).standard_normal(size)]) for k in range(1500)]
    table = spark.createDataFrame(rows, "record_id string, embedding array<float>")
    file = InvertedFile(spark, str(tmp_path), per_cell=100)
    file.extend(table, 0)
    asked = table.limit(200).select(F.col("record_id").alias("query_id"), "embedding")
    want = pairs(sm.similar_incidents(asked, table))
    assert len({(a, c) for a, _, c in pairs(file.search(asked, 1))} & {(a, c) for a, _, c in want}) / len(want) > 0.9
