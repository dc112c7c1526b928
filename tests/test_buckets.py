"""Tables in buckets: the audit trail without a shuffle."""

import uuid

import pytest

from faultline.plans import QUERIES
from faultline.sources import store

FOLDER = "/root/testdata/sf0.001"


def test_audit_trail_of_stored_tables_shuffles_nothing(spark):
    trail = QUERIES["audit_trail_stored"](spark, FOLDER)
    rows = sorted(map(tuple, trail.collect()), key=str)
    plan = trail._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    assert rows == sorted(map(tuple, QUERIES["audit_trail"](spark, FOLDER).select(trail.columns).collect()), key=str)


def test_batches_add_a_file_per_bucket(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    rows = spark.range(1000).selectExpr("cast(id AS string) AS record_id", "id AS x")
    for k in range(2):
        table = store.write_bucketed(rows.where(f"x % 2 = {k}"), name, str(tmp_path / "t"), 4)
    files = [f.name for f in (tmp_path / "t").glob("*.parquet")]
    assert len(files) == 8
    assert sorted(r.x for r in table.collect()) == list(range(1000))
    # no rows, and rows that are there again, are what they are
    assert store.write_bucketed(rows.limit(0), name, str(tmp_path / "t"), 4).count() == 1000


def test_ids_must_be_strings(spark, tmp_path):
    with pytest.raises(ValueError):
        store.write_bucketed(spark.range(3).selectExpr("id AS record_id"), "never", str(tmp_path / "n"))
