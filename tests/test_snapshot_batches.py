"""States in batches against all at once; only touched buckets are written."""

import random

from pyspark.sql import functions as F

from faultline.operators.snapshots import snapshot_versions
from faultline.streaming.snapshots import _table, stored_versions, upsert_snapshots


def rows(df):
    return sorted(map(str, df.select("thread_id", "snapshot_id", "version", "parent_id", "first_at", "last_at", "payload").collect()))


def test_batches_in_any_order_equal_one_run(spark, tmp_path):
    rng = random.Random(2)
    made = [(f"t{min(rng.randrange(9), 5)}", rng.randrange(50), rng.choice("abcdef"), rng.randrange(3)) for _ in range(300)]
    states = spark.createDataFrame(made, "thread_id string, at int, mood string, note int")
    key = F.concat_ws(":", "mood", F.col("note") % 2)
    root, part = str(tmp_path), F.xxhash64("at", "mood", "note") % 5
    for batch_id in range(-4, 5):
        batch = states.where(part == batch_id)
        for _ in range(2 if batch_id == 2 else 1):
            upsert_snapshots(batch, key, root, batch_id + 4, buckets=4)
    assert rows(stored_versions(states, root)) == rows(snapshot_versions(states, key))
    table = _table(spark, root, states, "thread_id", "at")
    assert table.size() <= 8
    # a batch of one thread leaves the other buckets as they are
    before = {k: v[-1] for k, v in table._versions().items()}
    upsert_snapshots(spark.createDataFrame([("t1", 99, "z", 1)], states.schema), key, root, 20, buckets=4)
    after = {k: v[-1] for k, v in table._versions().items()}
    assert sum(after[k] != before[k] for k in before) == 1
    assert stored_versions(states, root).where("thread_id = 't1'").agg(F.max("last_at")).first()[0] == 99
