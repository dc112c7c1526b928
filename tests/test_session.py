"""The folder that driver and executors share."""

import pytest

from faultline import session
from faultline.plans import QUERIES

STORED = ["store_actions", "read_raw_payloads", "snapshot_upsert", "stream_cooldown_alerts", "audit_trail_stored"]

ALSO_STORED = [
    "list_incident_records", "reingest_grown_folder", "store_evaluations", "store_tool_calls", "stream_alert_states",
    "stream_cycle_with_context", "stream_ingest_records", "stream_window_report", "stream_window_summary",
]


@pytest.fixture
def setting(spark, tmp_path, monkeypatch):
    """What spark.checkpoint.dir says, in a session that looks like one on a cluster."""
    said, get = {"spark.checkpoint.dir": f"file://{tmp_path}/shared/"}, type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: said[key] if key in said else get(self, key, *default))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    return said


def test_a_mounted_folder_is_used_on_a_cluster(spark, setting, tmp_path):
    assert session.shared_folder(spark) == f"file://{tmp_path}/shared"
    assert session.folders(spark, f"{tmp_path}/shared") == []


@pytest.mark.parametrize("name", STORED)
def test_stored_tables_and_streams_run_on_a_cluster(spark, setting, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ALSO_STORED)
def test_the_other_stored_tables_and_streams_run_on_a_cluster(spark, setting, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_a_folder_that_executors_do_not_see_is_refused(spark, setting, monkeypatch):
    monkeypatch.setattr(session, "_mounted", lambda spark, folder: False)
    with pytest.raises(RuntimeError, match="do not see"):
        session.shared_folder(spark)


@pytest.mark.parametrize("master", ["spark://elsewhere:7077", "local[8]"])
def test_the_folder_of_the_context_will_do(spark, setting, monkeypatch, master):
    monkeypatch.setattr(spark.sparkContext, "master", master)
    session.stable(spark.range(1))
    setting["spark.checkpoint.dir"] = None
    assert session.shared_folder(spark) == spark.sparkContext.getCheckpointDir()


def test_local_mode_needs_no_setting(spark, setting, monkeypatch):
    dirs = []
    monkeypatch.setattr(spark.sparkContext, "master", "local[8]")
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: dirs[-1] if dirs else None)
    monkeypatch.setattr(spark.sparkContext, "setCheckpointDir", dirs.append)
    setting["spark.checkpoint.dir"] = None
    assert session.shared_folder(spark) == dirs[0]
