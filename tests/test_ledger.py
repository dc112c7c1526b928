"""Folders that grow: ids stay, nothing is stored twice, a batch that was cut off is done again."""

import json

from faultline.session import delete
from faultline.sources.ledger import ingest_folder, ledger
from faultline.sources.payloads import read_raw_payloads


def line(k):
    return json.dumps({"message": f"event {k % 7}", "service": "s", "level": "ERROR"}) + "\n"


def write(path, first, last):
    with open(path, "a") as f:
        f.writelines(line(k) for k in range(first, last))


def places(spark, folder):
    return {(r.position, r.raw) for r in read_raw_payloads(spark, str(folder), "spring-boot").collect()}


def test_places_do_not_depend_on_other_files_or_splits(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "b.log", 0, 300)
    with open(folder / "b.log", "a") as f:
        f.write("\n  \n")
    write(folder / "b.log", 300, 500)
    first = places(spark, folder)
    assert len(first) == 500 and max(int(p.rsplit(":", 1)[1]) for p, _ in first) == 502
    write(folder / "a.log", 0, 100)
    write(folder / "c d.log", 0, 10)
    write(folder / "b.log", 500, 520)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        second = places(spark, folder)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first <= second and len(second) == 630
    assert {int(p.rsplit(":", 1)[1]) for p, _ in second if "a.log" in p} == set(range(1, 101))


def ids(spark, root):
    return [r.record_id for r in spark.read.parquet(f"{root}/records").select("record_id").collect()]


def test_folder_that_grows(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write(folder / "a.log", 0, 20)
    write(folder / "b.log", 0, 30)
    (folder / "bad.log").write_text("{cut off\n" * 3)
    assert ingest_folder(spark, str(folder), root, "spring-boot") == 1
    first = ids(spark, root)
    assert len(first) == len(set(first)) == 50
    assert ingest_folder(spark, str(folder), root, "spring-boot") == 0
    write(folder / "c.log", 0, 5)
    write(folder / "b.log", 30, 41)
    write(folder / "bad.log", 0, 1)
    assert ingest_folder(spark, str(folder), root, "spring-boot", files_at_once=2) == 2
    second = ids(spark, root)
    assert len(second) == len(set(second)) == 67 and set(first) < set(second)
    assert spark.read.parquet(f"{root}/quarantine").count() == 3
    assert ledger(spark, root).count() == 6


def test_a_batch_without_ledger_entry_is_done_again(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write(folder / "a.log", 0, 20)
    ingest_folder(spark, str(folder), root, "spring-boot")
    write(folder / "b.log", 0, 9)
    ingest_folder(spark, str(folder), root, "spring-boot")
    want = sorted(ids(spark, root))
    # the run ended after its results and before its ledger entry
    delete(spark, f"{root}/ledger/batch_id=1")
    assert ingest_folder(spark, str(folder), root, "spring-boot") == 1
    assert sorted(ids(spark, root)) == want
