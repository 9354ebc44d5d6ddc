import base64
import glob
import json
import os

import pytest
from pyspark.sql.types import IntegerType, StructField, StructType

import tableload as tl
from tableload.plans import jobs


@pytest.fixture
def csv_file(tmp_path):
    file = tmp_path / "in.csv"
    file.write_text("id;name;price\n1;a;10\n2;b;20\n2;c;30\n")
    return str(file)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_load_csv(spark, tmp_path, csv_file):
    target = str(tmp_path / "t")
    assert jobs.load_csv(spark, csv_file, target, ";") == 3
    assert jobs.load_csv(spark, csv_file, target, ";") == 3
    assert spark.read.parquet(target).where("last_upd_timestamp IS NOT NULL").count() == 6
    jobs.load_csv(spark, csv_file, target, ";", mode="overwrite")
    assert spark.read.parquet(target).count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        jobs.load_csv(spark, csv_file, target, ";", mode="create")


def test_load_csv_by_key(spark, tmp_path, csv_file):
    target = str(tmp_path / "t")
    jobs.load_csv_by_key(spark, csv_file, target, ["id"], ["price"], ";", snapshots=True)
    (tmp_path / "more.csv").write_text("id;name;price\n1;z;1\n3;y;2\n")
    jobs.load_csv_by_key(spark, str(tmp_path / "more.csv"), target, ["id"], ["price"], ";", snapshots=True)
    wanted = [("1", "z", "1"), ("2", "c", "30"), ("3", "y", "2")]
    assert rows(tl.read_snapshot(spark, target), "id", "name", "price") == wanted
    jobs.load_csv_by_key(spark, csv_file, target, ["id"], ["price"], ";", replace=True, snapshots=True)
    assert rows(tl.read_snapshot(spark, target), "id", "name") == [("1", "a"), ("2", "c")]


def test_load_csv_by_key_into_partitions(spark, tmp_path, csv_file):
    target = str(tmp_path / "t")
    for replace in (False, False, True):
        jobs.load_csv_by_key(spark, csv_file, target, ["id"], ["price"], ";", partition_by=["name"], replace=replace)
        assert rows(spark.read.parquet(target), "name", "price") == [("a", "10"), ("b", "20"), ("c", "30")]


def test_load_csv_to_table(spark, tmp_path, csv_file):
    spark.sql("CREATE DATABASE IF NOT EXISTS tests")
    for n in (1, 2):
        table = jobs.load_csv_to_table(spark, csv_file, "tests.job", str(tmp_path / "t"), ";", ["name"], {"k": "v"})
        assert table.count() == 3 * n
    spark.sql("DROP TABLE tests.job")


def test_load_csv_to_warehouse(spark, csv_file):
    spark.sql("CREATE DATABASE IF NOT EXISTS tests")
    for _ in range(2):
        jobs.load_csv_to_warehouse(spark, csv_file, "wh", "tests", ";")
    assert spark.table("tests.wh").count() == 3
    spark.sql("DROP TABLE tests.wh")


def test_load_events(spark, tmp_path):
    def events(*records):
        data = [{"kinesis": {"data": base64.b64encode(json.dumps(r).encode()).decode()}} for r in records]
        return spark.createDataFrame([(json.dumps({"Records": data}),)], "value string")

    target, bad = str(tmp_path / "t"), str(tmp_path / "bad")
    jobs.load_events(events({"id": "1", "n": "a"}, {"id": "2", "n": "b"}), target, ["id"], snapshots=True)
    jobs.load_events(events({"id": "2", "n": "c"}, {"n": "lost"}), target, ["id"], quarantine=bad, batch_id=1, snapshots=True)
    assert rows(tl.read_snapshot(spark, target).selectExpr("id", "payload['n'] AS n"), "id", "n") == [("1", "a"), ("2", "c")]
    jobs.load_events(events({"id": "2", "n": "c"}, {"n": "lost"}), target, ["id"], quarantine=bad, batch_id=1, snapshots=True)
    assert spark.read.parquet(bad).count() == 1
    with pytest.raises(Exception, match="cannot be decoded"):
        jobs.load_events(events({"n": "lost"}, {"id": "1", "n": "x"}), target, ["id"], snapshots=True)


def test_quality_job_on_both_formats(spark, tmp_path, csv_file):
    check = tl.Check("Warning", "c").has_size(lambda n: n == 3).is_unique("id")
    tl.append(tl.scan_csv(spark, csv_file, ";"), str(tmp_path / "p"))
    for source, options in ((csv_file, {"format": "csv", "sep": ";"}), (str(tmp_path / "p"), {"format": "parquet"})):
        result = jobs.check_quality(spark, source, [check], str(tmp_path / "reports"), **options)
        assert [r[4] for r in result.results] == ["Success", "Failure"]
        assert spark.read.csv(str(tmp_path / "reports/verification-results")).count() == 2


def test_catalog_job(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    storage = {"Columns": [{"Name": "id", "Type": "bigint"}], "Location": str(tmp_path / "t")}
    assert jobs.read_catalog_entry(spark, {"Table": {"StorageDescriptor": storage}}).count() == 3


def test_loads_name_their_way_of_storing_and_their_batch(spark, tmp_path):
    event = spark.createDataFrame([('{"Records": []}',)], "value string")
    with pytest.raises(ValueError, match="how the table is stored"):
        jobs.load_events(event, str(tmp_path / "t"), ["id"])
    with pytest.raises(ValueError, match="how the table is stored"):
        jobs.load_csv_by_key(spark, str(tmp_path / "x.csv"), str(tmp_path / "t"), ["id"])
    for options in ({"quarantine": str(tmp_path / "bad")}, {"commit": True}):
        with pytest.raises(ValueError, match="batch_id"):
            jobs.load_events(event, str(tmp_path / "t"), ["id"], snapshots=True, **options)


def test_loads_keep_all_bad_records_and_count(spark, tmp_path):
    target, bad = str(tmp_path / "t"), str(tmp_path / "bad")
    load = lambda batch_id, *data: jobs.load_events(
        envelope(spark, *data), target, ["id"], quarantine=bad, batch_id=batch_id, buckets=2
    )
    first = load(1, {"id": "1"}, {"id": "2"}, {"n": "no id"})
    second = load(2, {"id": "2", "n": "x"}, {"id": "3"}, {"m": "none either"}, {"m": "nor here"})
    assert (first.read, first.good, first.bad, first.inserted, first.replaced) == (3, 2, 1, 2, 0)
    assert (second.read, second.good, second.bad, second.inserted, second.replaced) == (4, 2, 2, 1, 1)
    assert spark.read.parquet(bad).count() == 3


def test_a_failed_load_leaves_no_staged_batch(spark, tmp_path):
    scratch = tl.scratch_path(spark, "x").rpartition("/")[0]
    before = set(os.listdir(scratch)) if os.path.exists(scratch) else set()
    with pytest.raises(Exception, match="cannot be decoded"):
        jobs.load_events(envelope(spark, {"n": "no id"}), str(tmp_path / "t"), ["id"], buckets=2)
    assert (set(os.listdir(scratch)) if os.path.exists(scratch) else set()) <= before


def envelope(spark, *records):
    data = [{"kinesis": {"data": base64.b64encode(json.dumps(r).encode()).decode()}} for r in records]
    return spark.createDataFrame([(json.dumps({"Records": data}),)], "value string")


COMPACTED_SCHEMA = StructType([StructField(n, IntegerType()) for n in "kv"])


def appended(spark, folder, batch_id, *pairs):
    events = envelope(spark, *[{"k": k, "v": v} for k, v in pairs])
    jobs.append_events(events, f"{folder}/in", ["k"], COMPACTED_SCHEMA, batch_id, f"{folder}/bad")


def test_compaction_reads_new_batches_only(spark, tmp_path, monkeypatch):
    folder, target, read = str(tmp_path), str(tmp_path / "out"), []
    reading = jobs._read_batches
    monkeypatch.setattr(jobs, "_read_batches", lambda s, a, b: read.append(b) or reading(s, a, b))
    compact = lambda **options: jobs.compact_events(spark, f"{folder}/in", target, ["k"], ["v"], buckets=4, **options)
    table = lambda: rows(tl.read_partitions(spark, target), "k", "v")
    appended(spark, folder, 9, (1, 1), (2, 5))
    appended(spark, folder, 10, (2, 4), (3, 1))
    assert compact() == 2 and table() == [(1, 1), (2, 5), (3, 1)]
    assert compact() == 0
    appended(spark, folder, 11, (1, 2))
    other_buckets = {p: sorted(glob.glob(f"{target}/{p}/*.parquet")) for p in os.listdir(target) if p.startswith("key_bucket")}
    assert rows(jobs.latest_events(spark, f"{folder}/in", ["k"], ["v"], target), "k", "v") == [(1, 2), (2, 5), (3, 1)]
    assert compact() == 1 and table() == [(1, 2), (2, 5), (3, 1)]
    assert read == [["load_batch=10", "load_batch=9"], ["load_batch=11"], ["load_batch=11"]]
    same = [p for p, files in other_buckets.items() if sorted(glob.glob(f"{target}/{p}/*.parquet")) == files]
    assert len(same) == len(other_buckets) - 1
    appended(spark, folder, 10, (2, 4), (3, 1))  # repeated, so it is compacted again, with the same rows
    assert compact(drop=True) == 1 and table() == [(1, 2), (2, 5), (3, 1)]
    assert not [n for n in os.listdir(f"{folder}/in") if n.startswith("load_batch")]
    appended(spark, folder, 12, (4, 4))
    assert compact() == 1 and table() == [(1, 2), (2, 5), (3, 1), (4, 4)]
    with pytest.raises(ValueError, match="buckets=4"):
        jobs.compact_events(spark, f"{folder}/in", target, ["k"], ["v"], buckets=5)


@pytest.mark.parametrize("dies_in", ["upsert_partitions", "touch"])
def test_a_lost_compaction_is_repeated(spark, tmp_path, monkeypatch, dies_in):
    """Right after the upsert, and before a batch is marked; equal versions are decided by the number of the batch."""
    folder, target = str(tmp_path), str(tmp_path / "out")
    for batch_id in (9, 10):
        appended(spark, folder, batch_id, (1, 1), (batch_id, batch_id))
    done = getattr(jobs, dies_in)

    def dies(*args, **options):
        if dies_in == "upsert_partitions":
            done(*args, **options)
        raise RuntimeError("driver lost")

    compact = lambda: jobs.compact_events(spark, f"{folder}/in", target, ["k"], ["v"], buckets=2)
    with monkeypatch.context() as patched:
        patched.setattr(jobs, dies_in, dies)
        with pytest.raises(RuntimeError, match="driver lost"):
            compact()
    compact()
    found = tl.read_partitions(spark, target)
    assert rows(found, "k", "v") == [(1, 1), (9, 9), (10, 10)]
    assert found.where("k = 1").first()["load_batch"].endswith("10")
