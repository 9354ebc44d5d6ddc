import glob
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

import tableload as tl
from tableload import workspace
from tableload.operators import publish
from tableload.operators.publish import snapshots

SCHEMA = "k int, p string, v int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tl.read_snapshot(spark, path) is None
    tl.upsert_snapshot(frame(spark, [(1, "a", 1), (2, "a", 1)]), path, ["k"], ["v"])
    wanted = [(1, "a", 1), (2, "b", 0), (3, "b", 1)]
    for _ in range(2):
        tl.upsert_snapshot(frame(spark, [(2, "b", 0), (3, "b", 1)]), path, ["k"], ["v"])
        assert rows(tl.read_snapshot(spark, path)) == wanted
    assert snapshots(spark, path) == [0, 1, 2]
    tl.upsert_snapshot(frame(spark, []), path, ["k"], ["v"])
    assert snapshots(spark, path) == [0, 1, 2]
    tl.drop_snapshots(spark, path, 2)
    assert snapshots(spark, path) == [1, 2]
    tl.upsert_snapshot(frame(spark, [(4, "b", 0)]), path, ["k"], ["v"], keep=1)
    assert snapshots(spark, path) == [3]


def test_an_incomplete_snapshot_is_not_read_but_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    tl.publish_snapshot(frame(spark, [(1, "a", 1)]), path)
    tl.publish_snapshot(frame(spark, [(2, "a", 1)]), path)
    os.rename(f"{path}/snapshot=1/_SUCCESS", f"{path}/snapshot=1/_started")
    assert rows(tl.read_snapshot(spark, path)) == [(1, "a", 1)]
    assert tl.publish_snapshot(frame(spark, [(3, "a", 1)]), path) == 1
    assert rows(tl.read_snapshot(spark, path)) == [(3, "a", 1)]


def test_columns_of_either_side_are_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    tl.upsert_snapshot(spark.sql("SELECT 1 AS k, 1 AS v, 'x' AS old"), path, ["k"], ["v"])
    tl.upsert_snapshot(spark.sql("SELECT 2L AS k, 2 AS v, 'y' AS new"), path, ["k"], ["v"])
    found = tl.read_snapshot(spark, path).select("k", "v", "old", "new").orderBy("k")
    assert [tuple(r) for r in found.collect()] == [(1, 1, "x", None), (2, 2, None, "y")]
    assert dict(found.dtypes)["k"] == "int"


@pytest.mark.parametrize("limit", [32 << 20, 0], ids=["broadcast", "shuffled"])
@pytest.mark.parametrize("keep_latest", [False, True])
def test_partitions(spark, tmp_path, limit, keep_latest):
    path = str(tmp_path / "t")
    options = {"keep_latest": keep_latest, "max_broadcast_bytes": limit}
    first = [(k, p, 5) for p in ("a", "b", "c", "it's") for k in range(20)]
    batch = [(1, "a", 4), (2, "a", 6), (2, "a", 7), (50, "a", 1), (3, "it's", 9), (1, "new", 1)]
    tl.upsert_partitions(frame(spark, first), path, ["k"], ["v"], ["p"], **options)
    untouched = {p: set(glob.glob(f"{path}/p={p}/*.parquet")) for p in "bc"}
    for _ in range(2):
        tl.upsert_partitions(frame(spark, batch), path, ["k"], ["v"], ["p"], **options)
    wanted = {(k, p): v for k, p, v in first}
    wanted |= {(2, "a"): 7, (50, "a"): 1, (3, "it's"): 9, (1, "new"): 1, (1, "a"): 5 if keep_latest else 4}
    stored = spark.read.schema(frame(spark, []).schema).parquet(path).select("k", "p", "v")
    assert rows(stored) == sorted((k, p, v) for (k, p), v in wanted.items())
    assert untouched == {p: set(glob.glob(f"{path}/p={p}/*.parquet")) for p in "bc"}


def test_two_partition_columns_and_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    day = F.date_add(F.lit("2024-01-01"), (F.col("id") % 2).cast("int")).alias("d")
    df = spark.range(60).select("id", (F.col("id") % 3).alias("a"), day, F.lit(1).alias("v"))
    tl.upsert_partitions(df, path, ["id"], ["v"], ["a", "d"])
    tl.upsert_partitions(df.where("id < 10").withColumn("v", F.lit(2)), path, ["id"], ["v"], ["a", "d"])
    tl.upsert_partitions(df.where("id < 0"), path, ["id"], ["v"], ["a", "d"])
    assert spark.read.parquet(path).agg(F.count("*"), F.sum("v")).first()[:] == (60, 70)


def test_partition_values_that_cannot_be_told_from_null(spark, tmp_path):
    for value in (None, ""):
        with pytest.raises(Exception, match="null record key|empty partition value"):
            tl.upsert_partitions(frame(spark, [(1, value, 1)]), str(tmp_path / "t"), ["k"], ["v"], ["p"])


def test_only_the_batch_is_shuffled_in_place(spark, tmp_path):
    """Stored rows are rewritten by the tasks that scan them, so the file count does not explode either."""
    path = str(tmp_path / "t")
    bucket = tl.key_bucket(["id"], 4).alias("bucket")
    df = spark.range(40_000).select(F.col("id").alias("k"), bucket, F.lit(1).alias("v"))
    tl.upsert_partitions(df, path, ["k"], ["v"], ["bucket"])
    for i in range(3):
        batch = df.where("k < 100").withColumn("v", F.lit(i))
        tl.upsert_partitions(batch, path, ["k"], ["v"], ["bucket"])
    assert len(glob.glob(f"{path}/bucket=*/*.parquet")) <= 16
    assert spark.read.parquet(path).agg(F.count("*"), F.sum("v")).first()[:] == (40_000, 39_900 + 200)


def test_columns_that_only_one_side_of_a_partitioned_table_has(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS tests")
    path, batch = str(tmp_path / "t"), frame(spark, [(1, "a", 1), (2, "b", 1)])
    tl.upsert_partitions(batch, path, ["k"], ["v"], ["p"], table="tests.grown")
    spark.sql("ALTER TABLE tests.grown SET TBLPROPERTIES ('made_by' = 'me')")
    untouched = glob.glob(f"{path}/p=a/*.parquet")
    tl.upsert_partitions(spark.sql("SELECT 2 AS k, 'b' AS p, 5 AS v, 'x' AS w"), path, ["k"], ["v"], ["p"], table="tests.grown")
    tl.upsert_partitions(spark.sql("SELECT 3 AS k, 'b' AS p, 2L AS z"), path, ["k"], ["k"], ["p"], table="tests.grown")
    wanted = [(1, "a", 1, None, None), (2, "b", 5, "x", None), (3, "b", None, None, 2)]
    for found in (tl.read_partitions(spark, path), spark.table("tests.grown")):
        assert rows(found.select("k", "p", "v", "w", "z")) == wanted
    assert glob.glob(f"{path}/p=a/*.parquet") == untouched
    properties = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES tests.grown").collect()}
    assert properties["made_by"] == "me"
    spark.sql("DROP TABLE tests.grown")


def test_a_published_table_by_name_gets_columns_without_being_dropped(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS tests")
    path = str(tmp_path / "t")
    tl.upsert_snapshot(spark.sql("SELECT 1 AS k, 1 AS v"), path, ["k"], ["v"], table="tests.wide")
    spark.sql("ALTER TABLE tests.wide SET TBLPROPERTIES ('made_by' = 'me')")
    tl.upsert_snapshot(spark.sql("SELECT 2 AS k, 1 AS v, 'x' AS w"), path, ["k"], ["v"], table="tests.wide")
    assert rows(spark.table("tests.wide").select("k", "v", "w")) == [(1, 1, None), (2, 1, "x")]
    assert "me" in {r.value for r in spark.sql("SHOW TBLPROPERTIES tests.wide").collect()}
    spark.sql("DROP TABLE tests.wide")


def test_names_with_dots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "`k.1` int, `p.1` string, `v.1` int")
    for _ in range(2):
        tl.upsert_partitions(df, str(tmp_path / "t"), ["k.1"], ["v.1"], ["p.1"])
        tl.upsert_snapshot(df, str(tmp_path / "s"), ["k.1"], ["v.1"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert rows(tl.read_snapshot(spark, str(tmp_path / "s"))) == rows(df)
    assert tl.with_commit_metadata(df, ["k.1"], ["p.1"]).where("_record_key = '2'").first()._partition_path == "p.1=b"


def test_merge_into_a_published_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        tl.merge_snapshot(frame(spark, [(1, "x", 1)]), path, ["k"], ["p"])
    tl.publish_snapshot(frame(spark, [(1, "a", 1), (1, "b", 2), (2, "c", 3)]), path)
    for _ in range(2):
        tl.merge_snapshot(frame(spark, [(1, "x", 9), (3, "new", 9)]), path, ["k"], ["p"])
        assert rows(tl.read_snapshot(spark, path)) == [(1, "x", 1), (1, "x", 2), (2, "c", 3), (3, "new", 9)]


@pytest.mark.parametrize("moved", ["before", "between"])
def test_a_driver_lost_while_publishing_loses_no_row(spark, tmp_path, monkeypatch, moved):
    """The partitions are ready; the driver dies before they are copied in, or with the old one deleted."""
    path = str(tmp_path / "t")
    tl.upsert_partitions(frame(spark, [(k, p, 1) for p in "ab" for k in range(10)]), path, ["k"], ["v"], ["p"])
    batch = frame(spark, [(3, "a", 2), (10, "a", 2)])

    def dies(*args, **options):
        if moved == "between":
            shutil.rmtree(f"{path}/p=a")
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patched:
        patched.setattr(publish, "overwrite_partitions", dies)
        with pytest.raises(RuntimeError, match="driver lost"):
            tl.upsert_partitions(batch, path, ["k"], ["v"], ["p"])
    tl.upsert_partitions(batch, path, ["k"], ["v"], ["p"])
    wanted = {(k, p): 1 for p in "ab" for k in range(10)} | {(3, "a"): 2, (10, "a"): 2}
    assert rows(spark.read.parquet(path).select("k", "p", "v")) == sorted((k, p, v) for (k, p), v in wanted.items())
    assert not os.path.exists(f"{path}/{publish.PENDING}")


def test_incomplete_pending_partitions_are_dropped(spark, tmp_path):
    path, batch = str(tmp_path / "t"), frame(spark, [(1, "a", 1)])
    tl.upsert_partitions(batch, path, ["k"], ["v"], ["p"])
    frame(spark, [(9, "a", 9)]).write.partitionBy("p").parquet(f"{path}/{publish.PENDING}")
    os.remove(f"{path}/{publish.PENDING}/_SUCCESS")
    tl.upsert_partitions(batch, path, ["k"], ["v"], ["p"])
    assert rows(spark.read.parquet(path)) == [(1, 1, "a")]


def test_rubbish_of_a_first_load_that_died(spark, tmp_path):
    path = str(tmp_path / "t")
    for folder in ("_temporary/0/task_1/p=a", ".spark-staging-1/p=a"):
        os.makedirs(f"{path}/{folder}")
        with open(f"{path}/{folder}/part-00000.parquet", "w") as file:
            file.write("PAR1")
    for _ in range(2):
        tl.upsert_partitions(frame(spark, [(1, "a", 1)]), path, ["k"], ["v"], ["p"])
    assert rows(spark.read.parquet(path)) == [(1, 1, "a")]


def test_many_touched_partitions(spark, tmp_path, monkeypatch):
    """Three thousand partitions of two columns: no filter grows with them, and no other folder is scanned."""
    path = str(tmp_path / "t")
    df = spark.range(3_100, numPartitions=1).select(F.col("id").alias("k"), (F.col("id") % 50).alias("a"), (F.col("id") / 50).cast("int").alias("b"), F.lit(1).alias("v"))
    tl.upsert_partitions(df, path, ["k"], ["v"], ["a", "b"])
    scanned, parts = [], publish.upsert_parts
    monkeypatch.setattr(publish, "upsert_parts", lambda stored, *args: scanned.append(stored.inputFiles()) or parts(stored, *args))
    tl.upsert_partitions(df.where("k < 3000").withColumn("v", F.lit(2)), path, ["k"], ["v"], ["a", "b"])
    assert spark.read.parquet(path).agg(F.count("*"), F.sum("v")).first()[:] == (3_100, 6_100)
    assert len(scanned[0]) == 3_000
    tl.upsert_partitions(df.where("k = 7").withColumn("v", F.lit(5)), path, ["k"], ["v"], ["a", "b"])
    assert len(scanned[1]) == 1 and "/a=7/b=0/" in scanned[1][0]


def test_commit_columns_and_a_table_by_name(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS tests")
    for name, options in (("keyed", {}), ("keyed_parts", {"partition_by": ["p"]})):
        upsert = tl.upsert_partitions if options else tl.upsert_snapshot
        for batch_id, data in enumerate([[(1, "a", 1), (2, "b/c", 1)], [(2, "b/c", 2), (3, "new", 2)]]):
            upsert(frame(spark, data), str(tmp_path / name), ["k"], ["v"], **options, batch_id=batch_id, table=f"tests.{name}")
        found = spark.table(f"tests.{name}").orderBy("k").collect()
        assert [(r.k, r.p, r.v, r._record_key, r._commit_seqno.split("_")[0]) for r in found] == [
            (1, "a", 1, "1", "0"),
            (2, "b/c", 2, "2", "1"),
            (3, "new", 2, "3", "1"),
        ]
        if options:
            assert [r._partition_path for r in found] == ["p=a", "p=b%2Fc", "p=new"]
        spark.sql(f"DROP TABLE tests.{name}")


def test_merging_leaves_no_scratch(spark, tmp_path):
    path = str(tmp_path / "t")
    tl.publish_snapshot(frame(spark, [(1, "a", 1)]), path)
    scratch = tl.scratch_path(spark, "x").rpartition("/")[0]
    before = set(os.listdir(scratch)) if os.path.exists(scratch) else set()
    for limit in (0, 1 << 20):
        tl.merge_snapshot(frame(spark, [(1, "x", 9), (2, "n", 9)]), path, ["k"], ["p"], max_broadcast_bytes=limit)
    assert set(os.listdir(scratch)) <= before


def test_recovered_partitions_are_in_the_table_by_name(spark, tmp_path, monkeypatch):
    spark.sql("CREATE DATABASE IF NOT EXISTS tests")
    path, options = str(tmp_path / "t"), {"table": "tests.recovered"}
    tl.upsert_partitions(frame(spark, [(1, "a", 1)]), path, ["k"], ["v"], ["p"], **options)

    def dies(*args, **options):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patched:
        patched.setattr(publish, "overwrite_partitions", dies)
        with pytest.raises(RuntimeError, match="driver lost"):
            tl.upsert_partitions(frame(spark, [(2, "b", 1)]), path, ["k"], ["v"], ["p"], **options)
    tl.upsert_partitions(frame(spark, [(3, "c", 1)]), path, ["k"], ["v"], ["p"], **options)
    wanted = [(1, "a", 1), (2, "b", 1), (3, "c", 1)]
    assert rows(spark.table("tests.recovered").select("k", "p", "v")) == wanted
    assert rows(spark.read.parquet(path).select("k", "p", "v")) == wanted
    spark.sql("DROP TABLE tests.recovered")


@pytest.mark.parametrize("limit", [32 << 20, 0], ids=["broadcast", "shuffled"])
@pytest.mark.parametrize("keep_latest", [False, True], ids=["incoming", "latest"])
def test_keys_that_move_between_partitions(spark, tmp_path, limit, keep_latest):
    """Only the partitions a key leaves and enters are rewritten; one that loses its last row goes."""
    spark.sql("CREATE DATABASE IF NOT EXISTS tests")
    path, name = str(tmp_path / "t"), f"tests.moved{limit}{keep_latest}".lower()
    options = {"keep_latest": keep_latest, "max_broadcast_bytes": limit, "unique_across_partitions": True, "table": name}
    options |= {"locator_buckets": 4}
    first = {k: (p, 5) for k, p in zip(range(30), "abcde" * 6, strict=True)} | {77: ("lone", 5)}
    tl.upsert_partitions(frame(spark, [(k, p, v) for k, (p, v) in first.items()]), path, ["k"], ["v"], ["p"], **options)
    untouched = {p: set(glob.glob(f"{path}/p={p}/*.parquet")) for p in "de"}
    batch = {0: ("b", 6), 1: ("new", 7), 2: ("a", 4), 77: ("c", 9), 99: ("a", 1)}
    for _ in range(2):
        tl.upsert_partitions(frame(spark, [(k, p, v) for k, (p, v) in batch.items()]), path, ["k"], ["v"], ["p"], **options)
    wanted = first | {k: pv for k, pv in batch.items() if not (keep_latest and k in first and first[k][1] > pv[1])}
    shown = sorted((k, p, v) for k, (p, v) in wanted.items())
    assert rows(spark.read.parquet(path).select("k", "p", "v")) == shown
    assert rows(spark.table(name).select("k", "p", "v")) == shown
    assert untouched == {p: set(glob.glob(f"{path}/p={p}/*.parquet")) for p in "de"}
    assert not os.path.exists(f"{path}/p=lone")
    again = {1: ("d", 8), 77: ("e", 10), 2: ("a", 9)}
    tl.upsert_partitions(frame(spark, [(k, p, v) for k, (p, v) in again.items()]), path, ["k"], ["v"], ["p"], **options)
    shown = sorted((k, p, v) for k, (p, v) in (wanted | again).items())
    assert rows(spark.read.parquet(path).select("k", "p", "v")) == shown
    with pytest.raises(ValueError, match="unique by"):
        tl.upsert_partitions(frame(spark, [(1, "a", 1)]), path, ["k"], ["v"], ["p"])
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("dies_in", ["overwrite_partitions", "_place", "_show"])
def test_a_driver_lost_while_keys_move(spark, tmp_path, monkeypatch, dies_in):
    """Before the copy, before the locator learns of it, and before the catalog does."""
    spark.sql("CREATE DATABASE IF NOT EXISTS tests")
    path = str(tmp_path / "t")
    options = {"unique_across_partitions": True, "table": "tests.lost", "locator_buckets": 2}
    tl.upsert_partitions(frame(spark, [(1, "a", 1), (2, "b", 1)]), path, ["k"], ["v"], ["p"], **options)

    def dies(*args, **kwargs):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patched:
        patched.setattr(publish, dies_in, dies)
        with pytest.raises(RuntimeError, match="driver lost"):
            tl.upsert_partitions(frame(spark, [(1, "c", 2)]), path, ["k"], ["v"], ["p"], **options)
    tl.upsert_partitions(frame(spark, [(1, "d", 3)]), path, ["k"], ["v"], ["p"], **options)
    for found in (spark.read.parquet(path), spark.table("tests.lost")):
        assert rows(found.select("k", "p", "v")) == [(1, "d", 3), (2, "b", 1)]
    spark.sql("DROP TABLE tests.lost")


@pytest.mark.parametrize("limit", [32 << 20, 0], ids=["broadcast", "shuffled"])
def test_merge_into_partitions(spark, tmp_path, limit, monkeypatch):
    path, options = str(tmp_path / "t"), {"max_broadcast_bytes": limit}
    first = [(k, p, 1) for p in "abcd" for k in range(4)] + [(9, "b", 1), (None, "d", 1)]
    with pytest.raises(ValueError, match="no table|not partitioned|PATH"):
        tl.merge_partitions(frame(spark, []), path, ["k"], ["v"], ["p"])
    tl.overwrite(frame(spark, first), path, partition_by=["p"])
    untouched = {p: set(glob.glob(f"{path}/p={p}/*.parquet")) for p in "acd"}
    source = spark.sql("SELECT 9 AS k, 5 AS v UNION ALL SELECT 50, 5 UNION ALL SELECT NULL, 7")
    tl.merge_partitions(source, path, ["k"], ["v"], ["p"], insert=False, **options)
    wanted = {(k, p): v for k, p, v in first} | {(9, "b"): 5}
    found = lambda: sorted(map(tuple, spark.read.parquet(path).select("k", "p", "v").collect()), key=str)
    assert found() == sorted(((k, p, v) for (k, p), v in wanted.items()), key=str)
    assert untouched == {p: set(glob.glob(f"{path}/p={p}/*.parquet")) for p in "acd"}
    with pytest.raises(ValueError, match="lacks"):
        tl.merge_partitions(source, path, ["k"], ["v"], ["p"])
    with pytest.raises(ValueError, match="does not change"):
        tl.merge_partitions(source, path, ["k"], ["p"], ["p"], insert=False)

    def dies(*args, **kwargs):
        raise RuntimeError("driver lost")

    merge = lambda: tl.merge_partitions(frame(spark, [(9, "z", 6), (60, "e", 6), (61, "a", 6)]), path, ["k"], ["v"], ["p"], **options)
    with monkeypatch.context() as patched:
        patched.setattr(publish, "overwrite_partitions", dies)
        with pytest.raises(RuntimeError, match="driver lost"):
            merge()
    merge()
    wanted |= {(9, "b"): 6, (60, "e"): 6, (61, "a"): 6}
    assert found() == sorted(((k, p, v) for (k, p), v in wanted.items()), key=str)
    assert untouched["c"] == set(glob.glob(f"{path}/p=c/*.parquet"))


def test_rows_since_a_commit_skip_older_files(spark, tmp_path):
    path = str(tmp_path / "t")
    instants = []
    for batch_id, data in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "b", 2), (3, "c", 2)], [(3, "c", 3)]]):
        tl.upsert_partitions(frame(spark, data), path, ["k"], ["v"], ["p"], batch_id=batch_id)
        instants.append(spark.read.parquet(path).agg(F.max("_commit_instant")).first()[0])
    assert rows(tl.rows_since(spark, path, 0).select("k", "v")) == [(1, 1), (2, 2), (3, 3)]
    assert rows(tl.rows_since(spark, path, instants[0]).select("k", "v")) == [(2, 2), (3, 3)]
    assert rows(tl.rows_since(spark, path, instants[0], instants[1]).select("k", "v")) == [(2, 2)]
    plan = tl.rows_since(spark, path, instants[0])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(_commit_instant" in plan


def test_changes_are_counted(spark, tmp_path):
    for limit in (32 << 20, 0):
        for upsert, more in ((tl.upsert_snapshot, {}), (tl.upsert_partitions, {"partition_by": ["p"]})):
            path = str(tmp_path / f"{upsert.__name__}{limit}")
            options = {**more, "count": True, "keep_latest": True, "max_broadcast_bytes": limit}
            first = upsert(frame(spark, [(1, "a", 5), (2, "a", 5), (2, "a", 4)]), path, ["k"], ["v"], **options)
            second = upsert(frame(spark, [(1, "a", 6), (2, "a", 1), (3, "a", 1), (3, "a", 2)]), path, ["k"], ["v"], **options)
            assert (first.inserted, first.replaced, first.outdated) == (2, 0, 0)
            assert (second.inserted, second.replaced, second.outdated) == (1, 1, 1)


def test_another_session_is_refused_while_one_writes(spark, tmp_path):
    path, other = str(tmp_path / "t"), spark.newSession()
    batch = lambda session: session.createDataFrame([(1, "a", 1)], SCHEMA)
    with tl.writer(spark, path):
        tl.upsert_partitions(batch(spark), path, ["k"], ["v"], ["p"])
        for write in (
            lambda: tl.upsert_partitions(batch(other), path, ["k"], ["v"], ["p"]),
            lambda: tl.merge_partitions(batch(other), path, ["k"], ["v"], ["p"]),
            lambda: tl.upsert_snapshot(batch(other), path, ["k"], ["v"]),
            lambda: tl.merge_snapshot(batch(other), path, ["k"], ["v"]),
        ):
            with pytest.raises(tl.LeaseError, match="another session"):
                write()
    tl.upsert_partitions(batch(other), path, ["k"], ["v"], ["p"])
    assert not os.path.exists(f"{path}.writer")


def test_a_stale_lease_is_taken_over_and_a_lost_one_noticed(spark, tmp_path):
    path, other = str(tmp_path / "t"), spark.newSession()
    dead = workspace.Lease(other, path, seconds=-1)
    dead.take()  # its driver dies without a trace
    with tl.writer(spark, path) as lease:
        lease.check()
        with pytest.raises(tl.LeaseError, match="lost"):
            dead.check()
    dead.release()
    with tl.writer(other, path):
        pass


def test_a_lease_is_renewed(spark, tmp_path):
    path, other = str(tmp_path / "t"), spark.newSession()
    with tl.writer(spark, path, seconds=1.0):
        time.sleep(1.6)
        with pytest.raises(tl.LeaseError):
            workspace.Lease(other, path).take()


def test_rewritten_partitions_are_moved_and_a_move_cut_off_is_finished(spark, tmp_path, monkeypatch):
    """The files that were written out are the ones of the table; the driver dies with one of three partitions moved."""
    path, options = str(tmp_path / "t"), {"unique_across_partitions": True, "locator_buckets": 2}
    first = [(k, p, 1) for k, p in enumerate("aabbcd")]
    tl.upsert_partitions(frame(spark, first), path, ["k"], ["v"], ["p"], **options)
    batch = frame(spark, [(0, "a", 2), (2, "c", 2), (5, "b", 2)])  # the last row of d goes
    move, moved, written = publish.replace_folder, [], []

    def dies(spark, folder, target):
        written.extend(os.path.basename(f) for f in glob.glob(f"{path}/{publish.PENDING}/p=*/*.parquet"))
        if moved:
            raise RuntimeError("driver lost")
        move(spark, folder, target)
        moved.append(target)

    with monkeypatch.context() as patched:
        patched.setattr(publish, "replace_folder", dies)
        with pytest.raises(RuntimeError, match="driver lost"):
            tl.upsert_partitions(batch, path, ["k"], ["v"], ["p"], **options)
    assert os.path.exists(moved[0]) and not os.path.exists(f"{path}/p=d")
    tl.upsert_partitions(frame(spark, []), path, ["k"], ["v"], ["p"], **options)
    wanted = [(0, "a", 2), (1, "a", 1), (2, "c", 2), (3, "b", 1), (4, "c", 1), (5, "b", 2)]
    assert rows(spark.read.parquet(path).select("k", "p", "v")) == wanted
    assert {os.path.basename(f) for f in glob.glob(f"{path}/p=*/*.parquet")} == set(written)
    tl.upsert_partitions(frame(spark, [(5, "a", 3)]), path, ["k"], ["v"], ["p"], **options)
    assert rows(spark.read.parquet(path).select("k", "p", "v")) == wanted[:5] + [(5, "a", 3)]


@pytest.mark.parametrize("upsert", [tl.upsert_snapshot, tl.upsert_partitions])
@pytest.mark.parametrize("limit", [32 << 20, 0], ids=["broadcast", "shuffled"])
def test_commit_columns_are_filled_in_as_rows_are_written(spark, tmp_path, monkeypatch, upsert, limit):
    """The texts of a batch's commit columns are neither staged nor shuffled."""
    path = str(tmp_path / "t")
    options = {"keep_latest": True, "max_broadcast_bytes": limit}
    options |= {"partition_by": ["p"]} if upsert is tl.upsert_partitions else {}
    upsert(frame(spark, [(1, "a", 5), (2, "b", 5)]), path, ["k"], ["v"], **options)  # without commit columns
    upsert(frame(spark, [(3, "a", 5), (4, "b", 5)]), path, ["k"], ["v"], **options, batch_id="x")
    staged, stage = [], publish.stage
    monkeypatch.setattr(publish, "stage", lambda *args: staged.append(stage(*args)) or staged[-1])
    seen, publishes = [], publish.upsert_parts
    monkeypatch.setattr(publish, "upsert_parts", lambda t, s, *args: seen.extend(s.rows.collect()) or publishes(t, s, *args))
    upsert(frame(spark, [(2, "b", 6), (3, "a", 4), (4, "b", 5), (9, "a", 1)]), path, ["k"], ["v"], **options, batch_id="y")
    assert len(seen) == 4 and {(r._record_key, r._partition_path, r._commit_time) for r in seen} == {(None, None, None)}
    stored = tl.read_snapshot(spark, path) if upsert is tl.upsert_snapshot else tl.read_partitions(spark, path)
    found = {r.k: (r.v, r._record_key, r._commit_seqno, r._partition_path) for r in stored.collect()}
    by = {k: None if r[2] is None else r[2].split("_")[0] for k, r in found.items()}
    assert {k: r[:2] for k, r in found.items()} == {1: (5, None), 2: (6, "2"), 3: (5, "3"), 4: (5, "4"), 9: (1, "9")}
    assert by == {1: None, 2: "y", 3: "x", 4: "y", 9: "y"}
    assert len({r[2] for r in found.values()}) == 5
    assert found[9][3] == ("p=a" if upsert is tl.upsert_partitions else "")
    assert stored.where("_commit_time <> CAST(_commit_instant AS STRING)").count() == 0


def test_keys_elsewhere_are_looked_up_without_the_batch(spark, tmp_path, monkeypatch):
    """A large batch whose partitions hold most keys: the few others are sent to it, and all is found as before."""
    path = str(tmp_path / "t")
    options = {"unique_across_partitions": True, "locator_buckets": 2}
    tl.upsert_partitions(frame(spark, [(k, "abc"[k % 3], 1) for k in range(30)]), path, ["k"], ["v"], ["p"], **options)
    looked_up, left = [], publish._left

    def watched(*args):
        found = left(*args)
        looked_up.append(({r[0] for r in found.collect()}, found._jdf.queryExecution().executedPlan().toString()))
        return found

    monkeypatch.setattr(publish, "_left", watched)
    batch = [(k, "ab"[k % 2], 2) for k in range(5, 40)]
    monkeypatch.setattr(publish.Staged, "fits", lambda self, limit: False)
    tl.upsert_partitions(frame(spark, batch), path, ["k"], ["v"], ["p"], **options)
    partitions, plan = looked_up[0]
    assert partitions == {"c"}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    wanted = {k: ("abc"[k % 3], 1) for k in range(5)} | {k: (p, v) for k, p, v in batch}
    assert rows(spark.read.parquet(path).select("k", "p", "v")) == sorted((k, p, v) for k, (p, v) in wanted.items())
