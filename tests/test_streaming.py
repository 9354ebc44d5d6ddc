import random

import pytest
from pyspark.sql.types import StructType

import tableload as tl
from tableload.streaming import micro_batch

ROWS = [(k, v) for k in range(20) for v in range(10)]


@pytest.fixture
def schema(spark):
    return StructType.fromDDL("k int, v int, p string")


@pytest.fixture
def source(spark, schema, tmp_path):
    """Four event files whose order says nothing about the order of the versions."""
    data = [(k, v, f"p{k % 3}") for k, v in ROWS]
    random.Random(5).shuffle(data)
    for i in range(4):
        part = spark.createDataFrame(data[i::4], schema).coalesce(1)
        tl.encode_envelope(part, 20).coalesce(1).write.mode("append").text(str(tmp_path / "events"))
    return str(tmp_path / "events")


def test_upsert_over_batches_is_upsert_over_all(spark, schema, source, tmp_path):
    target = str(tmp_path / "t")
    for _ in range(2):  # the second run finds nothing new
        query = tl.stream_upsert(
            tl.read_envelopes(spark, source, 1), target, schema, ["k"], ["v"], keep_latest=True, snapshots=True
        )
        query.awaitTermination()
    found = tl.read_snapshot(spark, target)
    assert sorted((r.k, r.v) for r in found.collect()) == [(k, 9) for k in range(20)]
    assert found.where("last_upd_timestamp IS NULL").count() == 0


def test_partitioned_target(spark, schema, source, tmp_path):
    target = str(tmp_path / "t")
    tl.stream_upsert(
        tl.read_envelopes(spark, source, 1),
        target,
        schema,
        ["k"],
        ["v"],
        keep_latest=True,
        partition_by=["p"],
    ).awaitTermination()
    assert sorted((r.k, r.v, r.p) for r in spark.read.parquet(target).collect()) == [
        (k, 9, f"p{k % 3}") for k in range(20)
    ]


def test_target_divided_by_key(spark, schema, source, tmp_path):
    target = str(tmp_path / "t")
    tl.stream_upsert(
        tl.read_envelopes(spark, source, 2), target, schema, ["k"], ["v"], True, buckets=4
    ).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == [(k, 9) for k in range(20)]


def test_a_stream_continues_a_loaded_table(spark, schema, source, tmp_path):
    target = str(tmp_path / "t")
    for k in (100, 101, 102):
        tl.upsert_snapshot(spark.createDataFrame([(k, 1, "p")], schema), target, ["k"], ["v"])
    tl.stream_upsert(
        tl.read_envelopes(spark, source), target, schema, ["k"], ["v"], True, snapshots=True, stamp=None
    ).awaitTermination()
    assert sorted(r.k for r in tl.read_snapshot(spark, target).collect()) == [*range(20), 100, 101, 102]


def test_bad_records_are_kept_or_fail_the_query(spark, schema, tmp_path):
    good = tl.encode_envelope(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema))
    spark.createDataFrame([("broken",)], "value string").union(good).coalesce(1).write.text(str(tmp_path / "events"))
    stream = tl.read_envelopes(spark, str(tmp_path / "events"))
    quarantine = str(tmp_path / "bad")
    tl.stream_upsert(
        stream, str(tmp_path / "t"), schema, ["k"], ["v"], snapshots=True, quarantine=quarantine
    ).awaitTermination()
    assert tl.read_snapshot(spark, str(tmp_path / "t")).count() == 2
    assert [r[0] for r in spark.read.parquet(quarantine).select("_bad_record").collect()] == ["broken"]
    with pytest.raises(Exception, match="cannot be decoded"):
        tl.stream_upsert(stream, str(tmp_path / "t2"), schema, ["k"], ["v"], snapshots=True).awaitTermination()


def test_append_loads_every_record_once(spark, schema, source, tmp_path):
    target = str(tmp_path / "t")
    for _ in range(2):
        tl.stream_append(
            tl.read_envelopes(spark, source, 1), target, schema, partition_by=["p"]
        ).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == sorted(ROWS)


@pytest.mark.parametrize("partitioned", [False, True], ids=["snapshot", "partitions"])
@pytest.mark.parametrize("keep_latest", [False, True], ids=["incoming", "latest"])
def test_a_batch_whose_commit_was_lost_is_replayed(
    spark, schema, source, tmp_path, monkeypatch, partitioned, keep_latest
):
    """The driver dies after the second batch is published and before the stream has recorded it."""
    name = "upsert_partitions" if partitioned else "upsert_snapshot"
    publish, calls = getattr(micro_batch, name), []

    def dies(*args, **options):
        publish(*args, **options)
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")

    def run(target):
        return tl.stream_upsert(
            tl.read_envelopes(spark, source, 1),
            str(tmp_path / target),
            schema,
            ["p", "k"],
            ["v"],
            keep_latest=keep_latest,
            partition_by=["p"] if partitioned else [],
            snapshots=not partitioned,
            stamp=None,
        )

    monkeypatch.setattr(micro_batch, name, dies)
    with pytest.raises(Exception, match="driver lost"):
        run("t").awaitTermination()
    monkeypatch.setattr(micro_batch, name, publish)
    run("t").awaitTermination()
    run("undisturbed").awaitTermination()

    def rows(target):
        path = str(tmp_path / target)
        df = spark.read.parquet(path) if partitioned else tl.read_snapshot(spark, path)
        return sorted((r.k, r.v, r.p) for r in df.collect())

    assert len(calls) == 2 and len(rows("t")) == 20
    assert rows("t") == rows("undisturbed")


def test_append_with_a_quarantine_gets_past_bad_records(spark, schema, source, tmp_path):
    spark.createDataFrame([("broken",), ("worse",)], "value string").write.mode("append").text(source)
    target, quarantine = str(tmp_path / "t"), str(tmp_path / "bad")
    for _ in range(2):
        stream = tl.read_envelopes(spark, source, 1)
        tl.stream_append(stream, target, schema, ["k"], quarantine=quarantine).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == sorted(ROWS)
    assert sorted(r[0] for r in spark.read.parquet(quarantine).select("_bad_record").collect()) == ["broken", "worse"]


def test_an_appended_batch_is_replayed(spark, schema, source, tmp_path, monkeypatch):
    """The driver dies with the bad records of a batch written and its good ones half so."""
    target, quarantine = str(tmp_path / "t"), str(tmp_path / "bad")
    write, calls = micro_batch.overwrite, []

    def dies(df, path, *args, **options):
        write(df, path, *args, **options)
        calls.append(path)
        if len(calls) == 4:
            raise RuntimeError("driver lost")

    def run():
        tl.stream_append(tl.read_envelopes(spark, source, 1), target, schema, quarantine=quarantine).awaitTermination()

    monkeypatch.setattr(micro_batch, "overwrite", dies)
    with pytest.raises(Exception, match="driver lost"):
        run()
    monkeypatch.setattr(micro_batch, "overwrite", write)
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == sorted(ROWS)


def test_a_second_query_on_a_target_is_refused(spark, schema, source, tmp_path):
    target = str(tmp_path / "t")
    start = lambda: tl.stream_upsert(
        tl.read_envelopes(spark, source, 1), target, schema, ["k"], ["v"], snapshots=True, processingTime="1 hour"
    )
    first = start()
    try:
        with pytest.raises(Exception, match="already active"):
            start()
    finally:
        first.stop()


def test_commit_columns_of_a_stream(spark, schema, source, tmp_path):
    target = str(tmp_path / "t")
    tl.stream_upsert(tl.read_envelopes(spark, source, 1), target, schema, ["k"], ["v"], True, snapshots=True, commit=True).awaitTermination()
    found = tl.read_snapshot(spark, target)
    assert found.where("_record_key = CAST(k AS STRING)").count() == 20
    assert {r._commit_seqno.split("_")[0] for r in found.collect()} <= set("0123")


def test_another_stream_format(spark, schema, tmp_path):
    good = tl.encode_envelope(spark.createDataFrame([(1, 1, "a")], schema)).withColumnRenamed("value", "body")
    good.write.json(str(tmp_path / "events"))
    stream = tl.read_envelopes(spark.newSession(), str(tmp_path / "events"), format="text", wholetext=True)
    assert stream.isStreaming
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    stream = tl.read_envelopes(spark, str(tmp_path / "events"), format="json")
    tl.stream_append(stream, str(tmp_path / "t"), schema, column="body").awaitTermination()
    spark.conf.unset("spark.sql.streaming.schemaInference")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_records_of_a_stream_without_a_schema(spark, source, tmp_path):
    decoded = tl.decode_envelope(tl.read_envelopes(spark, source))
    assert decoded.isStreaming and decoded.columns == ["payload", "_bad_record"]
