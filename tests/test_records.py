import base64
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import tableload as tl

ROW = {
    "id": "4711",
    "name": "Käseglocke mit Deckel",
    "maker": "Ærø Glas",
    "price": "18",
    "sold_on": "2023-11-30",
}


def event(*payloads):
    data = [base64.b64encode(p if isinstance(p, bytes) else json.dumps(p).encode()).decode() for p in payloads]
    return json.dumps({"Records": [{"kinesis": {"data": d}} for d in data]})


def texts(spark, *events):
    return spark.createDataFrame([(e,) for e in events], "value string")


def test_decode(spark):
    schema = StructType.fromDDL("id string, name string, price string, missing string")
    decoded = tl.decode_envelope(texts(spark, event(ROW, {"id": "2", "name": "ß", "other": "x"})), schema, ["id"])
    rows = sorted(tuple(r) for r in tl.good_records(decoded).collect())
    assert rows == [("2", "ß", None, None), ("4711", ROW["name"], "18", None)]
    assert tl.bad_records(decoded).count() == 0


def test_records_are_maps_when_no_schema_is_given(spark):
    other = {"id": "3", "ID": "4", "extra": 7, "deep": {"a": [1]}}
    decoded = tl.decode_envelope(texts(spark, event(ROW, b"[1]", b"no json", {"name": "x"}), event(other)), required=["id"])
    rows = tl.good_records(decoded)
    assert rows.columns == ["payload"]
    wanted = [ROW, {"id": "3", "ID": "4", "extra": "7", "deep": '{"a":[1]}'}]
    assert sorted([r.payload for r in rows.collect()], key=str) == sorted(wanted, key=str)
    assert tl.bad_records(decoded).count() == 3


def test_bad_records_are_kept_apart_with_their_text(spark):
    schema = StructType.fromDDL("id string, n int")
    broken = [
        b"no json",
        b'{"id": "1"',
        b"[1]",
        b"\xff\xfe",
        {"n": 1},
        {"id": None},
        {"id": "1", "n": "many"},
    ]
    no_base64 = json.dumps({"Records": [{"kinesis": {"data": "%%%"}}, {"kinesis": {}}, {}]})
    events = texts(spark, event({"id": "ok", "n": 5}, *broken), no_base64, "no event", '{"Records": []}', "{}")
    decoded = tl.decode_envelope(events, schema, ["id"])
    assert [tuple(r) for r in tl.good_records(decoded).collect()] == [("ok", 5)]
    bad = [r[0] for r in tl.bad_records(decoded).collect()]
    wanted = [base64.b64encode(b if isinstance(b, bytes) else json.dumps(b).encode()).decode() for b in broken]
    assert sorted(bad) == sorted([*wanted, "%%%", '{"kinesis":{}}', "{}", "no event", "{}"])
    with pytest.raises(Exception, match="cannot be decoded"):
        tl.only_good_records(decoded).collect()


def test_encode_is_the_inverse_and_bounds_its_events(spark):
    df = spark.range(1_000).select("id", F.concat(F.lit('q"ß\n'), "id").alias("text"))
    events = tl.encode_envelope(df, records_per_event=30)
    sizes = events.select(F.size(F.from_json("value", "Records array<string>")["Records"]).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] == 30
    back = tl.good_records(tl.decode_envelope(events, df.schema, ["id"]))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_timestamps_keep_their_microseconds(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.678901' AS a, timestamp'2024-01-02 03:04:05.000009' AS b")
    back = tl.only_good_records(tl.decode_envelope(tl.encode_envelope(df), df.schema))
    assert back.first() == df.first()
    tl.write_csv(df, str(tmp_path / "c"))
    assert tl.scan_csv(spark, str(tmp_path / "c"), schema=df.schema).first() == df.first()


def test_record_lists(spark):
    inferred = tl.records_to_table(spark, [{"b": "x", "a": 1}, {"a": 2, "c": True}])
    assert inferred.columns == ["a", "b", "c"]
    assert [tuple(r) for r in inferred.collect()] == [(1, "x", None), (2, None, True)]
    declared = tl.records_to_table(spark, [{"a": 1}], StructType.fromDDL("b string, a bigint"))
    assert [tuple(r) for r in declared.collect()] == [(None, 1)]
    with pytest.raises(Exception, match="cannot be decoded"):
        tl.records_to_table(spark, texts(spark, "oops"), StructType.fromDDL("a int")).collect()


def test_decoding_stays_in_built_in_expressions(spark):
    decoded = tl.decode_envelope(texts(spark, event(ROW)), StructType.fromDDL("id string"), ["id"])
    plan = tl.good_records(decoded)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan


def test_stamp(spark):
    df = spark.range(100, numPartitions=4).withColumn("last_upd_timestamp", F.lit("2023-04-03T23:57:11.802Z"))
    replaced = tl.stamp_load_time(df)
    assert replaced.select("last_upd_timestamp").distinct().count() == 1
    assert replaced.first().last_upd_timestamp.year > 2023
    some_unreadable = df.withColumn("last_upd_timestamp", F.expr("if(id < 10, 'soon', last_upd_timestamp)"))
    kept = tl.stamp_load_time(some_unreadable, if_absent=True)
    years = {r[0]: r[1] for r in kept.groupBy(F.year("last_upd_timestamp")).count().collect()}
    assert years.pop(2023) == 90 and list(years.values()) == [10]


def test_commit_metadata(spark):
    df = spark.range(1_000, numPartitions=4).select("id", (F.col("id") / 300).cast("int").alias("part"))
    out = tl.with_commit_metadata(df, ["id", "part"], ["part"], batch_id="b7")
    assert out.select("_commit_seqno").distinct().count() == 1_000
    row = out.where("id = 700").first()
    assert (row._record_key, row._partition_path) == ("id:700,part:2", "part=2")
    assert row._commit_seqno.startswith("b7_") and len(row._commit_time) == 17
    assert tl.with_commit_metadata(df, ["id"]).where("id = 1").first()._partition_path == ""


def test_commit_metadata_of_nulls_and_odd_partition_values(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a/b"), (1, "x", None), (1, "q=a", "b%"), (1, "", "[c]")], "k int, p string, q string")
    out = {(r.p, r.q): r for r in tl.with_commit_metadata(df, ["k", "p"], ["p", "q"]).collect()}
    null = "__HIVE_DEFAULT_PARTITION__"
    assert out[None, "a/b"]._record_key == f"k:1,p:{null}" and out["x", None]._record_key == "k:1,p:x"
    tl.append(df, str(tmp_path / "t"), partition_by=["p", "q"])
    folders = {str(f.parent.relative_to(tmp_path / "t")) for f in (tmp_path / "t").glob("*/*/*.parquet")}
    assert {r._partition_path for r in out.values()} == folders
