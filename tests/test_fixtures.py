import glob

from pyspark.sql import functions as F

import __spark_entry__ as registry


def test_files_of_events_grow_slower_than_the_events(spark, tmp_path, monkeypatch):
    """A file is a micro-batch: no more than one per ``FILE_ROWS`` events, and four at least."""
    stamp = F.timestamp_seconds(F.col("id")).alias("ts")
    events = spark.range(130_000).select(F.col("id").alias("event_id"), stamp, F.lit(1).cast("long").alias("user_id"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    files = registry.event_files(spark, str(tmp_path))
    assert len(glob.glob(f"{files}/part-*")) == 4
    assert spark.read.text(files).count() == 130_000


def test_fixture_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(registry, "FILE_ROWS", 1_000)
    dealt = registry.in_files(spark.range(10_000), 10_000, 3)
    assert dealt.rdd.getNumPartitions() == 10
    assert max(dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 1_100


def test_rechunked_input_grows_in_files(spark, tmp_path, monkeypatch):
    """The input of the rechunk query was three files of any size."""
    monkeypatch.setattr(registry, "FILE_ROWS", 1_000)
    seen, rechunk = [], registry.tl.rechunk
    monkeypatch.setattr(registry.tl, "rechunk", lambda s, source, *a, **o: seen.append(source) or rechunk(s, source, *a, **o))
    assert registry.rechunk_rows(spark, "/root/testdata/sf0.001").count() == 6_000
    assert len(glob.glob(f"{seen[0]}/part-*")) == 6
