import random

import pytest
from pyspark.sql import functions as F

import tableload as tl
from tableload.operators.keyed import bitmap_size, by_bitmap, stage

SCHEMA = "k int, v int, text string"
BOTH = pytest.mark.parametrize("limit", [128 << 20, 0], ids=["broadcast", "shuffled"])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema).repartition(3)


def numbered(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v"), F.lit("a").alias("text"))


def random_rows(seed, n, keys):
    r = random.Random(seed)
    return [(r.randrange(keys), r.randrange(5), r.choice("abc")) for _ in range(n)]


def latest(data):
    best = {}
    for row in data:
        if row[0] not in best or row[1:] > best[row[0]][1:]:
            best[row[0]] = row
    return best


@pytest.mark.parametrize("seed", range(3))
def test_dedupe(spark, seed):
    data = random_rows(seed, 200, 30)
    assert rows(tl.dedupe_batch(frame(spark, data), ["k"], ["v"])) == rows_of(latest(data).values())


def rows_of(data):
    return sorted(map(tuple, data), key=repr)


def test_dedupe_takes_nulls_as_smallest_and_keeps_them(spark):
    df = frame(spark, [(1, None, "a"), (1, 3, None), (2, None, None)])
    assert rows(tl.dedupe_batch(df, ["k"], ["v"])) == rows_of([(1, 3, None), (2, None, None)])


def test_dedupe_with_columns_that_have_no_order(spark):
    df = spark.createDataFrame([(1, 1, {"a": 1}), (1, 2, {"b": 2})], "k int, v int, m map<string,int>")
    assert [tuple(r) for r in tl.dedupe_batch(df, ["k"], ["v"]).collect()] == [(1, 2, {"b": 2})]


def test_dedupe_reduces_a_frequent_key_before_the_shuffle(spark):
    df = spark.range(100_000, numPartitions=4).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    result = tl.dedupe_batch(df, ["k"], ["v"])
    assert rows(result) == [(1, 99_999)]
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max") > plan.index("Exchange")  # below the exchange


def test_dedupe_parallelism(spark):
    df = frame(spark, random_rows(1, 200, 30))
    result = tl.dedupe_batch(df, ["k"], ["v"], parallelism=2)
    assert result.rdd.getNumPartitions() == 2
    assert rows(result) == rows(tl.dedupe_batch(df, ["k"], ["v"]))


def test_null_keys_are_refused(spark):
    df = frame(spark, [(None, 1, "a")])
    with pytest.raises(Exception, match="null record key"):
        tl.dedupe_batch(df, ["k"], ["v"]).collect()
    with pytest.raises(Exception, match="null record key"):
        tl.upsert(frame(spark, [(1, 1, "a")]), df, ["k"], ["v"])


@BOTH
@pytest.mark.parametrize("seed", range(3))
def test_upsert(spark, limit, seed):
    stored, batch = latest(random_rows(seed, 40, 30)), random_rows(seed + 50, 40, 45)
    target, source = frame(spark, list(stored.values())), frame(spark, batch)
    once = tl.upsert(target, source, ["k"], ["v"], max_broadcast_bytes=limit)
    assert rows(once) == rows_of({**stored, **latest(batch)}.values())
    assert rows(tl.upsert(once, source, ["k"], ["v"], max_broadcast_bytes=limit)) == rows(once)


@BOTH
@pytest.mark.parametrize("seed", range(3))
def test_upsert_keep_latest(spark, limit, seed):
    stored, batch = latest(random_rows(seed, 40, 30)), random_rows(seed + 50, 40, 45)
    target, source = frame(spark, list(stored.values())), frame(spark, batch)
    options = {"keep_latest": True, "max_broadcast_bytes": limit}
    wanted = dict(stored)
    for k, row in latest(batch).items():
        if k not in wanted or row[1] >= wanted[k][1]:
            wanted[k] = row
    once = tl.upsert(target, source, ["k"], ["v"], **options)
    assert rows(once) == rows_of(wanted.values())
    assert rows(tl.upsert(once, source, ["k"], ["v"], **options)) == rows(once)


def test_upsert_with_an_empty_side(spark):
    some, none = frame(spark, [(1, 1, "a")]), frame(spark, [])
    assert rows(tl.upsert(some, none, ["k"], ["v"])) == [(1, 1, "a")]
    assert rows(tl.upsert(none, some, ["k"], ["v"])) == [(1, 1, "a")]


def test_upsert_takes_the_types_and_refuses_other_columns_of_the_target(spark):
    target = frame(spark, [(1, 1, "a")])
    batch = spark.createDataFrame([("b", 2, 1)], "text string, v bigint, k bigint")
    result = tl.upsert(target, batch, ["k"], ["v"])
    assert result.schema == target.schema and rows(result) == [(1, 2, "b")]
    with pytest.raises(ValueError, match="differ"):
        tl.upsert(target, batch.withColumn("more", F.lit(1)), ["k"], ["v"])


def test_a_batch_is_computed_once(spark):
    target = frame(spark, [(1, 0, "a")])
    batch = target.select("k", F.floor(F.rand() * 1_000_000).cast("int").alias("v"), "text")
    result = tl.upsert(target, batch, ["k"], ["v"])
    assert rows(result) == rows(result)


def test_broadcast_follows_the_measured_size(spark):
    target = numbered(spark, 1_000)
    staged = stage(target, "x", ["k", "text"])
    assert staged.count == 1_000 and staged.fits(100_000) and not staged.fits(10_000)
    assert stage(spark.range(2).select(F.array("id").alias("a")), "x", ["a"]).bytes is None

    def plan(limit):
        return tl.upsert(target, target, ["k"], ["v"], max_broadcast_bytes=limit)._jdf.queryExecution().executedPlan()

    small, large = plan(1 << 20).toString(), plan(0).toString()
    assert "BroadcastHashJoin" in small and "Exchange hashpartitioning" not in small
    assert "SortMergeJoin" in large and "Broadcast" not in large


@pytest.mark.parametrize("keep_latest", [False, True])
def test_a_bucketed_target_is_not_shuffled(spark, keep_latest):
    spark.sql("CREATE DATABASE IF NOT EXISTS tests")
    df = numbered(spark, 3_000)
    tl.bulk_load_table(df.union(df.withColumn("v", F.lit(0))), "tests.bucketed", ["k"], ["v"], buckets=4)
    target = spark.table("tests.bucketed")
    batch = df.where("k % 2 = 0").withColumn("v", F.lit(0)).union(df.withColumn("k", F.col("k") + 3_000))
    result = tl.upsert(target, batch, ["k"], ["v"], keep_latest, max_broadcast_bytes=0)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    assert result.agg(F.count("*"), F.sum("v")).first()[:] == (6_000, 6_000 if keep_latest else 4_500)
    spark.sql("DROP TABLE tests.bucketed")


def merged_by_hand(target, source, insert=True):
    by_key = {}
    for row in source:
        by_key.setdefault(row[0], []).append(row)
    out = []
    for k, v, text in target:
        match = by_key.get(k, []) if k is not None else []
        out.append((k, v, match[0][2]) if match else (k, v, text))
    stored = {row[0] for row in target if row[0] is not None}
    return out + ([row for row in source if row[0] not in stored] if insert else [])


@BOTH
@pytest.mark.parametrize("seed", range(3))
def test_merge(spark, limit, seed):
    target = [*random_rows(seed, 60, 20), (None, 1, "n")]
    repeated = [(None, 2, "s"), (None, 2, "s"), (99, 1, "x"), (99, 2, "y")]
    source = [*latest(random_rows(seed + 50, 40, 45)).values(), *repeated]
    for insert in (True, False):
        result = tl.merge_into(
            frame(spark, target), frame(spark, source), ["k"], ["text"], insert=insert, max_broadcast_bytes=limit
        )
        assert rows(result) == rows_of(merged_by_hand(target, source, insert))


@BOTH
def test_merge_with_an_empty_source_is_the_identity(spark, limit):
    target = random_rows(1, 30, 10)
    result = tl.merge_into(frame(spark, target), frame(spark, []), ["k"], ["v"], max_broadcast_bytes=limit)
    assert rows(result) == rows_of(target)


@BOTH
def test_merge_refuses_several_matches(spark, limit):
    target, source = frame(spark, [(1, 1, "a")]), frame(spark, [(1, 2, "b"), (1, 3, "c")])
    with pytest.raises(ValueError, match="several source rows"):
        tl.merge_into(target, source, ["k"], ["v"], max_broadcast_bytes=limit)


def test_merge_does_not_shuffle_the_target_for_a_small_source(spark, tmp_path):
    numbered(spark, 10_000).write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    result = tl.merge_into(target, frame(spark, [(1, 2, "b")]), ["k"], ["v"])
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3
    # The second look at the target reads its key only.
    assert "ReadSchema: struct<k:int>" in plan


def test_a_frequent_merge_key_is_split(spark):
    """Shuffled, a key with most of the target is joined by several tasks."""
    key = F.expr("if(id % 3 = 0, 7, id)").cast("int").alias("k")
    target = spark.range(300_000, numPartitions=4).select(key, F.lit(1).alias("v"), F.uuid().alias("text"))
    source = numbered(spark, 400_000).where("k % 2 = 0")
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        result = tl.merge_into(target, source, ["k"], ["text"], insert=False, max_broadcast_bytes=0)
        task = F.spark_partition_id().alias("task")
        counted = result.groupBy(task).agg(F.count_if(F.col("k") == 7).alias("n"), F.max("text"))
        counts = [r.n for r in counted.where("n > 0").collect()]
        assert sum(counts) == 100_001 and len(counts) > 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_bulk_load(spark, tmp_path):
    path, data = str(tmp_path / "t"), random_rows(3, 100, 20)
    for _ in range(2):
        tl.bulk_load(frame(spark, data), path, ["k"], ["v"])
    assert rows(spark.read.parquet(path)) == rows_of(latest(data).values())


@BOTH
def test_names_with_dots_and_helper_names(spark, limit):
    """Column names of loaded files are taken as they are, also those used inside."""
    schema = "`k.1` int, n int, `a``b` string, _rows int"
    target = spark.createDataFrame([(1, 1, "x", 1), (2, 1, "x", 1)], schema)
    batch = spark.createDataFrame([(2, 2, "y", 2), (3, 2, "y", 2)], schema)
    key, options = ["k.1", "n"], {"max_broadcast_bytes": limit}
    for keep_latest in (False, True):
        result = tl.upsert(target, batch, ["k.1"], ["n"], keep_latest, **options)
        assert rows(result) == [(1, 1, "x", 1), (2, 2, "y", 2), (3, 2, "y", 2)]
    result = tl.merge_into(target, batch.withColumn("n", F.lit(1)), key, ["a`b", "_rows"], **options)
    assert rows(result) == [(1, 1, "x", 1), (2, 1, "y", 2), (3, 1, "y", 2)]


def test_one_name_needs_no_list(spark, tmp_path):
    schema = "code int, val int, part string"
    target = spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], schema)
    batch = spark.createDataFrame([(2, 2, "a"), (2, 1, "a"), (3, 1, "b")], schema)
    wanted = [(1, 1, "a"), (2, 2, "a"), (3, 1, "b")]
    assert rows(tl.dedupe_batch(batch, "code", "val")) == wanted[1:]
    assert rows(tl.upsert(target, batch, "code", "val")) == wanted
    assert rows(tl.merge_into(target, batch.where("code = 3"), "code", "val")) == [*rows(target), (3, 1, "b")]
    for df in (target, batch):
        tl.upsert_partitions(df, str(tmp_path / "p"), "code", "val", "part")
        tl.upsert_snapshot(df, str(tmp_path / "s"), "code", "val")
    assert rows(spark.read.parquet(str(tmp_path / "p")).select("code", "val", "part")) == wanted
    assert rows(tl.read_snapshot(spark, str(tmp_path / "s"))) == wanted
    metrics = tl.run_analyzers(target, [tl.Uniqueness("code"), tl.Uniqueness(["code", "val"])])
    assert [m.value for m in metrics] == [1, 1]


@pytest.mark.parametrize("keep_latest", [False, True], ids=["incoming", "latest"])
def test_a_bitmap_of_a_large_batch_keeps_other_rows_from_the_shuffle(spark, keep_latest):
    """The keys are too large to broadcast, their bitmap is not; it rules out nearly all rows without a match."""
    target = numbered(spark, 20_000)
    batch = numbered(spark, 1_000).withColumn("v", F.lit(-1)).withColumn("k", F.col("k") * 40)
    staged = stage(batch, "batch", ["k"])
    limit = 16 << 10
    assert not staged.fits(limit) and bitmap_size(staged.count, limit) == 32_768
    sure, maybe = by_bitmap(target, staged.rows, ["k"], staged.count, limit)
    assert sure.columns == maybe.columns == target.columns
    matches = target.join(staged.rows.select("k"), "k", "left_semi").count()
    assert matches <= maybe.count() <= matches + 20_000 // 16 and sure.count() + maybe.count() == 20_000
    assert sure.join(staged.rows, "k", "left_semi").isEmpty()
    found = {x: tl.upsert(target, batch, ["k"], ["v"], keep_latest, max_broadcast_bytes=x) for x in (limit, 0, 1 << 20)}
    rows = {x: sorted(map(tuple, df.collect())) for x, df in found.items()}
    assert rows[limit] == rows[0] == rows[1 << 20]
    merge = {x: tl.merge_into(target, batch, ["k"], ["v"], max_broadcast_bytes=x) for x in (limit, 0)}
    rows = {x: sorted(map(tuple, df.collect())) for x, df in merge.items()}
    assert rows[limit] == rows[0]


def test_bitmaps_have_bounds(spark):
    assert bitmap_size(1, 1 << 20) == 32_768 and bitmap_size(10, 0) is None
    assert bitmap_size(1 << 40, 1 << 40) is None and bitmap_size(1 << 28, 1 << 40) == 1 << 29
    clashing = spark.range(10).selectExpr("id AS k", "1 AS _block", "2 AS _bits", "3 AS _bit")
    sure, maybe = by_bitmap(clashing, spark.range(3).withColumnRenamed("id", "k"), ["k"], 3, 1 << 20)
    assert sorted(map(tuple, sure.union(maybe).collect())) == [(k, 1, 2, 3) for k in range(10)]
