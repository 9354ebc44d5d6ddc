import csv
import glob

import pytest
from pyspark.sql import functions as F

import tableload as tl
from tableload.operators import states as states_module

DIRTY = [("1", "a", "10"), ("2", "a", "-2"), ("3", None, "abc"), ("3", "b", None), (None, "c", "4.5")]


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame(DIRTY, "id string, name string, price string")


def test_metrics(spark, dirty):
    analyzers = [
        tl.Size(),
        tl.Completeness("name"),
        tl.ApproxCountDistinct("name"),
        tl.Mean("price"),
        tl.Uniqueness(("id",)),
        tl.Uniqueness(("id", "name")),
        tl.NonNegative("price"),
        tl.Mean("name"),
        tl.Mean("nowhere"),
    ]
    metrics = tl.run_analyzers(dirty, analyzers)
    rows = {(r.entity, r.instance, r.name): r.value for r in tl.metrics_table(spark, metrics).collect()}
    assert rows == {
        ("Dataset", "*", "Size"): 5.0,
        ("Column", "name", "Completeness"): 0.8,
        ("Column", "name", "ApproxCountDistinct"): 3.0,
        ("Column", "price", "Mean"): pytest.approx(12.5 / 3),
        ("Column", "id", "Uniqueness"): 0.5,
        ("Multicolumn", "id,name", "Uniqueness"): 1.0,
        ("Column", "price is non-negative", "Compliance"): 0.8,
    }
    problems = {str(m.analyzer): m.problem for m in metrics if m.value is None}
    assert problems["Mean(nowhere,None)"] == "Input data does not include column nowhere!"
    assert "all input values were NULL" in problems["Mean(name,None)"]


def test_all_plain_metrics_share_one_scan(spark, tmp_path, dirty):
    from tableload.operators.quality import metric_values

    dirty.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plain = [tl.Size(), tl.Completeness("name"), tl.ApproxCountDistinct("id")]
    plain += [tl.Mean("price"), tl.NonNegative("price")]
    plan = metric_values(df, plain)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    plan = metric_values(df, [*plain, tl.Uniqueness(("id",))])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "ReadSchema: struct<id:string>" in plan


def test_empty_input(spark, dirty):
    check = tl.Check("Error", "c").has_size(lambda n: n == 0).is_complete("id").is_unique("id").is_non_negative("price")
    result = tl.verify(dirty.where("false"), [check])
    assert [r[4] for r in result.results] == ["Success", "Failure", "Failure", "Failure"]
    assert {r[2] for r in result.results} == {"Error"}
    assert [r.name for r in result.metrics_table(spark).collect()] == ["Size"]


def test_verification(spark, dirty):
    warn = tl.Check("Warning", "Accommodations").has_size(lambda n: n >= 22248).is_complete("name").is_unique("id")
    fine = tl.Check("Error", "Fine").has_size(lambda n: n == 5)
    result = tl.verify(dirty, [warn.is_non_negative("price").is_complete("nowhere"), fine])
    rows = [tuple(r) for r in result.check_table(spark).collect()]
    head = ("Accommodations", "Warning", "Warning")
    message = "Value: {} does not meet the constraint requirement!"
    assert rows == [
        (*head, "SizeConstraint(Size(None))", "Failure", message.format(5)),
        (*head, "CompletenessConstraint(Completeness(name,None))", "Failure", message.format(0.8)),
        (*head, "UniquenessConstraint(Uniqueness(List(id),None))", "Failure", message.format(0.5)),
        (
            *head,
            "ComplianceConstraint(Compliance(price is non-negative,"
            "COALESCE(CAST(price AS DECIMAL(20,10)), 0.0) >= 0,None))",
            "Failure",
            message.format(0.8),
        ),
        (
            *head,
            "CompletenessConstraint(Completeness(nowhere,None))",
            "Failure",
            "Input data does not include column nowhere!",
        ),
        ("Fine", "Error", "Success", "SizeConstraint(Size(None))", "Success", ""),
    ]


def test_a_check_is_not_changed_by_extending_it():
    check = tl.Check("Warning", "c")
    check.is_complete("a")
    assert check.constraints == ()


def test_reports(spark, tmp_path, dirty):
    result = tl.verify(dirty, [tl.Check("Warning", "c").is_unique("id").is_complete("name")])
    tl.write_reports(spark, result, str(tmp_path))
    tables = {}
    for folder in ("verification-results", "verification-results-metrics"):
        (file,) = glob.glob(f"{tmp_path}/{folder}/part-*")
        tables[folder] = sorted(csv.reader(open(file)))
    assert [row[3] for row in tables["verification-results"]] == [
        "CompletenessConstraint(Completeness(name,None))",
        "UniquenessConstraint(Uniqueness(List(id),None))",
    ]
    assert tables["verification-results-metrics"] == [
        ["Column", "id", "Uniqueness", "0.5"],
        ["Column", "name", "Completeness", "0.8"],
    ]


@pytest.mark.parametrize("rsd", [0.05, 0.02])
def test_approximate_distinct_count(spark, rsd):
    df = spark.range(50_000).select(F.xxhash64("id").alias("h"))
    (metric,) = tl.run_analyzers(df, [tl.ApproxCountDistinct("h", rsd)])
    assert abs(metric.value - 50_000) <= 3 * rsd * 50_000


def test_uniqueness_of_a_column_with_a_frequent_value(spark):
    df = spark.range(90_000).select(F.expr("if(id % 3 = 0, -1, id)").alias("k"))
    (metric,) = tl.run_analyzers(df, [tl.Uniqueness(("k",))])
    assert metric.value == pytest.approx(2 / 3)


def test_names_with_dots_and_helper_names(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "n int, `price.eur` double")
    check = tl.Check("Warning", "c").is_unique("n").is_unique("price.eur", "n").is_complete("price.eur")
    result = tl.verify(df, [check.is_non_negative("price.eur")])
    assert [r[4] for r in result.results] == ["Failure", "Success", "Success", "Success"]


def test_large_numbers_keep_their_sign(spark):
    df = spark.createDataFrame([("-20000000000",), ("20000000000",), ("-1e300",), ("x",), (None,), ("-0.5",)], "v string")
    assert tl.run_analyzers(df, [tl.NonNegative("v")])[0].value == 0.5


STATE_ANALYZERS = [
    tl.Size(),
    tl.Completeness("name"),
    tl.ApproxCountDistinct("name"),
    tl.Mean("amount"),
    tl.NonNegative("amount"),
    tl.Uniqueness(["id"]),
    tl.Uniqueness(["id", "name"]),
]


def growing(spark, rows):
    return spark.createDataFrame(rows, "day string, id int, name string, amount string")


def by_metric(metrics):
    return {str(m.analyzer): None if m.value is None else round(m.value, 9) for m in metrics}


def test_merged_states_equal_a_full_run(spark, tmp_path):
    days = {
        "d1": [("d1", k, f"n{k % 7}" if k % 5 else None, str(k - 3)) for k in range(40)],
        "d2": [("d2", k, f"n{k % 11}", "no number" if k % 4 else "2.5") for k in range(30, 60)],
        "d3": [("d3", None, None, None)] * 3,
    }
    for day, rows in days.items():
        tl.write_states(growing(spark, rows), str(tmp_path), day, STATE_ANALYZERS)
    found = by_metric(tl.metrics_from_states(spark, str(tmp_path), STATE_ANALYZERS))
    full = by_metric(tl.run_analyzers(growing(spark, [r for rows in days.values() for r in rows]), STATE_ANALYZERS))
    assert found.pop("ApproxCountDistinct(name,None)") == full.pop("ApproxCountDistinct(name,None)") == 11
    assert found == full
    tl.write_states(growing(spark, []), str(tmp_path / "none"), "d", STATE_ANALYZERS)
    empty = {m.analyzer: m.problem for m in tl.metrics_from_states(spark, str(tmp_path / "none"), STATE_ANALYZERS)}
    assert "Empty state" in empty[tl.Mean("amount")] and "Empty state" in empty[tl.Uniqueness(["id"])]


def test_a_check_over_a_growing_table_reads_new_partitions_only(spark, tmp_path, monkeypatch):
    path, states, read = str(tmp_path / "t"), str(tmp_path / "states"), []
    keep = states_module.write_states
    monkeypatch.setattr(states_module, "write_states", lambda df, *args: read.append(df.inputFiles()) or keep(df, *args))
    check = tl.Check("Error", "growing").has_size(lambda n: n == 3).is_unique("id").is_complete("name").is_non_negative("amount")
    statuses = lambda: [r[4] for r in tl.check_partitions(spark, path, states, [check]).results]
    tl.append(growing(spark, [("d1", 1, "a", "1"), ("d2", 2, None, "2")]), path, partition_by=["day"])
    assert statuses() == ["Failure", "Success", "Failure", "Success"] and len(read) == 2
    tl.append(growing(spark, [("d3", 1, "c", "-1")]), path, partition_by=["day"])
    assert statuses() == ["Success", "Failure", "Failure", "Failure"] and len(read) == 3 and "day=d3" in read[2][0]
    full = tl.verify(spark.read.parquet(path), [check])
    assert [r[4] for r in full.results] == statuses() and len(read) == 3
    tl.overwrite_partitions(growing(spark, [("d2", 7, "b", "2")]), path, ["day"])
    assert statuses() == ["Success", "Failure", "Success", "Failure"] and len(read) == 4 and "day=d2" in read[3][0]
