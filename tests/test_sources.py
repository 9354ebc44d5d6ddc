import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DecimalType,
    IntegerType,
    LongType,
    MapType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

import tableload as tl
from tableload.sources.tables import _readable, catalog_type


@pytest.fixture
def csv_file(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('id;name;price\n1;"Müller; Söhne";10\n2;;x\n', encoding="utf-8")
    return str(folder)


def test_csv_columns_are_strings(spark, csv_file):
    df = tl.scan_csv(spark, csv_file, sep=";")
    assert [f.dataType for f in df.schema] == [StringType()] * 3
    assert [tuple(r) for r in df.collect()] == [("1", "Müller; Söhne", "10"), ("2", None, "x")]


def test_csv_with_schema_checks_the_header(spark, csv_file):
    typed = tl.scan_csv(spark, csv_file, ";", StructType.fromDDL("id int, name string, price string"))
    assert typed.first().id == 1
    swapped = StructType.fromDDL("name string, id string, price string")
    with pytest.raises(Exception, match="(?i)header|field"):
        tl.scan_csv(spark, csv_file, ";", swapped).collect()


def test_csv_prunes_and_pushes_down(spark, csv_file):
    df = tl.scan_csv(spark, csv_file, ";").where("id = '1'").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string>" in plan and "EqualTo(id,1)" in plan


def test_large_csv_infers_types_and_splits(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.range(20_000).select("id", F.uuid().alias("text")).coalesce(1).write.option("header", True).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = tl.scan_large_csv(spark, path, max_partition_bytes=100_000)
    assert df.schema["id"].dataType == IntegerType()
    assert df.rdd.getNumPartitions() > tl.scan_csv(spark, path).rdd.getNumPartitions()
    assert df.join(spark.range(10), "id").count() == 10
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_large_csv_keeps_the_session_settings(spark, csv_file):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        session = tl.scan_large_csv(spark, csv_file, sep=";").sparkSession
        assert session.conf.get("spark.sql.shuffle.partitions") == "3"
        assert session.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_parquet_with_a_declared_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT 1 AS a, 'x' AS b, 2.5D AS c").write.parquet(path)
    df = tl.scan_parquet(spark, path, StructType.fromDDL("b string, a bigint, missing date"))
    assert df.schema["a"].dataType == LongType()
    assert [tuple(r) for r in df.collect()] == [("x", 1, None)]
    assert "ReadSchema: struct<b:string,a:bigint,missing:date>" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(TypeError, match="b: stored string, declared int"):
        tl.scan_parquet(spark, path, StructType.fromDDL("b int"))
    with pytest.raises(ValueError):
        tl.scan_parquet(spark, path, StructType())


def test_declared_types_match_what_the_reader_takes(spark, tmp_path):
    values = {
        "tinyint": 1, "smallint": 1, "int": 1, "bigint": 1, "float": 1.5, "double": 1.5, "string": "x",
        "boolean": True, "date": datetime.date(2024, 1, 1), "timestamp": datetime.datetime(2024, 1, 1),
        "timestamp_ntz": datetime.datetime(2024, 1, 1), "binary": bytearray(b"x"), "decimal(10,2)": Decimal("1.50"),
        "decimal(12,4)": Decimal("1.50"), "decimal(30,2)": Decimal("1.50"),
    }
    for stored, value in values.items():
        path = str(tmp_path / stored.replace("(", "_").replace(",", "_").strip(")"))
        spark.createDataFrame([(value,)], f"c {stored}").write.parquet(path)
        for declared in values:
            schema = StructType.fromDDL(f"c {declared}")
            try:
                spark.read.schema(schema).parquet(path).collect()
                works = True
            except Exception:
                works = False
            said = _readable(spark.read.parquet(path).schema[0].dataType, schema[0].dataType)
            assert works or not said, f"{stored} as {declared} is taken for readable"
    for stored, declared in [
        ("int", "bigint"),
        ("smallint", "int"),
        ("int", "double"),
        ("float", "double"),
        ("decimal(10,2)", "decimal(12,4)"),
        ("date", "timestamp_ntz"),
    ]:
        types = StructType.fromDDL(f"a {stored}, b {declared}")
        assert _readable(types["a"].dataType, types["b"].dataType)


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("int", IntegerType()),
        ("smallint", ShortType()),
        ("decimal", DecimalType(10, 0)),
        ("decimal(12,3)", DecimalType(12, 3)),
        ("array", ArrayType(StringType())),
        ("array<int>", ArrayType(IntegerType())),
        ("array<varchar(3)>", ArrayType(StringType())),
        ("map", MapType(StringType(), StringType())),
        ("struct", StructType()),
        ("struct<a:int,b:char(2)>", StructType([StructField("a", IntegerType()), StructField("b", StringType())])),
        ("varchar(10)", StringType()),
        ("uniontype<int>", StringType()),
        ("int, x string", StringType()),
        (None, StringType()),
    ],
)
def test_catalog_types(spark, text, wanted):
    assert catalog_type(text) == wanted


def test_catalog_entry(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT 1 AS id, 'x' AS code").write.parquet(path)
    columns = [{"Name": "code", "Type": "varchar(10)"}, {"Name": "id", "Type": "bigint"}, {"Name": "extra"}]
    entry = {"Table": {"StorageDescriptor": {"Columns": columns, "Location": path}}}
    assert [tuple(r) for r in tl.scan_catalog_entry(spark, entry).collect()] == [("x", 1, None)]
    for broken in (None, {}, {"Table": {}}, {"Table": {"StorageDescriptor": {"Columns": [], "Location": path}}}):
        with pytest.raises(ValueError):
            tl.scan_catalog_entry(spark, broken)
    with pytest.raises(ValueError, match="no table"):
        tl.scan_catalog_table(spark, "default", "not_there")


def test_scan_formats(spark, tmp_path):
    df = spark.sql("SELECT '1' AS a, 'x' AS b")
    for format in ("csv", "json", "orc", "parquet"):
        tl.append(df, str(tmp_path / format), format, header=True)
        assert [tuple(r) for r in tl.scan(spark, str(tmp_path / format), format).collect()] == [("1", "x")]


def test_views_and_sql(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    assert tl.scan_view(spark, "numbers").count() == 5
    result = tl.sql_transform(
        spark,
        ["CREATE OR REPLACE TEMP VIEW big AS SELECT * FROM t WHERE id > 2 ;", "SELECT id + :n AS v FROM big ;"],
        {"t": spark.range(5)},
        n=10,
    )
    assert sorted(r.v for r in result.collect()) == [13, 14]
    with pytest.raises(ValueError, match="another session"):
        tl.sql_transform(spark, "SELECT * FROM t", {"t": spark.newSession().range(3)})
    quoted = tl.sql_transform(spark, "SELECT :text AS v", text="a'; DROP TABLE t; --")
    assert quoted.first().v == "a'; DROP TABLE t; --"


def test_files_with_their_columns_in_another_order_fail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "in/b.csv").write_text("b,a\n3,4\n")
    for scan in (tl.scan_csv, tl.scan_large_csv, lambda s, p: tl.scan(s, p, "csv")):
        with pytest.raises(Exception, match="(?i)header"):
            scan(spark, str(tmp_path / "in")).collect()


def test_repeated_and_empty_column_names_are_still_read(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,a,,b1\n1,2,3,4\n")
    found = tl.scan_csv(spark, str(tmp_path / "in.csv"))
    assert [tuple(r) for r in found.collect()] == [("1", "2", "3", "4")]


def test_sql_leaves_the_callers_views_alone(spark):
    spark.range(3).createOrReplaceTempView("mine")
    result = tl.sql_transform(spark, "SELECT * FROM mine, other", {"mine": spark.range(9), "other": spark.range(2)})
    assert result.count() == 18 and spark.table("mine").count() == 3
    assert not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("mine")


@pytest.mark.parametrize("split, escape", [(64, '"'), (300, "\\"), (10_000, '"')])
def test_quoted_line_breaks_in_many_splits(spark, tmp_path, split, escape):
    """Quotes stay open over none, one or several splits; the splits cut lines, values and line ends."""
    rng = random.Random(split)
    alphabet = ["a", "b,", "\n", '"', "\r\n", "\n\n", "é", "\\", "long " * 30, " "]
    data = [(str(k), "k" + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) + "x", "end") for k in range(120)]
    data += [("200", "\n".join(["line of a value that is open for long"] * 40), "end"), ("201", 'x"', "end")]
    df = spark.createDataFrame(data, "id string, text string, `last one` string")
    for n in range(3):
        part = df.where(F.pmod(F.col("id").cast("int"), F.lit(3)) == n).coalesce(1)
        part.write.mode("append").options(header=True, escape=escape).csv(str(tmp_path / "in"))
    found = tl.scan_quoted_csv(spark, str(tmp_path / "in"), max_partition_bytes=split, escape=escape)
    assert sorted(map(tuple, found.collect())) == sorted(data)
    whole = tl.scan_csv(spark, str(tmp_path / "in"), multiLine=True, escape=escape)
    assert sorted(map(tuple, whole.collect())) == sorted(data)
    if split == 64:
        lines = spark.read.text(str(tmp_path / "in")).count()
        assert tl.scan_quoted_csv(spark, str(tmp_path / "in"), max_partition_bytes=64, escape=escape).count() == 122 < lines


def test_a_quote_open_across_three_splits(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,text\n1,"' + "y" * 30 + "\n" * 3 + "z" * 400 + '\nlast"\n2,short\n\n3,"a ""b"""\n')
    found = tl.scan_quoted_csv(spark, str(tmp_path / "in.csv"), max_partition_bytes=100, escape='"')
    assert sorted(map(tuple, found.collect())) == [("1", "y" * 30 + "\n" * 3 + "z" * 400 + "\nlast"), ("2", "short"), ("3", 'a "b"')]


def test_headers_and_types_of_quoted_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('k,v\n1,"x\ny"\n')
    (tmp_path / "in" / "b.csv").write_text("v,k\n2,z\n")
    schema = StructType.fromDDL("k int, v string")
    found = tl.scan_quoted_csv(spark, str(tmp_path / "in" / "a.csv"), schema=schema)
    assert [tuple(r) for r in found.collect()] == [(1, "x\ny")]
    with pytest.raises(Exception, match="is not"):
        tl.scan_quoted_csv(spark, str(tmp_path / "in"), schema=schema).collect()
