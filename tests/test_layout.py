import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

import tableload as tl


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def big(spark, tmp_path):
    """One file of 30,000 lines with quotes, separators, empty strings and nulls."""
    path = str(tmp_path / "big")
    value = F.expr("CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a,b' WHEN 3 THEN 'q\"q' ELSE 'ß' END")
    df = spark.range(30_000).select("id", value.alias("v"), F.uuid().alias("text"))
    tl.write_csv(df.coalesce(1), path)
    return path


def test_rechunk_keeps_rows_and_bounds_files(spark, tmp_path, big):
    target = str(tmp_path / "chunks")
    sizes = tl.rechunk(spark, big, target, chunk_bytes=200_000)
    lengths = [r.length for r in sizes.collect()]
    total = sum(os.path.getsize(f) for f in glob.glob(f"{big}/part-*"))
    assert max(lengths) <= 200_000 and len(lengths) >= total / 200_000
    assert len(lengths) <= total / 190_000 + 2
    read = {"nullValue": "\u0000", "emptyValue": ""}
    assert rows(tl.scan_csv(spark, target, **read)) == rows(tl.scan_csv(spark, big, **read))
    assert all(open(f).readline() == "id,v,text\n" for f in glob.glob(f"{target}/part-*"))


def test_rechunk_does_not_shuffle_or_touch_the_session(spark, tmp_path, big):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    tl.rechunk(spark, big, str(tmp_path / "chunks"), chunk_bytes=500_000)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_rechunk_packs_small_files(spark, tmp_path, big):
    small = str(tmp_path / "small")
    tl.rechunk(spark, big, small, chunk_bytes=100_000)
    sizes = tl.rechunk(spark, small, str(tmp_path / "again"), chunk_bytes=1_000_000)
    assert sizes.count() <= 3 and sizes.agg(F.max("length")).first()[0] <= 1_000_000
    assert rows(tl.scan_csv(spark, str(tmp_path / "again"))) == rows(tl.scan_csv(spark, big))


def test_rechunk_of_a_file_that_cannot_be_split(spark, tmp_path):
    source = tmp_path / "in.csv"
    lines = [f'{i},"two\nlines"' for i in range(5_000)]
    source.write_text("\n".join(["id,v", *lines]) + "\n")
    options = {"multiLine": True}
    sizes = tl.rechunk(spark, str(source), str(tmp_path / "out"), 30_000, splittable=False, headroom=0.2, **options)
    assert sizes.count() > 2
    back = tl.scan_csv(spark, str(tmp_path / "out"), **options)
    assert back.count() == 5_000 and back.where("v = 'two\nlines'").count() == 5_000


def test_too_little_headroom_is_reported(spark, tmp_path, big):
    with pytest.raises(ValueError, match="headroom"):
        tl.rechunk(spark, big, str(tmp_path / "chunks"), chunk_bytes=2_000, headroom=0)
    assert not glob.glob(str(tmp_path / "chunks*"))
    assert tl.rechunk(spark, big, str(tmp_path / "chunks"), chunk_bytes=100_000).count() > 1


def test_a_row_longer_than_a_chunk_has_one_of_its_own(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("id,v\n" + "".join(f"{i},{'x' * (30_000 if i == 500 else 20)}\n" for i in range(2_000)))
    sizes = tl.rechunk(spark, str(source), str(tmp_path / "out"), 10_000, headroom=0.2)
    assert [r.length > 10_000 for r in sizes.collect()].count(True) == 1
    assert rows(tl.scan_csv(spark, str(tmp_path / "out"))) == rows(tl.scan_csv(spark, str(source)))


def test_compressed_source(spark, tmp_path):
    source = tmp_path / "in.csv.gz"
    with gzip.open(source, "wt") as f:
        f.write("id\n" + "".join(f"{i}\n" for i in range(10_000)))
    assert source.stat().st_size < 30_000
    assert tl.rechunk(spark, str(source), str(tmp_path / "out"), 30_000, splittable=False).count() >= 2
    assert tl.scan_csv(spark, str(tmp_path / "out")).count() == 10_000


def test_lines_of_any_text_file(spark, tmp_path):
    source = tmp_path / "in.dat"
    lines = [f'line {i}, "as it" is; \\ ß' for i in range(10_000)]
    source.write_text("\n".join(lines) + "\n", encoding="utf-8")
    sizes = tl.rechunk(spark, str(source), str(tmp_path / "out"), 50_000, format="text")
    assert sizes.count() > 5
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(lines)


def test_csv_without_a_header(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("".join(f"{i};x\n" for i in range(10_000)))
    sizes = tl.rechunk(spark, str(source), str(tmp_path / "out"), 20_000, sep=";", header=False)
    assert sizes.count() > 3
    assert spark.read.csv(str(tmp_path / "out"), sep=";").count() == 10_000


def test_quoted_line_breaks_are_rechunked_in_splits(spark, tmp_path):
    data = [(str(k), "a line\nand another,\n\n" + "x" * (k % 50) + "\nend", None if k % 3 else "") for k in range(2_000)]
    df = spark.createDataFrame(data, "id string, text string, note string")
    df.coalesce(1).write.options(header=True, emptyValue='""').csv(str(tmp_path / "in"))
    sizes = tl.rechunk(spark, str(tmp_path / "in"), str(tmp_path / "out"), chunk_bytes=20_000, quoted=True)
    assert sizes.count() > 5 and sizes.agg(F.max("length")).first()[0] <= 20_000
    found = tl.scan_csv(spark, str(tmp_path / "out"), multiLine=True).select("id", "text")
    assert sorted(map(tuple, found.collect())) == sorted((i, t) for i, t, _ in data)
