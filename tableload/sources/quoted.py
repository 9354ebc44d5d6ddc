"""Delimited files whose quoted values contain line breaks, read in splits.

Whether a line begins inside quotes depends on all lines before it. That is a prefix sum: each split counts whether its
quotes are odd, a small pass over the splits sums these up, and every split then knows whether it begins inside quotes.
Each task puts its own lines together as records. A record that reaches beyond its split leaves a beginning, maybe
middles, and an end, which are joined across the seams.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableload.sources.delimited import LARGE_FILE_SPLIT_BYTES, scan_csv, split_session
from tableload.workspace import scratch_path

#: Splits that one scan may have, as one row of each is broadcast.
MAX_SPLITS = 1_000_000

# Kinds of text that a split gives: whole records, and parts of records that reach beyond it.
_WHOLE, _END, _MIDDLE, _BEGINNING = 0, 1, 2, 3

_FIELDS = "file string, start long, kind int, text string"


def _odd_quotes(quote: str, escape: str) -> Column:
    """Whether a line has an odd number of quotes, those that are escaped by another character left out."""
    line = F.col("value")
    if escape and escape != quote:
        line = F.regexp_replace(line, F.lit(f"{re.escape(escape)}."), F.lit(""))
    return ((F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))) % 2) == 1


def scan_quoted_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    schema: StructType | None = None,
    max_partition_bytes: int = LARGE_FILE_SPLIT_BYTES,
    **options: str | bool,
) -> DataFrame:
    """Read header CSV files with line breaks inside quotes in splits of bounded size; see ``scan_csv`` for columns.

    ``scan_csv(multiLine=True)`` reads each such file in one task. Here a quote is only ever part of a quoted value, or
    escaped; the header is one line. Files are read twice, the first time for their quotes. The scan keeps what it learns
    of the splits in the scratch folder.
    """
    session = split_session(spark, max_partition_bytes)
    quote, escape = str(options.get("quote", '"')), str(options.get("escape", "\\"))
    if schema is None:
        schema = scan_csv(session, path, sep, multiLine=True, **options).schema
    texts = session.read.option("lineSep", "\n").text(path)
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = texts.select(*block, _odd_quotes(quote, escape).alias("odd"), "value")
    splits = lines.groupBy("file", "start").agg((F.count_if("odd") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = splits.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open"))
    opened = _kept(opened, "csv-splits")
    if opened.count() > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits; allow larger ones than {max_partition_bytes} bytes")
    names = schema.names

    def put_together(batches) -> Iterator[pa.RecordBatch]:
        at, inside, held, first = None, False, [], False
        for batch in batches:
            files, starts = batch.column("file").to_pylist(), batch.column("start").to_numpy()
            moved = [k for k in range(1, batch.num_rows) if starts[k] != starts[k - 1] or files[k] != files[k - 1]]
            for a, b in zip([0, *moved], [*moved, batch.num_rows], strict=True):
                if a == b:
                    continue
                found = []
                if (files[a], starts[a]) != at:
                    if held:
                        yield _rows(at, [(_MIDDLE if inside else _BEGINNING, held)])
                    at, held = (files[a], int(starts[a])), []
                    inside, first = batch.column("open")[a].as_py(), starts[a] == 0
                    within = inside
                odd = batch.column("odd").slice(a, b - a).to_numpy(zero_copy_only=False)
                values = batch.column("value").slice(a, b - a).to_pylist()
                # whether each line ends outside quotes, and so a record with it
                ends = np.flatnonzero((np.cumsum(odd) + within) % 2 == 0)
                begin = 0
                for end in ends.tolist():
                    lines = [*held, *values[begin : end + 1]]
                    found.append((_END if inside else _WHOLE, lines))
                    held, inside, begin = [], False, end + 1
                held += values[begin:]
                within = bool((odd.sum() + within) % 2)
                if first and found:
                    first, header = False, "\n".join(found.pop(0)[1]).removesuffix("\r").removeprefix("﻿")
                    given = next(csv.reader([header], delimiter=sep, quotechar=quote), [])
                    if given != names:
                        raise ValueError(f"the header {given} of {at[0]} is not {names}")
                yield _rows(at, found)
        if held:
            yield _rows(at, [(_MIDDLE if inside else _BEGINNING, held)])

    parts = lines.join(F.broadcast(opened), ["file", "start"]).select("file", "start", "odd", "open", "value")
    parts = parts.mapInArrow(put_together, _FIELDS)
    whole = parts.where(F.col("kind") == _WHOLE).select("text")
    seams = _kept(parts.where(F.col("kind") != _WHOLE), "csv-seams")
    # an end belongs to the beginning before it; in a split it comes first
    in_file = Window.partitionBy("file").orderBy("start", "kind")
    numbered = seams.withColumn("record", F.sum((F.col("kind") == _BEGINNING).cast("int")).over(in_file))
    pieces = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    joined = numbered.groupBy("file", "record").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
    records = whole.unionByName(joined.select("text")).select(F.regexp_replace("text", "\r$", "").alias("text"))
    reading = {"sep": sep, "multiLine": "true", **{k: str(v) for k, v in options.items()}}
    nullable = StructType.fromDDL(schema.toDDL().replace(" NOT NULL", ""))
    parsed = records.where(F.trim("text") != "").select(F.from_csv("text", F.lit(nullable.toDDL()), reading).alias("row"))
    return parsed.select("row.*")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """A small table in the scratch folder, so that what is learned of the files is learned once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows(at: tuple[str, int], found: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    n = len(found)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([at[0]] * n, pa.string()),
            pa.array([at[1]] * n, pa.int64()),
            pa.array([kind for kind, _ in found], pa.int32()),
            pa.array(["\n".join(lines) for _, lines in found], pa.string()),
        ],
        names=["file", "start", "kind", "text"],
    )
