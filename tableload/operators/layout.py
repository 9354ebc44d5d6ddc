"""Rewriting oversized files into bounded chunks of whole rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tableload.functions.names import cols
from tableload.sources.delimited import split_session
from tableload.sources.quoted import scan_quoted_csv
from tableload.workspace import exists, move, remove

# Fixed value: bytes per rewritten chunk (128 MiB).
CHUNK_BYTES = 128 * 1024 * 1024

# A text that stands for null while a file is copied, so that empty strings stay apart from nulls.
_NO_VALUE = "\u0000"


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``path`` and ``length`` of the files below ``path``; only the listing is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def rechunk(
    spark: SparkSession,
    path: str,
    target: str,
    chunk_bytes: int = CHUNK_BYTES,
    sep: str = ",",
    format: str = "csv",
    headroom: float = 0.05,
    splittable: bool = True,
    quoted: bool = False,
    **options: str | bool,
) -> DataFrame:
    """Rewrite header CSV files as chunks of at most ``chunk_bytes``, each with the header; returns their sizes.

    ``header=False`` is for CSV without one, and ``format="text"`` copies the lines of any text file as they are.

    Each input split of that size, less ``headroom``, becomes one chunk: rows are copied where they are read, without a
    shuffle. The headroom is for the repeated header, for quoting and for the row that crosses the end of a split. A row
    that is longer than a chunk gets one of its own, which is then larger. CSV with line breaks inside quotes takes
    ``quoted=True``, which puts records that cross a split together first. Sources that cannot be split, as they are
    compressed, take ``splittable=False``, which counts their bytes in a pass of its own and deals the rows out evenly.

    The chunks are written beside the target and measured before they are moved there: a chunk that is too large for
    another reason fails the call, which then has published nothing.
    """
    if exists(spark, target):
        raise FileExistsError(target)
    split_bytes = max(1, int(chunk_bytes * (1 - headroom)))
    session = split_session(spark, split_bytes, exact=True)
    reading, writing = {}, {}
    if format == "csv":
        reading = {"header": True, "sep": sep, "nullValue": _NO_VALUE, "emptyValue": ""}
        writing = {"header": True, "sep": sep, "nullValue": "", "emptyValue": '""'}
    if quoted:
        reading.pop("header")
        rows = scan_quoted_csv(spark, path, max_partition_bytes=split_bytes, **{**reading, **options})
    else:
        rows = session.read.format(format).options(**{**reading, **options}).load(path)
    row_bytes = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 3 for c in cols(rows.columns)), F.lit(0))
    if not splittable:
        # Counted on the rows, since a compressed file says little about their size.
        total = rows.where(row_bytes <= split_bytes).agg(F.sum(row_bytes)).first()[0] or 0
        rows = rows.repartition(max(1, -(-total // split_bytes)))
    staging, observation = f"{target.rstrip('/')}.pending-{uuid.uuid4().hex}", Observation()
    writing = {**writing, **options}
    seen = rows.observe(observation, F.max(row_bytes).alias("longest"))
    seen.where(row_bytes <= split_bytes).write.format(format).options(**writing).save(staging)
    largest = file_sizes(spark, staging).agg(F.max("length")).first()[0] or 0
    if largest > chunk_bytes:
        remove(spark, staging)
        raise ValueError(f"a chunk has {largest} bytes, more than {chunk_bytes}; allow more headroom than {headroom}")
    if (observation.get["longest"] or 0) > split_bytes:
        alone = rows.where(row_bytes > split_bytes).write.mode("append").option("maxRecordsPerFile", 1)
        alone.format(format).options(**writing).save(staging)
    move(spark, staging, target)
    return file_sizes(spark, target)
