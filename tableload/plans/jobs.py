"""Whole loads, from a source to a table: what a scheduled job calls with its parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableload.functions.columns import LOAD_COLUMN, stamp_load_time
from tableload.functions.names import Names, names_of
from tableload.operators import writes
from tableload.operators.keyed import Changes, bulk_load, committed, dedupe_batch, stage
from tableload.operators.publish import (
    key_bucket,
    publish_snapshot,
    read_partitions,
    upsert_partitions,
    upsert_snapshot,
)
from tableload.operators.quality import Check, Verification, verify, write_reports
from tableload.operators.tables import create_table, insert_by_name
from tableload.sources.delimited import scan_csv
from tableload.sources.records import BAD_RECORD, PAYLOAD, decode_envelope
from tableload.sources.tables import scan, scan_catalog_entry
from tableload.streaming.micro_batch import BATCH_COLUMN, BUCKET_COLUMN, LoadCounts, load_records, one_way
from tableload.workspace import exists, file_names, remove, subfolders, touch

# Hidden folders: marks of the batches that are compacted, beside them, and of how a compacted table is divided.
COMPACTED, COMPACTION = "_compacted", "_compaction"


def load_csv(
    spark: SparkSession,
    source: str,
    target: str,
    sep: str = ",",
    mode: str = "append",
    format: str = "parquet",
    schema: StructType | None = None,
) -> int:
    """Scan a CSV, stamp it and append it to, or write it over, the table at ``target``; returns the rows written."""
    rows, counted = writes.observe_counts(stamp_load_time(scan_csv(spark, source, sep, schema)))
    {"append": writes.append, "overwrite": writes.overwrite, "create": writes.create}[mode](rows, target, format)
    return counted.get["rows"]


def load_csv_by_key(
    spark: SparkSession,
    source: str,
    target: str,
    key: Names,
    tiebreak: Names = (),
    sep: str = ",",
    partition_by: Names = (),
    replace: bool = False,
    schema: StructType | None = None,
    parallelism: int | None = None,
    buckets: int | None = None,
    batch_id: int | str | None = None,
    table: str | None = None,
    snapshots: bool = False,
) -> None:
    """Scan a CSV, stamp it and upsert it by key; ``replace`` empties the table first.

    All rows of a load have the same stamp, so ``tiebreak`` columns decide between rows of one key. In a table with
    ``partition_by`` a row is identified by partition and key; ``buckets`` divides one without such columns by its key.
    With ``snapshots`` the table is a series of snapshots, each of which holds all of it. One of the three has to be
    chosen. With ``batch_id`` the rows carry commit columns, and ``table`` names a catalog table that shows them.
    """
    one_way(snapshots, partition_by, buckets)
    rows = stamp_load_time(scan_csv(spark, source, sep, schema))
    order = [LOAD_COLUMN, *names_of(tiebreak)]
    if replace and (partition_by or buckets):
        rows, partition_by = _divided(rows, key, partition_by, buckets)
        identity = [*partition_by, *names_of(key)]
        bulk_load(rows, target, identity, order, parallelism, batch_id, partition_by=partition_by)
    elif replace:
        publish_snapshot(committed(dedupe_batch(rows, key, order, parallelism), key, (), batch_id), target, table=table)
    else:
        _upsert(rows, target, key, order, partition_by, buckets, parallelism, batch_id, table)


def _divided(rows: DataFrame, key: Names, partition_by: Names, buckets: int | None) -> tuple[DataFrame, list[str]]:
    """The rows and their partition columns; without any, a bucket of the key is one."""
    if partition_by or buckets is None:
        return rows, list(names_of(partition_by))
    return rows.withColumn(BUCKET_COLUMN, key_bucket(key, buckets)), [BUCKET_COLUMN]


def _upsert(
    rows: DataFrame,
    target: str,
    key: Names,
    order: Names,
    partition_by: Names = (),
    buckets: int | None = None,
    parallelism: int | None = None,
    batch_id: int | str | None = None,
    table: str | None = None,
    count: bool = False,
) -> Changes | None:
    rows, partition_by = _divided(rows, key, partition_by, buckets)
    options = {"parallelism": parallelism, "batch_id": batch_id, "table": table, "count": count}
    if partition_by:
        return upsert_partitions(rows, target, key, order, partition_by, **options)
    return upsert_snapshot(rows, target, key, order, **options)


def load_csv_to_table(
    spark: SparkSession,
    source: str,
    table: str,
    location: str,
    sep: str = ",",
    partition_by: Names = (),
    properties: dict[str, str] | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """Scan a CSV, create its SQL table when it is new, and insert the rows by name; returns the table."""
    rows = scan_csv(spark, source, sep, schema)
    create_table(spark, table, rows.schema, location, partition_by, properties)
    insert_by_name(writes.spread_by(rows, partition_by), table)
    return spark.table(table)


def load_csv_to_warehouse(
    spark: SparkSession,
    source: str,
    table: str,
    database: str | None = None,
    sep: str = ",",
    format: str = "parquet",
    connector_options: dict[str, str] | None = None,
) -> None:
    """Scan a CSV and write it over a whole warehouse table."""
    writes.load_warehouse(scan_csv(spark, source, sep), table, database, format, connector_options)


def load_events(
    events: DataFrame,
    target: str,
    key: Names,
    schema: StructType | None = None,
    tiebreak: Names = (),
    quarantine: str | None = None,
    batch_id: int | str | None = None,
    partition_by: Names = (),
    buckets: int | None = None,
    commit: bool = False,
    table: str | None = None,
    snapshots: bool = False,
) -> LoadCounts:
    """Decode a batch of stream events, stamp the records and upsert them by key; returns what became of them.

    Bad records go to the folder of ``batch_id`` below ``quarantine``, which a repeated load of the same batch writes
    over; without a quarantine the first one fails the load. Without ``schema`` a row has its key and tiebreak columns,
    as text, and the whole record as the map ``payload``. ``partition_by``, ``buckets`` and ``snapshots`` are those of
    ``load_csv_by_key``. With ``commit`` the rows carry commit columns. Both quarantine and commit need a ``batch_id``.
    """
    one_way(snapshots, partition_by, buckets)
    if batch_id is None and (commit or quarantine is not None):
        raise ValueError("a load with a quarantine or with commit columns needs a batch_id of its own")

    def load(rows: DataFrame) -> Changes:
        if schema is None:
            named = dict.fromkeys([*names_of(key), *names_of(tiebreak), *names_of(partition_by)])
            rows = rows.select(*[F.try_element_at(PAYLOAD, F.lit(n)).alias(n) for n in named], PAYLOAD)
        order, options = [LOAD_COLUMN, *names_of(tiebreak)], {"batch_id": batch_id if commit else None, "table": table}
        return _upsert(stamp_load_time(rows), target, key, order, partition_by, buckets, count=True, **options)

    staged = stage(decode_envelope(events, schema, required=key), "decoded", [BAD_RECORD])
    return load_records(staged, quarantine, batch_id, load)


def append_events(
    events: DataFrame, target: str, key: Names, schema: StructType, batch_id: int | str, quarantine: str
) -> None:
    """Decode a batch of stream events, stamp the records and append them, as partition ``load_batch`` of ``target``.

    Frequent small batches whose keys lie all over a large table are loaded in this way and compacted now and then.
    Repeating a batch writes it and its bad records over, and lets the next compaction take it again.
    """
    spark, batch = events.sparkSession, f"{BATCH_COLUMN}={batch_id}"

    def append(rows: DataFrame) -> None:
        remove(spark, f"{target}/{COMPACTED}/{batch}")
        writes.overwrite(stamp_load_time(rows), f"{target}/{batch}")

    staged = stage(decode_envelope(events, schema, required=key), "decoded", [BAD_RECORD])
    load_records(staged, quarantine, batch_id, append)


def appended_batches(spark: SparkSession, appended: str) -> list[str]:
    """Names of the batches that are complete and not compacted yet, from the listing alone."""
    done = file_names(spark, f"{appended}/{COMPACTED}")
    new = [n for n in subfolders(spark, appended) if n.startswith(f"{BATCH_COLUMN}=") and n not in done]
    return [n for n in new if exists(spark, f"{appended}/{n}/_SUCCESS")]


def _read_batches(spark: SparkSession, appended: str, batches: list[str]) -> DataFrame:
    """The rows of some batches, their number as text that sorts as the number does."""
    found = spark.read.option("basePath", appended).parquet(*[f"{appended}/{b}" for b in batches])
    number = F.col(BATCH_COLUMN).cast("string")
    return found.withColumn(BATCH_COLUMN, F.when(number.rlike("^[0-9]{1,20}$"), F.lpad(number, 20, "0")).otherwise(number))


def latest_events(spark: SparkSession, appended: str, key: Names, order: Names, target: str | None = None) -> DataFrame:
    """The latest row per key of what ``append_events`` has appended.

    With ``target``, the table that ``compact_events`` keeps, only batches that are not compacted yet are read besides it.
    """
    batches = appended_batches(spark, appended) if target else []
    if not target:
        rows = spark.read.parquet(appended)
    else:
        parts = [read_partitions(spark, target).drop(BUCKET_COLUMN)] if exists(spark, f"{target}/{COMPACTION}") else []
        parts += [_read_batches(spark, appended, batches)] if batches else []
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return dedupe_batch(rows, key, [*names_of(order), BATCH_COLUMN]).drop(BATCH_COLUMN)


def compact_events(
    spark: SparkSession,
    appended: str,
    target: str,
    key: Names,
    order: Names,
    buckets: int = 16,
    drop: bool = False,
) -> int:
    """Upsert the batches appended since the last compaction into ``target``, and return their number.

    The target holds the latest row per key, divided by ``buckets`` of the key; only buckets that the new batches have
    keys for are rewritten, and no batch is read that was compacted before. When a batch is in the target it is marked,
    and with ``drop`` removed. A compaction that was lost anywhere is repeated: its batches are upserted again, which
    leaves the same rows, as newer rows win and equal ones are decided by the number of the batch.
    """
    folder = f"{target}/{COMPACTION}"
    known = [n for n in subfolders(spark, folder) if n.startswith("buckets=")]
    if known and known != [f"buckets={buckets}"]:
        raise ValueError(f"the table at {target} was compacted with {known[0]}")
    batches = appended_batches(spark, appended)
    if batches:
        rows = _read_batches(spark, appended, batches).withColumn(BUCKET_COLUMN, key_bucket(key, buckets))
        upsert_partitions(rows, target, key, [*names_of(order), BATCH_COLUMN], [BUCKET_COLUMN], keep_latest=True)
        touch(spark, f"{folder}/buckets={buckets}/_made")
        for batch in batches:
            touch(spark, f"{appended}/{COMPACTED}/{batch}")
    if drop:
        for batch in file_names(spark, f"{appended}/{COMPACTED}"):
            if batch.startswith(f"{BATCH_COLUMN}="):
                remove(spark, f"{appended}/{batch}")
                remove(spark, f"{appended}/{COMPACTED}/{batch}")
    return len(batches)


def check_quality(
    spark: SparkSession, source: str, checks: Sequence[Check], reports: str, format: str = "csv", **options: str | bool
) -> Verification:
    """Verify checks on a CSV or Parquet input and write both reports."""
    verification = verify(scan(spark, source, format, **options), checks)
    write_reports(spark, verification, reports)
    return verification


def read_catalog_entry(spark: SparkSession, entry: dict[str, Any], format: str = "parquet") -> DataFrame:
    """Read a catalog-described table, with the entry's schema and location."""
    return scan_catalog_entry(spark, entry, format)
