"""Streams of event envelopes loaded into tables, one micro-batch at a time.

One query writes a table. Its checkpoint lies beside the target and it is named after it, so Spark refuses a second
query on the same target in a session; one in another session, or any other write to the target from there, is refused
by the lease that the query holds while it runs.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from tableload.functions.columns import LOAD_COLUMN, stamp_load_time
from tableload.functions.names import Names, names_of
from tableload.operators.keyed import Changes, Staged, stage
from tableload.operators.publish import key_bucket, upsert_partitions, upsert_snapshot
from tableload.operators.writes import observe_counts, overwrite
from tableload.sources.records import BAD_RECORD, bad_records, decode_envelope, good_records, only_good_records
from tableload.workspace import Lease, remove

# Partition column of a target that is divided by buckets of its key.
BUCKET_COLUMN = "key_bucket"

# Partition column of a target that is appended to with a quarantine: the number of the micro-batch.
BATCH_COLUMN = "load_batch"


@dataclass(frozen=True)
class LoadCounts:
    """What became of a batch of events: records read, good and bad ones, and what these changed in the table.

    ``inserted`` and ``replaced`` count rows of the table, ``outdated`` rows of the batch that stored ones were newer than;
    good records beyond these had a newer one of their key in the same batch.
    """

    read: int
    good: int
    bad: int
    inserted: int
    replaced: int
    outdated: int


def load_records(
    staged: Staged,
    quarantine: str | None,
    batch_id: int | str | None,
    load: Callable[[DataFrame], Changes | None],
) -> LoadCounts | None:
    """Keep the bad records of a decoded batch in its folder below ``quarantine`` and load the others; without a
    quarantine the first bad one fails. The staged batch is removed, whatever happens."""
    try:
        bad = 0
        if quarantine is None:
            rows = only_good_records(staged.rows)
        else:
            kept, counted = observe_counts(bad_records(staged.rows))
            overwrite(kept, f"{quarantine}/batch={batch_id}")
            bad, rows = counted.get["rows"], good_records(staged.rows)
        changes = load(rows)
        return None if changes is None else LoadCounts(staged.count, staged.count - bad, bad, **asdict(changes))
    finally:
        remove(staged.rows.sparkSession, staged.path)


def one_way(snapshots: bool, partition_by: Names, buckets: int | None) -> None:
    """Fail unless a keyed load says how its table is stored: what each batch costs depends on it."""
    if sum((snapshots, bool(partition_by), buckets is not None)) != 1:
        raise ValueError("say how the table is stored: partition_by, buckets, or snapshots=True, which writes all of it per batch")


def checkpoint_of(target: str) -> str:
    return f"{target.rstrip('/')}.checkpoint"


def read_envelopes(
    spark: SparkSession, path: str | None = None, files_per_batch: int | None = None, format: str = "text", **options
) -> DataFrame:
    """A stream of event texts: by default from the files of a folder, one event per line.

    ``format`` and ``options`` are passed on to the reader, for other stream sources; the texts are then to be brought
    into a column by the caller, and its name given when decoding.
    """
    reader = spark.readStream.format(format).options(**options)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load() if path is None else reader.load(path)


def stream_upsert(
    envelopes: DataFrame,
    target: str,
    schema: StructType,
    key: Names,
    order: Names,
    keep_latest: bool = False,
    partition_by: Names = (),
    buckets: int | None = None,
    snapshots: bool = False,
    stamp: str | None = LOAD_COLUMN,
    quarantine: str | None = None,
    commit: bool = False,
    table: str | None = None,
    keep: int | None = None,
    counts: str | None = None,
    column: str = "value",
    **trigger,
) -> StreamingQuery:
    """Decode, stamp and upsert each micro-batch into ``target``; starts the query.

    With ``partition_by``, or ``buckets`` of the key where no column serves, the target is a partitioned table of which
    a batch rewrites only what it touches; with ``snapshots`` a whole snapshot is published per batch, which suits small
    tables. One of the three has to be chosen. A batch whose keys touch every partition still rewrites the table: with
    frequent small batches, append them and compact now and then. A replayed batch leaves the same rows, and an empty
    one writes nothing. Only ``keep_latest`` makes the result independent of the order in which events arrive.

    Bad records go to one folder per batch below ``quarantine``; without it the first one fails the query. With
    ``commit`` rows carry commit columns; ``table`` names a catalog table that shows the target, and ``keep`` bounds
    the snapshots that stay. ``counts`` is a table of one row per batch, the ``LoadCounts``, which a replayed batch
    writes over; a replay replaces the rows it has inserted before.
    """
    one_way(snapshots, partition_by, buckets)

    def load(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_envelope(batch, schema, required=key, column=column)
        if quarantine is None and counts is None:
            upsert(only_good_records(decoded), batch_id)
            return
        staged = stage(decoded, "decoded", [BAD_RECORD])
        found = load_records(staged, quarantine, batch_id, lambda rows: upsert(rows, batch_id))
        if found is not None:
            overwrite(batch.sparkSession.createDataFrame([found]), f"{counts}/batch={batch_id}")

    def upsert(rows: DataFrame, batch_id: int) -> Changes | None:
        if stamp is not None:
            rows = stamp_load_time(rows, stamp)
        options = {"keep_latest": keep_latest, "batch_id": batch_id if commit else None, "table": table}
        options["count"] = counts is not None
        if buckets is not None:
            rows = rows.withColumn(BUCKET_COLUMN, key_bucket(key, buckets))
            return upsert_partitions(rows, target, key, order, [BUCKET_COLUMN], **options)
        if partition_by:
            return upsert_partitions(rows, target, key, order, partition_by, **options)
        return upsert_snapshot(rows, target, key, order, keep=keep, **options)

    return _start(envelopes.sparkSession, envelopes.writeStream.foreachBatch(load), target, trigger)


def stream_append(
    envelopes: DataFrame,
    target: str,
    schema: StructType,
    required: Names = (),
    partition_by: Names = (),
    stamp: str | None = LOAD_COLUMN,
    format: str = "parquet",
    quarantine: str | None = None,
    column: str = "value",
    **trigger,
) -> StreamingQuery:
    """Decode, stamp and append every record once; starts the query.

    Without ``quarantine`` this is the file sink with its commit log, and the first bad record fails the query. With
    it, the bad records of a batch go to a folder of their own below ``quarantine``, and the good ones to a partition
    ``load_batch`` of the target; a replayed batch writes both over.
    """
    def shaped(rows: DataFrame) -> DataFrame:
        return rows if stamp is None else stamp_load_time(rows, stamp)

    if quarantine is not None:

        def load(batch: DataFrame, batch_id: int) -> None:
            def append(rows: DataFrame) -> None:
                overwrite(shaped(rows), f"{target}/{BATCH_COLUMN}={batch_id}", format, partition_by)

            staged = stage(decode_envelope(batch, schema, required, column), "decoded", [BAD_RECORD])
            load_records(staged, quarantine, batch_id, append)

        writer = envelopes.writeStream.foreachBatch(load)
    else:
        rows = shaped(only_good_records(decode_envelope(envelopes, schema, required, column)))
        writer = rows.writeStream.format(format).option("path", target)
        if partition_by:
            writer = writer.partitionBy(*names_of(partition_by))
    return _start(envelopes.sparkSession, writer, target, trigger)


def _start(spark: SparkSession, writer: DataStreamWriter, target: str, trigger: dict) -> StreamingQuery:
    """Start the query, which holds the lease of its target until it ends."""
    checkpoint = checkpoint_of(target)
    writer = writer.queryName(checkpoint).option("checkpointLocation", checkpoint)
    lease = Lease(spark, target)
    lease.take()
    try:
        query = writer.trigger(**(trigger or {"availableNow": True})).start()
    except BaseException:
        lease.release()
        raise
    threading.Thread(target=lease.hold, args=(lambda seconds: _ended(query, seconds),), daemon=True).start()
    return query


def _ended(query: StreamingQuery, seconds: float) -> bool:
    try:
        return query.awaitTermination(max(1, int(seconds)))
    except Exception:  # it ended with a failure, which its own caller sees
        return True
