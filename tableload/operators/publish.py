"""Publishing a changed table: whole snapshots, or only the partitions a batch touches.

A partitioned table keeps what it has to know in hidden folders beside its partitions, all of them Parquet tables: rewritten
partitions until they are moved in, which partitions those are, the columns of a table that has grown, and, where a key
may move between partitions, the partition of every key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tableload.functions.names import Names, col, cols, names_of
from tableload.operators.keyed import (
    MAX_BROADCAST_BYTES,
    Changes,
    Staged,
    commit_marked,
    committed,
    count_changes,
    dedupe_batch,
    like,
    merged,
    stage,
    stage_source,
    table_bytes,
    to_commit,
    upsert_parts,
    with_key,
)
from tableload.operators.tables import add_columns, add_partitions, create_table, drop_partitions, point_table
from tableload.operators.writes import observe_counts, overwrite, spread_by
from tableload.workspace import exists, first_file, partition_folders, remove, replace_folder, subfolders, touch, writer

# Folders of a partitioned table, hidden from scans: the rewritten partitions of a call until they are moved in, the values
# of these partitions, the keys whose partition the call sets, the columns of a table that has grown, the partition of
# every key.
PENDING, TOUCHED, PLACED, COLUMNS, LOCATOR = "_pending", "_touched", "_placed", "_columns", "_locator"

# File among the rewritten partitions: the partitions that have no row left are gone, so one missing there is moved in.
CLEARED = "_cleared"

# Divisions of a locator by its keys, unless the first call names another number.
LOCATOR_BUCKETS = 64

# Touched partitions up to which each task that merges a large batch writes a file to every one of them.
FEW_PARTITIONS = 16

# Partition column of a locator.
_BUCKET = "_bucket"

_SNAPSHOT = "snapshot="


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete snapshots at ``path``, in order."""
    numbers = [int(n.removeprefix(_SNAPSHOT)) for n in subfolders(spark, path) if n.startswith(_SNAPSHOT)]
    return sorted(n for n in numbers if exists(spark, f"{path}/{_SNAPSHOT}{n}/_SUCCESS"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete snapshot; None when there is none."""
    numbers = snapshots(spark, path)
    return spark.read.parquet(f"{path}/{_SNAPSHOT}{numbers[-1]}") if numbers else None


def publish_snapshot(df: DataFrame, path: str, keep: int | None = None, table: str | None = None) -> int:
    """Write ``df`` as the next snapshot and return its number.

    Readers see it once its job is complete; what a failed job left behind is replaced by the next one. Older snapshots
    stay for readers that have started on them, until ``drop_snapshots``; ``keep`` calls it with every publication.
    ``table`` names a catalog table that shows the newest snapshot.
    """
    spark = df.sparkSession
    numbers = snapshots(spark, path)
    number = numbers[-1] + 1 if numbers else 0
    overwrite(df, f"{path}/{_SNAPSHOT}{number}")
    if table is not None:
        point_table(spark, table, df.schema, f"{path}/{_SNAPSHOT}{number}")
    if keep is not None:
        drop_snapshots(spark, path, keep)
    return number


def drop_snapshots(spark: SparkSession, path: str, keep: int) -> None:
    """Remove all but the newest ``keep`` snapshots, one at least; no reader may still be on the others."""
    for old in snapshots(spark, path)[: -max(keep, 1)]:
        remove(spark, f"{path}/{_SNAPSHOT}{old}")


def _with_columns_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """``df`` with those columns of ``other`` that it lacks, as nulls."""
    missing = [f for f in other.schema if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def upsert_snapshot(
    batch: DataFrame,
    path: str,
    key: Names,
    order: Names,
    keep_latest: bool = False,
    parallelism: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    batch_id: int | str | None = None,
    table: str | None = None,
    keep: int | None = None,
    count: bool = False,
) -> Changes | None:
    """Upsert a batch into the newest snapshot and publish the result as the next one.

    Repeating a batch, as after a lost driver, leaves the same rows, and an empty one publishes nothing. A column that
    only the batch or only the table has is kept, and null in the rows of the other. With ``batch_id`` the batch's rows
    carry commit columns. Every other call writes the whole table; for large tables use ``upsert_partitions``. With
    ``count`` the keys of the table are read once more, and the changes returned. One writer at a time per table, which
    a lease beside it makes sure of.
    """
    spark = batch.sparkSession
    with writer(spark, path) as lease:
        plain = dedupe_batch(batch, key, order, parallelism)
        rows = committed(plain, key, (), batch_id)
        target = read_snapshot(spark, path)
        if target is None:
            rows, counted = observe_counts(rows)
            publish_snapshot(rows, path, keep, table)
            return Changes(counted.get["rows"]) if count else None
        target = _with_columns_of(target, rows)
        late = None if batch_id is None else to_commit(plain, key, (), order, target.schema)
        rows = rows if late is None else late
        staged = stage(like(_with_columns_of(rows, target), target), "batch", key)
        try:
            changes, small = Changes(), staged.fits(max_broadcast_bytes)
            if staged.count:
                if count:
                    changes = count_changes(target, staged, key, order, keep_latest, small)
                bitmap_bytes = _bitmap_bytes(target, staged, small, max_broadcast_bytes)
                kept, changed = upsert_parts(target, staged, key, order, keep_latest, small, bitmap_bytes)
                changed = changed if late is None else commit_marked(changed, key, (), batch_id)
                lease.check()
                publish_snapshot(changed if kept is None else kept.unionByName(changed), path, keep, table)
            return changes if count else None
        finally:
            remove(spark, staged.path)


def _bitmap_bytes(stored: DataFrame, staged: Staged, small: bool, max_bytes: int) -> int:
    """The bytes that a bitmap of the batch's keys may take: none where the stored rows, counted from the footers of their
    files, are fewer than the keys, which would all be shuffled for it, and the stored rows scanned twice."""
    return max_bytes if small or stored.count() > staged.count else 0


def merge_snapshot(
    source: DataFrame,
    path: str,
    on: Names,
    update_columns: Names,
    insert: bool = True,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    table: str | None = None,
    keep: int | None = None,
) -> None:
    """Merge a source into the newest snapshot, as ``merge_into`` does, and publish the result as the next one."""
    spark = source.sparkSession
    with writer(spark, path) as lease:
        target = read_snapshot(spark, path)
        if target is None:
            raise ValueError(f"no table to merge into at {path}")
        staged = stage_source(source, target, on, update_columns)
        folders = [staged.path]
        try:
            rows, folders = merged(target, staged, on, update_columns, insert, max_broadcast_bytes)
            lease.check()
            publish_snapshot(rows, path, keep, table)
        finally:
            for folder in folders:
                remove(spark, folder)


def key_bucket(key: Names, buckets: int) -> Column:
    """A partition number made from the key, for keyed tables without a natural partition column."""
    return F.pmod(F.xxhash64(*cols(key)), F.lit(buckets)).cast("int")


def _no_empty_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail on empty strings in partition columns: as a folder name they cannot be told from null."""
    for name in columns:
        if isinstance(df.schema[name].dataType, StringType):
            empty = F.raise_error(F.lit(f"empty partition value in {name}"))
            df = df.where(F.when(col(name) == "", empty).otherwise(F.lit(True)))
    return df


def upsert_partitions(
    batch: DataFrame,
    path: str,
    key: Names,
    order: Names,
    partition_by: Names,
    keep_latest: bool = False,
    parallelism: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    batch_id: int | str | None = None,
    table: str | None = None,
    unique_across_partitions: bool = False,
    locator_buckets: int = LOCATOR_BUCKETS,
    count: bool = False,
) -> Changes | None:
    """Upsert a batch into a partitioned Parquet table, reading and rewriting only the partitions it touches.

    A row is identified by its partition and key together: the partition columns have to follow from the key, or be
    part of it. Where they do not, ``unique_across_partitions`` identifies it by its key alone: the table then keeps a
    locator, the partition of every key, by which the row a key had in another partition is found and replaced. The
    locator is divided by ``locator_buckets`` of the key, set by the first call, and only those a batch has keys for are
    read and rewritten.

    A column that only the batch or only the table has is kept, and null in the rows of the other; read such a table
    with ``read_partitions`` or by name. With ``batch_id`` the batch's rows carry commit columns, and files are sorted
    by commit; ``table`` names a catalog table that shows the rows. Repeating a batch leaves the same rows, and an empty
    one writes nothing. With ``count`` the keys of the touched partitions are read once more, and the changes returned.

    The rewritten partitions are first written out in a hidden folder of the table and then moved in, so whatever is
    lost, no row is: a call that finds such a folder complete finishes that move first, and drops an incomplete one.
    Only the folders that hold touched partitions are listed, and only touched ones scanned. One writer at a time per
    table, which a lease beside it makes sure of.
    """
    partition_by, key = names_of(partition_by), names_of(key)
    identity = key if unique_across_partitions else list(dict.fromkeys([*partition_by, *key]))
    batch = _no_empty_text(batch, partition_by)
    rows = dedupe_batch(batch, identity, order, parallelism)
    options = (keep_latest, max_broadcast_bytes, batch_id, table, unique_across_partitions, locator_buckets, count)
    return _upsert_distinct(rows, path, key, identity, order, partition_by, *options)


def _upsert_distinct(
    plain: DataFrame,
    path: str,
    key: list[str],
    identity: list[str],
    order: Names,
    partition_by: list[str],
    keep_latest: bool = False,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    batch_id: int | str | None = None,
    table: str | None = None,
    unique_across_partitions: bool = False,
    locator_buckets: int = LOCATOR_BUCKETS,
    count: bool = False,
) -> Changes | None:
    """``upsert_partitions`` of rows that are already one per ``identity``."""
    spark, rows = plain.sparkSession, committed(plain, key, partition_by, batch_id)
    with writer(spark, path) as lease:
        kinds = StructType([rows.schema[c] for c in partition_by])
        _finish_pending(spark, path, kinds, table)
        stored_columns = _stored_columns(spark, path, kinds)
        if stored_columns is None:
            rows, counted = observe_counts(rows)
            overwrite(rows, path, partition_by=partition_by)
            if unique_across_partitions:
                _make_locator(spark, path, key, kinds, locator_buckets, distinct=True)
            if table is not None:
                _show(spark, table, path, rows.schema, partition_by, None)
            return Changes(counted.get["rows"]) if count else None
        _refuse_stray_locator(spark, path, key, kinds, unique_across_partitions)
        schema = _grown(spark, path, stored_columns, rows.schema, kinds)
        empty = spark.createDataFrame([], schema)
        late = None if batch_id is None else to_commit(plain, key, partition_by, order, schema)
        rows = rows if late is None else late
        staged = stage(like(_with_columns_of(rows, empty), empty), "batch", identity)
        try:
            if not staged.count:
                return Changes() if count else None
            small = staged.fits(max_broadcast_bytes)
            touched, left = _values(staged.rows, partition_by), []
            if unique_across_partitions:
                _make_locator(spark, path, key, kinds, locator_buckets)
                left = _values(_left(spark, path, staged.rows, key, kinds, touched, small, max_broadcast_bytes), partition_by)
            folders = partition_folders(spark, path, partition_by, touched + left)
            stored = spark.read.schema(schema).option("basePath", path).parquet(*folders) if folders else empty
            changes = count_changes(stored, staged, identity, order, keep_latest, small) if count else None
            bitmap_bytes = _bitmap_bytes(stored, staged, small, max_broadcast_bytes)
            kept, changed = upsert_parts(stored, staged, identity, order, keep_latest, small, bitmap_bytes)
            # Stored rows that stay are written by the tasks that scan them; only the others move to their partitions,
            # and those of a large batch for few partitions are not shuffled once more for it.
            stay = not small and len(touched) + len(left) <= FEW_PARTITIONS
            moving = changed if stay else spread_by(changed, partition_by)
            moving = moving if late is None else commit_marked(moving, key, partition_by, batch_id)
            placed = None
            if unique_across_partitions:
                won = changed
                if not keep_latest:
                    won = staged.rows  # all of them, so they need not be found among the changed rows
                elif not small:
                    won = changed.join(staged.rows.select(*cols(key)).hint("merge"), key, "left_semi")
                placed = won.select(*cols(dict.fromkeys([*key, *partition_by])))
            result = moving if kept is None else kept.unionByName(moving)
            lease.check()
            _replace(spark, path, result, kinds, touched + left, placed, table)
            return changes
        finally:
            remove(spark, staged.path)


def merge_partitions(
    source: DataFrame,
    path: str,
    on: Names,
    update_columns: Names,
    partition_by: Names,
    insert: bool = True,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    table: str | None = None,
) -> None:
    """Merge a source into a partitioned table, as ``merge_into`` does, rewriting only the partitions with a match.

    These are found by the match itself, from the key and partition columns of the table, so the source needs no partition
    columns, unless it may insert rows: ``insert`` needs all columns of the table, and adds to the partitions of the rows
    without a match. ``update_columns`` are no partition columns, so rows stay where they are. The partitions are
    published as those of ``upsert_partitions`` are.
    """
    spark = source.sparkSession
    on, update_columns, partition_by = names_of(on), names_of(update_columns), names_of(partition_by)
    if set(update_columns) & set(partition_by):
        raise ValueError(f"a merge does not change the partition columns {partition_by}")
    with writer(spark, path) as lease:
        kinds = _partition_kinds(spark, path, partition_by)
        _finish_pending(spark, path, kinds, table)
        schema = _stored_columns(spark, path, kinds)
        missing = [c for c in (schema.names if insert else [*on, *update_columns]) if c not in source.columns]
        if missing:
            raise ValueError(f"the source lacks {missing}")
        known = _locator_keys(spark, path, kinds)
        if insert and known is not None and set(known) != set(on):
            raise ValueError(f"the keys of this table are unique by {known}; a merge on {on} cannot insert")
        empty = spark.createDataFrame([], schema)
        source = _no_empty_text(source, partition_by) if insert else source
        staged = stage_source(_with_columns_of(source, empty), empty, on, update_columns)
        folders = [staged.path]
        try:
            small = staged.fits(max_broadcast_bytes)
            keyed = with_key(staged.rows, on).select(*cols(on))
            places = read_partitions(spark, path, kinds).select(*cols(dict.fromkeys([*on, *partition_by])))
            keys = F.broadcast(keyed) if small else keyed.hint("merge")
            found = stage(places.join(keys, on, "left_semi").distinct(), "matches", on)
            folders.append(found.path)
            touched, added = _values(found.rows, partition_by), None
            if insert:
                added = staged.rows.join(found.rows.select(*cols(on)).distinct(), on, "left_anti")
                touched += [v for v in _values(added, partition_by) if v not in touched]
            if not touched:
                return
            within = partition_folders(spark, path, partition_by, touched)
            stored = spark.read.schema(schema).option("basePath", path).parquet(*within) if within else empty
            result, more = merged(stored, staged, on, update_columns, insert, max_broadcast_bytes)
            folders += more
            placed = added.select(*cols(dict.fromkeys([*on, *partition_by]))) if insert and known is not None else None
            lease.check()
            _replace(spark, path, spread_by(result, partition_by), kinds, touched, placed, table)
        finally:
            for folder in folders:
                remove(spark, folder)


def read_partitions(spark: SparkSession, path: str, kinds: StructType | None = None) -> DataFrame:
    """A partitioned table with all columns it has ever had, null where a file is older than a column.

    ``kinds`` are the partition columns and their types, where they are known; without, Spark takes them from the
    folders.
    """
    noted = read_snapshot(spark, f"{path}/{COLUMNS}")
    if noted is not None:
        return spark.read.schema(noted.schema).parquet(path)
    if kinds is None:
        return spark.read.parquet(path)
    return spark.read.schema(_stored_columns(spark, path, kinds)).parquet(path)


def rows_since(spark: SparkSession, path: str, instant: int, until: int | None = None) -> DataFrame:
    """Rows of a partitioned table that were committed after ``instant``, and not after ``until``.

    Instants are numbers, those of the commit column ``_commit_instant``, by whose range in a file or row group the scan
    skips it: a commit writes its rows together, and rows that stay are sorted by theirs.
    """
    when = col("_commit_instant")
    rows = read_partitions(spark, path).where(when > instant)
    return rows if until is None else rows.where(when <= until)


def _values(df: DataFrame, partition_by: Sequence[str]) -> list[list]:
    """The distinct partitions of the rows by their values as text: as many as the writer and the listing go through."""
    return [list(r) for r in df.select(*[col(c).cast("string").alias(c) for c in partition_by]).distinct().collect()]


def _texts(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def _partition_kinds(spark: SparkSession, path: str, partition_by: Sequence[str]) -> StructType:
    """The partition columns of a stored table with their types."""
    if first_file(spark, path) is None and not exists(spark, f"{path}/{PENDING}/_SUCCESS"):
        raise ValueError(f"no table to merge into at {path}")
    schema = read_partitions(spark, path).schema
    if not set(partition_by) <= set(schema.names):
        raise ValueError(f"the table at {path} is not partitioned by {list(partition_by)}")
    return StructType([schema[c] for c in partition_by])


def _stored_columns(spark: SparkSession, path: str, kinds: StructType) -> StructType | None:
    """The columns of a stored table, those of its partitions last; None when there is none."""
    noted = read_snapshot(spark, f"{path}/{COLUMNS}")
    if noted is not None:
        return noted.schema
    file = first_file(spark, path)
    if file is None:
        return None
    return StructType([*[f for f in spark.read.parquet(file).schema if f.name not in kinds.names], *kinds.fields])


def _grown(spark: SparkSession, path: str, stored: StructType, given: StructType, kinds: StructType) -> StructType:
    """The stored columns and those that only the given rows have, which are noted beside the table."""
    new = [f for f in given if f.name not in stored.names]
    if not new:
        return stored
    schema = StructType([*[f for f in stored if f.name not in kinds.names], *new, *kinds.fields])
    publish_snapshot(spark.createDataFrame([], schema), f"{path}/{COLUMNS}", keep=2)
    return schema


def _replace(
    spark: SparkSession,
    path: str,
    result: DataFrame,
    kinds: StructType,
    touched: list[list],
    placed: DataFrame | None,
    table: str | None,
) -> None:
    """Make ``result`` the rows of the touched partitions. It is complete in a hidden folder before one of them changes,
    with the list of these partitions, and with the keys whose partition the locator is to learn."""
    partition_by = kinds.names
    overwrite(spark.createDataFrame(touched, _texts(partition_by)), f"{path}/{TOUCHED}")
    if placed is not None:
        overwrite(placed, f"{path}/{PLACED}")
    if "_commit_instant" in result.columns:
        result = result.sortWithinPartitions(*cols(partition_by), col("_commit_instant"))
    options = {"partitionOverwriteMode": "static"}
    result.write.mode("overwrite").options(**options).partitionBy(*partition_by).parquet(f"{path}/{PENDING}")
    _finish_pending(spark, path, kinds, table)


def _finish_pending(spark: SparkSession, path: str, kinds: StructType, table: str | None) -> None:
    """Move the partitions that a call has left ready into the table; what is not complete is dropped.

    Partitions without a row left go, the locator and the catalog table learn of the others. Every step can be repeated,
    and the folder goes last.
    """
    pending, partition_by = f"{path}/{PENDING}", kinds.names
    if exists(spark, f"{pending}/_SUCCESS"):
        touched = [list(r) for r in spark.read.schema(_texts(partition_by)).parquet(f"{path}/{TOUCHED}").collect()]
        schema = _stored_columns(spark, path, kinds) or _pending_columns(spark, pending, kinds)
        overwrite_partitions(spark, path, partition_by, touched)
        if exists(spark, f"{path}/{PLACED}/_SUCCESS"):
            _place(spark, path, kinds)
        if table is not None:
            _show(spark, table, path, schema, partition_by, touched)
    remove(spark, pending)
    remove(spark, f"{path}/{PLACED}")


def overwrite_partitions(spark: SparkSession, path: str, partition_by: Sequence[str], touched: list[list]) -> None:
    """Put the pending partitions in the place of the touched ones, by renaming their folders: no row is written again.

    Those that have no row left are removed before the first is moved, and the file ``CLEARED`` says so. From then on a
    touched partition that is not pending has been moved in, by a call that was cut off, and stays.
    """
    pending = f"{path}/{PENDING}"
    ready = [f.removeprefix(pending) for f in partition_folders(spark, pending, partition_by, touched)]
    if not exists(spark, f"{pending}/{CLEARED}"):
        staying = set(ready)
        for folder in partition_folders(spark, path, partition_by, touched):
            if folder.removeprefix(path) not in staying:
                remove(spark, folder)
        touch(spark, f"{pending}/{CLEARED}")
    for folder in ready:
        replace_folder(spark, f"{pending}{folder}", f"{path}{folder}")


def _pending_columns(spark: SparkSession, pending: str, kinds: StructType) -> StructType:
    """The columns of rewritten partitions, for a table whose only partitions they are."""
    return StructType([*[f for f in spark.read.parquet(pending).schema if f.name not in kinds.names], *kinds.fields])


def _show(
    spark: SparkSession, table: str, path: str, schema: StructType, partition_by: Sequence[str], touched: list | None
) -> None:
    """Let a catalog table show the partitions at ``path``; ``touched`` are those that may be new or gone, None for all."""
    if not spark.catalog.tableExists(table):
        create_table(spark, table, schema, path, partition_by)
        touched = None
    add_columns(spark, table, schema)
    if touched is None:
        add_partitions(spark, table, partition_by, None)
        return
    there = set(partition_folders(spark, path, partition_by, touched))
    gone = [v for v in touched if not partition_folders(spark, path, partition_by, [v])] if len(there) < len(touched) else []
    add_partitions(spark, table, partition_by, [v for v in touched if v not in gone])
    if gone:
        drop_partitions(spark, table, partition_by, gone)


# The locator: key -> partition -----------------------------------------------------------------------------------------


def _locator_folder(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """Where a table's locator is, and by how many buckets it is divided; None without one."""
    for name in subfolders(spark, f"{path}/{LOCATOR}"):
        if first_file(spark, f"{path}/{LOCATOR}/{name}") is not None:
            return f"{path}/{LOCATOR}/{name}", int(name.partition("=")[2])
    return None


def _locator_keys(spark: SparkSession, path: str, kinds: StructType) -> list[str] | None:
    """The columns by which the keys of a table with a locator are unique."""
    found = _locator_folder(spark, path)
    if found is None:
        return None
    names = spark.read.parquet(first_file(spark, found[0])).columns
    return [c.removeprefix("key.") for c in names if c.startswith("key.")]


def _refuse_stray_locator(spark: SparkSession, path: str, key: list[str], kinds: StructType, unique: bool) -> None:
    known = _locator_keys(spark, path, kinds)
    if known is not None and not (unique and set(known) == set(key)):
        raise ValueError(f"the keys of this table are unique by {known} across partitions; say so in every upsert")


def _make_locator(
    spark: SparkSession, path: str, key: list[str], kinds: StructType, buckets: int, distinct: bool = False
) -> None:
    """Build the partition of every key from the table, when it has none yet; ``distinct`` says that it has each key once."""
    if _locator_folder(spark, path) is None:
        rows = read_partitions(spark, path, kinds).select(*cols(dict.fromkeys([*key, *kinds.names])))
        _upsert_locator(rows, f"{path}/{LOCATOR}/buckets={buckets}", key, kinds, buckets, distinct)


def _place_columns(rows: DataFrame, key: Sequence[str], kinds: StructType, buckets: int) -> DataFrame:
    """Rows of a locator: the columns of key and partition, which may be the same ones, under names of their own."""
    named = [col(c).alias(f"key.{c}") for c in key] + [col(c).alias(f"in.{c}") for c in kinds.names]
    return rows.select(*named, key_bucket(key, buckets).alias(_BUCKET))


def _upsert_locator(
    rows: DataFrame, folder: str, key: Sequence[str], kinds: StructType, buckets: int, distinct: bool
) -> None:
    named, rows = [f"key.{c}" for c in key], _place_columns(rows, key, kinds, buckets)
    if distinct:
        _upsert_distinct(rows, folder, named, [_BUCKET, *named], [], [_BUCKET])
    else:
        upsert_partitions(rows, folder, named, [], [_BUCKET])


def _place(spark: SparkSession, path: str, kinds: StructType) -> None:
    """Let the locator learn the partitions of the keys that a call has placed, each of them once."""
    folder, buckets = _locator_folder(spark, path)
    key = _locator_keys(spark, path, kinds)
    _upsert_locator(spark.read.parquet(f"{path}/{PLACED}"), folder, key, kinds, buckets, distinct=True)


def _left(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    key: list[str],
    kinds: StructType,
    touched: list[list],
    small: bool,
    max_broadcast_bytes: int,
) -> DataFrame:
    """The partition columns of the stored rows whose key is in the batch and whose partition is not touched anyhow, from
    the buckets that its keys fall in.

    Where few keys are in such partitions, they are sent to the batch instead of the batch to them.
    """
    folder, buckets = _locator_folder(spark, path)
    named, places = [f"key.{c}" for c in key], [f"in.{c}" for c in kinds.names]
    keys = batch.select(*[col(c).alias(n) for c, n in zip(key, named, strict=True)], key_bucket(key, buckets).alias(_BUCKET))
    fitting = [[str(r[0])] for r in keys.select(_BUCKET).distinct().collect()]
    folders = partition_folders(spark, folder, [_BUCKET], fitting)
    if not folders:
        return batch.select(*cols(kinds.names)).limit(0)
    known = spark.read.option("basePath", folder).parquet(*folders)
    seen = spark.createDataFrame(touched, _texts([f"seen.{c}" for c in kinds.names]))
    same = [col(p).cast("string").eqNullSafe(col(f"seen.{c}")) for p, c in zip(places, kinds.names, strict=True)]
    elsewhere = known.join(F.broadcast(seen), reduce(and_, same), "left_anti")
    if small:
        found = elsewhere.join(F.broadcast(keys), [_BUCKET, *named], "left_semi")
    elif table_bytes(elsewhere, max_broadcast_bytes) <= max_broadcast_bytes:
        found = keys.join(F.broadcast(elsewhere), [_BUCKET, *named])
    else:
        found = elsewhere.join(keys.hint("merge"), [_BUCKET, *named], "left_semi")
    return found.select(*[col(p).alias(c) for p, c in zip(places, kinds.names, strict=True)])
