"""Keyed change operators: latest row per key, upsert, bulk load, merge.

A batch is computed once, into the shared scratch folder, and measured on the way. Only then is it known whether it is
small enough to be broadcast; the target is shuffled when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import (
    AtomicType,
    BinaryType,
    DataType,
    DecimalType,
    MapType,
    NullType,
    StringType,
    StructType,
    VariantType,
)

from tableload.functions.columns import COMMIT_COLUMNS, all_present, with_commit_metadata
from tableload.functions.names import Names, col, cols, names_of, quoted
from tableload.operators.writes import overwrite
from tableload.workspace import scratch_path

# Measured size up to which the keys of a batch are broadcast: little for a driver and each executor to hold, and much
# less to move than a target that is worth partitioning.
MAX_BROADCAST_BYTES = 128 << 20

# Bits of the largest bitmap of keys, sent instead of keys that are too large to broadcast: 64 MiB.
MAX_BITMAP_BITS = 1 << 29

# Bits per key that a bitmap has at least: at most an eighth of the rows without a match then go through the exchange.
BITS_PER_KEY = 8

# Fixed value: bits of one bitmap of the built-in bitmap functions.
BITMAP_BITS = 4096 * 8

_INCOMING = "_incoming"

# Commit column by which rows are marked whose commit columns are still to be filled in, and the value that marks them.
_SEQNO, _TO_COMMIT = "_commit_seqno", ""


def _row_bytes(schema: StructType) -> Column | None:
    """Size of a row in memory (header, a word per field, variable parts); None where a type has no simple bound."""
    size = F.lit(32 + 8 * len(schema.fields)).cast("long")
    for field in schema:
        if isinstance(field.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(col(field.name)), F.lit(0)) + 8
        elif isinstance(field.dataType, DecimalType):
            size = size + 16
        elif not isinstance(field.dataType, AtomicType):
            return None
    return size


@dataclass(frozen=True)
class Staged:
    """A table written to the scratch folder: its rows, where they are, and their measured size."""

    rows: DataFrame
    path: str
    count: int
    bytes: int | None

    def fits(self, max_bytes: int) -> bool:
        return self.bytes is not None and self.bytes <= max_bytes


def table_bytes(df: DataFrame, unknown: int) -> int:
    """Measured size of a table in memory; more than ``unknown`` where its types have no simple bound."""
    row_bytes = _row_bytes(df.schema)
    return unknown + 1 if row_bytes is None else df.agg(F.sum(row_bytes)).first()[0] or 0


def stage(df: DataFrame, label: str, measured: Sequence[str]) -> Staged:
    """Write ``df`` to the scratch folder, and measure its ``measured`` columns in the same job."""
    spark = df.sparkSession
    path, observation = scratch_path(spark, label), Observation()
    row_bytes = _row_bytes(df.select(*cols(measured)).schema)
    size = F.lit(0) if row_bytes is None else row_bytes
    overwrite(df.observe(observation, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")), path)
    found = observation.get
    size = None if row_bytes is None else found["bytes"] or 0
    return Staged(spark.read.schema(df.schema).parquet(path), path, found["rows"], size)


def _orderable(data_type: DataType) -> bool:
    if isinstance(data_type, StructType):
        return all(_orderable(f.dataType) for f in data_type)
    if hasattr(data_type, "elementType"):
        return _orderable(data_type.elementType)
    return not isinstance(data_type, (MapType, VariantType, NullType))


def _latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key and c not in order]
    ranked = [c for c in rest if _orderable(df.schema[c].dataType)]
    unranked = [c for c in rest if c not in ranked]
    order_only = [c for c in order if c not in key]
    # The row itself is the ordering value, so the aggregate carries each column once, and equal ordering values are
    # decided by the other columns and not by the order in which tasks finish.
    row = F.struct(*cols([*order_only, *ranked]))
    if unranked:
        best = F.max_by(F.struct(*cols([*order_only, *rest])), row)
    else:
        best = F.max(row)
    if not rest and not order_only:
        return df.select(*cols(key)).distinct()
    return df.groupBy(*cols(key)).agg(best.alias("_best")).select(
        *[col(c) if c in key else F.col(f"_best.{quoted(c)}").alias(c) for c in df.columns]
    )


def dedupe_batch(
    df: DataFrame, key: Names, order: Names, parallelism: int | None = None
) -> DataFrame:
    """Keep, per key, the row with the greatest ``order`` columns (null is the smallest).

    Tasks reduce their rows to one per key before the shuffle, so a frequent key does not load one task. The remaining
    columns break ties. A null key fails the job. ``parallelism`` spreads the result over that many tasks by key; by
    default the adaptive planner picks their number.
    """
    kept = _latest(df.where(all_present(key)), names_of(key), names_of(order))
    return kept if parallelism is None else kept.repartition(parallelism, *cols(key))


def like(df: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of ``df`` with the columns and types of ``target``."""
    return df.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in target.schema])


def _small_or_shuffled(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df.hint("merge")


def upsert(
    target: DataFrame,
    batch: DataFrame,
    key: Names,
    order: Names,
    keep_latest: bool = False,
    parallelism: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The target after a batch: rows of known keys are replaced, rows of new keys added, all others kept.

    ``target`` has at most one row per key, as this function and ``bulk_load`` leave it. The incoming row wins, even
    when its ``order`` columns are older; with ``keep_latest`` the greater ones win, and the incoming row on a tie.

    The batch is reduced to one row per key and staged. When its keys are small the target is not shuffled: only the
    keys are sent to the tasks that scan it. When they are not, a bitmap of them is, if it is no larger than
    ``max_broadcast_bytes``, and only rows that it does not rule out are shuffled.
    """
    if set(batch.columns) != set(target.columns):
        raise ValueError(f"batch columns {batch.columns} differ from target columns {target.columns}")
    staged = stage(dedupe_batch(like(batch, target), key, order, parallelism), "batch", key)
    small = staged.fits(max_broadcast_bytes)
    kept, changed = upsert_parts(target, staged, key, order, keep_latest, small, max_broadcast_bytes)
    return changed if kept is None else kept.unionByName(changed)


@dataclass(frozen=True)
class Changes:
    """What a keyed write did: rows added, rows replaced, and rows of the batch that were older than the stored ones."""

    inserted: int = 0
    replaced: int = 0
    outdated: int = 0


def count_changes(
    target: DataFrame, staged: Staged, key: Names, order: Names, keep_latest: bool, small: bool
) -> Changes:
    """What an upsert of these rows will do, from the key and order columns of the target alone."""
    key = names_of(key)
    rank = F.struct(*cols([c for c in names_of(order) if c not in key] or key))
    ranked = list(dict.fromkeys([*key, *names_of(order)]))
    incoming = staged.rows.select(*cols(key), rank.alias(_INCOMING))
    older = (rank > F.col(_INCOMING)) & F.lit(keep_latest)
    both = target.select(*cols(ranked)).join(_small_or_shuffled(incoming, small), key)
    found = both.agg(F.count(F.lit(1)).alias("known"), F.count_if(older).alias("older")).first()
    return Changes(staged.count - found.known, found.known - found.older, found.older)


def bitmap_size(keys: int, max_bytes: int) -> int | None:
    """Bits of a bitmap for so many keys; None where the largest that fits would be too full to tell rows apart."""
    bits = max(BITMAP_BITS, 1 << (BITS_PER_KEY * max(keys, 1) - 1).bit_length())
    while bits > min(MAX_BITMAP_BITS, 8 * max_bytes):
        bits //= 2
    return bits if max(2 * keys, BITMAP_BITS) <= bits else None


def by_bitmap(
    target: DataFrame, keys: DataFrame, key: Sequence[str], count: int, max_bytes: int
) -> tuple[DataFrame, DataFrame] | None:
    """The rows of ``target`` whose key is surely not among ``count`` keys, and those whose key may be; None when there
    are too many keys for a bitmap of ``max_bytes``.

    A hash of every key is a bit. The bits, in blocks of 4 KiB, are broadcast: their size is bounded, whatever the keys
    are. Rows without a bit need no exchange, and stay in the tasks that scan them.
    """
    bits = bitmap_size(count, max_bytes)
    if bits is None:
        return None
    block, bit, found = _new_names(target, "_block", "_bit", "_bits")
    place = F.pmod(F.xxhash64(*cols(key)), F.lit(bits)) + 1
    places = {block: F.bitmap_bucket_number(place), bit: F.bitmap_bit_position(place)}
    # brought together first, so that a block is built once and not by every task
    blocks = keys.select(*[c.alias(n) for n, c in places.items()]).repartition(block)
    blocks = blocks.groupBy(block).agg(F.bitmap_construct_agg(bit).alias(found))
    byte = F.substring(found, (F.col(bit) / 8).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col(bit) % 8).cast("int")) == 1
    may_be = F.coalesce(is_set, F.lit(False))
    marked = target.withColumns(places).join(F.broadcast(blocks), block, "left")
    return marked.where(~may_be).select(*cols(target.columns)), marked.where(may_be).select(*cols(target.columns))


def _new_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no such column."""
    known = {c.lower() for c in df.columns}
    return [name + "_" * next(n for n in range(len(known) + 1) if (name + "_" * n).lower() not in known) for name in names]


def upsert_parts(
    target: DataFrame,
    staged: Staged,
    key: Names,
    order: Names,
    keep_latest: bool,
    small: bool,
    max_bitmap_bytes: int = MAX_BROADCAST_BYTES,
) -> tuple[DataFrame | None, DataFrame]:
    """The result of an upsert in two parts: stored rows straight from the scan, and all others.

    With a small batch the second part is no larger than the batch. With ``keep_latest`` one scan of the target keeps the
    stored winners, and one of its key and order columns alone tells which incoming rows lose. With a large batch the
    first part is the stored rows that a bitmap of its keys rules out (None without a bitmap); the others are shuffled.
    """
    key, order, columns = names_of(key), names_of(order), target.columns
    if not small:
        split = by_bitmap(target, staged.rows, key, staged.count, max_bitmap_bytes)
        sure, maybe = split or (None, target)
        if keep_latest:
            return sure, _newer_of_each(maybe, staged.rows, key, order)
        rest = maybe.join(staged.rows.select(*cols(key)).hint("merge"), key, "left_anti").select(*cols(columns))
        return sure, rest.unionByName(staged.rows)
    if not keep_latest:
        keys = F.broadcast(staged.rows.select(*cols(key)))
        return target.join(keys, key, "left_anti").select(*cols(columns)), staged.rows
    rank = F.struct(*cols([c for c in order if c not in key] or key))
    incoming = F.broadcast(staged.rows.select(*cols(key), rank.alias(_INCOMING)))
    stored_wins = rank > F.col(_INCOMING)
    kept = target.join(incoming, key, "left").where(F.col(_INCOMING).isNull() | stored_wins).select(*cols(columns))
    ranked = list(dict.fromkeys([*key, *order]))
    losers = target.select(*cols(ranked)).join(incoming, key).where(stored_wins).select(*cols(key))
    return kept, staged.rows.join(F.broadcast(losers), key, "left_anti").select(*cols(columns))


def _newer_of_each(target: DataFrame, batch: DataFrame, key: list[str], order: Sequence[str]) -> DataFrame:
    """All rows of two tables with one row per key, the newer one where both have it: one shuffle and sort of each."""
    stored = target.select(*cols(key), F.struct(*cols(target.columns)).alias("_stored"))
    incoming = batch.select(*cols(key), F.struct(*cols(target.columns)).alias(_INCOMING))

    def rank(side: str) -> Column:
        return F.struct(*[F.col(f"{side}.{quoted(c)}").alias(c) for c in order])

    stored_wins = F.col(_INCOMING).isNull() | (F.col("_stored").isNotNull() & (rank("_stored") > rank(_INCOMING)))
    winner = F.when(stored_wins, F.col("_stored")).otherwise(F.col(_INCOMING)).alias("_winner")
    return stored.join(incoming.hint("merge"), key, "full_outer").select(winner).select("_winner.*")


def bulk_load(
    df: DataFrame,
    path: str,
    key: Names,
    order: Names,
    parallelism: int | None = None,
    batch_id: int | str | None = None,
    **options,
) -> None:
    """Replace the table at ``path`` by the latest row per key; with ``batch_id`` its rows get commit columns."""
    rows = dedupe_batch(df, key, order, parallelism)
    overwrite(committed(rows, key, options.get("partition_by", ()), batch_id), path, **options)


def committed(rows: DataFrame, key: Names, partition_by: Names, batch_id: int | str | None) -> DataFrame:
    """The rows with commit columns of this batch in place of any they have; as they are without a batch id."""
    if batch_id is None:
        return rows
    return with_commit_metadata(rows.drop(*COMMIT_COLUMNS), key, partition_by, batch_id)


def to_commit(rows: DataFrame, key: Names, partition_by: Names, order: Names, target: StructType) -> DataFrame | None:
    """The rows with commit columns that are empty until ``commit_marked`` fills them in, as rows are written: staged and
    shuffled without them a row is half as wide. None where they are needed before: ordered by, or made from columns
    that the target has in another type."""
    given, stored = ({f.name: f.dataType for f in schema} for schema in (rows.schema, target))
    same = all(c in given and given[c] == stored.get(c) for c in [*names_of(key), *names_of(partition_by)])
    if set(COMMIT_COLUMNS) & set(names_of(order)) or not same:
        return None
    empty = {c: F.lit(None).cast("long" if c == "_commit_instant" else "string") for c in COMMIT_COLUMNS}
    empty[_SEQNO] = F.lit(_TO_COMMIT)
    return rows.drop(*COMMIT_COLUMNS).select(*[value.alias(c) for c, value in empty.items()], *cols(_others(rows)))


def commit_marked(rows: DataFrame, key: Names, partition_by: Names, batch_id: int | str | None) -> DataFrame:
    """Fill in the commit columns of rows from ``to_commit``; all others stay."""
    if batch_id is None:
        return rows
    (before,) = _new_names(rows, "_before")
    known = rows.select(F.struct(*cols(COMMIT_COLUMNS)).alias(before), *cols(_others(rows)))
    marked = F.col(f"{before}.{_SEQNO}").eqNullSafe(F.lit(_TO_COMMIT))
    filled = with_commit_metadata(known, key, partition_by, batch_id)
    chosen = {c: F.when(marked, F.col(c)).otherwise(F.col(f"{before}.{c}")).alias(c) for c in COMMIT_COLUMNS}
    return filled.select(*[chosen.get(c, col(c)) for c in rows.columns])


def _others(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in COMMIT_COLUMNS]


def bulk_load_table(df: DataFrame, table: str, key: Names, order: Names, buckets: int) -> None:
    """Replace a catalog table by the latest row per key, divided into one sorted file per bucket of the key.

    As the target of ``upsert`` or ``merge_into`` such a table is not shuffled, however large the batch is.
    """
    rows = dedupe_batch(df, key, order).repartition(buckets, *cols(key))
    rows.write.mode("overwrite").bucketBy(buckets, *names_of(key)).sortBy(*names_of(key)).saveAsTable(table)


def merge_into(
    target: DataFrame,
    source: DataFrame,
    on: Names,
    update_columns: Names,
    insert: bool = True,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The target after a merge: matched rows get ``update_columns`` from the source, unmatched source rows are added.

    All target rows of a matched key are updated, their other columns and all unmatched rows stay. A null key matches
    nothing. Several source rows that match the same target row are an error.

    A small source is broadcast and the target not shuffled. Otherwise target rows that a bitmap of the source's keys
    rules out stay where they are; both sides of the update are plain shuffled tables, in which the adaptive planner can
    split a frequent target key; and the keys looked up for the insert are reduced to distinct ones by the tasks that read
    them.
    """
    staged = stage_source(source, target, on, update_columns)
    return merged(target, staged, on, update_columns, insert, max_broadcast_bytes)[0]


def stage_source(source: DataFrame, target: DataFrame, on: Names, update_columns: Names) -> Staged:
    """The source of a merge as a table of the target's columns."""
    return stage(like(source, target), "source", list(dict.fromkeys([*names_of(on), *names_of(update_columns)])))


def with_key(df: DataFrame, on: Names) -> DataFrame:
    """The rows that can match: those without a null in ``on``."""
    return df.where(reduce(and_, [col(name).isNotNull() for name in names_of(on)]))


def merged(
    target: DataFrame, staged: Staged, on: Names, update_columns: Names, insert: bool, max_broadcast_bytes: int
) -> tuple[DataFrame, list[str]]:
    """What ``merge_into`` returns, and the scratch folders it reads, for a caller that writes it and removes them."""
    on, update_columns = names_of(on), names_of(update_columns)
    small = staged.fits(max_broadcast_bytes)
    keyed = with_key(staged.rows, on)
    _refuse_several_matches(target, keyed, on)

    updates = keyed.select(*cols(on), F.struct(*cols(update_columns)).alias("_new"))
    matched = F.col("_new").isNotNull()
    sure, maybe = (None if small else by_bitmap(target, keyed, on, staged.count, max_broadcast_bytes)) or (None, target)
    updated = maybe.join(_small_or_shuffled(updates, small), on, "left").select(
        *[
            F.when(matched, F.col(f"_new.{quoted(c)}")).otherwise(col(c)).alias(c) if c in update_columns else col(c)
            for c in target.columns
        ]
    )
    updated = updated if sure is None else sure.unionByName(updated)
    if not insert:
        return updated, [staged.path]
    if small:
        known = target.select(*cols(on)).join(F.broadcast(keyed.select(*cols(on))), on, "left_semi").distinct()
        added = staged.rows.join(F.broadcast(known), on, "left_anti").select(*cols(target.columns))
        return updated.unionByName(added), [staged.path]
    # Staged, the known keys are a plain table as well, and broadcast when they turn out few.
    stored_keys = maybe.select(*cols(on)).distinct()
    known = stage(stored_keys.join(keyed.select(*cols(on)).hint("merge"), on, "left_semi"), "known", on)
    added = keyed.join(_small_or_shuffled(known.rows, known.fits(max_broadcast_bytes)), on, "left_anti")
    without_key = staged.rows.where(reduce(or_, [col(name).isNull() for name in on]))
    added = added.select(*cols(target.columns)).unionByName(without_key)
    return updated.unionByName(added), [staged.path, known.path]


def _refuse_several_matches(target: DataFrame, keyed: DataFrame, on: list[str]) -> None:
    """Fail when a key that the source has several times is in the target, which is only read if there is such a key."""
    repeated = keyed.groupBy(*cols(on)).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(*cols(on))
    if not repeated.isEmpty() and not target.select(*cols(on)).join(repeated, on, "left_semi").isEmpty():
        raise ValueError(f"several source rows match a target row on {', '.join(on)}")
