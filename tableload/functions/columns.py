"""Column operators: load stamp, projection, payload decoding, commit columns, key guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableload.functions.names import Names, col, cols, names_of

# Fixed value: name of the load-time column.
LOAD_COLUMN = "last_upd_timestamp"

COMMIT_COLUMNS = ("_commit_time", "_commit_instant", "_commit_seqno", "_record_key", "_partition_path")

# The folder name of a null partition value, and the characters that folder names have as %XX.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
ESCAPED_IN_FOLDERS = "%" + "".join(map(chr, range(1, 32))) + "\"#'*/:=?\\\x7f{[]^"


def stamp_load_time(df: DataFrame, column: str = LOAD_COLUMN, if_absent: bool = False) -> DataFrame:
    """Set ``column`` to the query's start time, one value for all rows.

    A column of that name is replaced. ``if_absent`` keeps its values where they are readable as timestamps.
    """
    now = F.current_timestamp()
    if if_absent and column in df.columns:
        now = F.coalesce(col(column).try_cast("timestamp"), now)
    return df.withColumn(column, now)


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def select_all(df: DataFrame) -> DataFrame:
    return df.select("*")


def decode_base64(data: Column | str) -> Column:
    """Base64 of UTF-8 text to the text; null when either coding is broken."""
    data = F.col(data) if isinstance(data, str) else data
    return F.try_validate_utf8(F.try_to_binary(data, F.lit("base64")).cast("string"))


def all_present(columns: Names, what: str = "record key") -> Column:
    """A filter condition that lets every row pass, and fails the job on a null in one of ``columns``."""
    some_null, columns = F.lit(False), names_of(columns)
    for name in columns:
        some_null = some_null | col(name).isNull()
    return F.when(some_null, F.raise_error(F.lit(f"null {what} in {', '.join(columns)}"))).otherwise(F.lit(True))


def folder_text(value: Column) -> Column:
    """A partition value as its folder spells it."""
    text = value.cast("string")
    for character in ESCAPED_IN_FOLDERS:
        text = F.replace(text, F.lit(character), F.lit(f"%{ord(character):02X}"))
    return F.when(value.isNull() | (text == ""), F.lit(NULL_PARTITION)).otherwise(text)


def with_commit_metadata(
    df: DataFrame, key: Names, partition_by: Names = (), batch_id: int | str = 0
) -> DataFrame:
    """Add when, in which order and under which key and partition a row is committed.

    ``_commit_instant`` is the commit time as a number, by which files can be skipped. ``_commit_seqno`` is unique in a commit: batch, task partition and row number in it. A null part of a key has the
    name that a null partition value has as a folder, and the partition path is escaped as its folders are. The file
    name is not stored; ``with_file_name`` reads it from the files.
    """
    key, partition_by = names_of(key), names_of(partition_by)
    parts = [F.coalesce(col(k).cast("string"), F.lit(NULL_PARTITION)) for k in key]
    if len(key) == 1:
        record_key = parts[0]
    else:
        record_key = F.concat_ws(",", *[F.concat(F.lit(f"{k}:"), part) for k, part in zip(key, parts, strict=True)])
    path = F.concat_ws("/", *[F.concat(F.lit(f"{p}="), folder_text(col(p))) for p in partition_by])
    seqno = F.concat_ws(
        "_",
        F.lit(str(batch_id)),
        F.spark_partition_id().cast("string"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("string"),
    )
    time = F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSS")
    return df.select(
        time.alias("_commit_time"),
        time.cast("long").alias("_commit_instant"),
        seqno.alias("_commit_seqno"),
        record_key.alias("_record_key"),
        path.alias("_partition_path"),
        *cols(df.columns),
    )


def with_file_name(df: DataFrame) -> DataFrame:
    """Add the file each row of a file scan was read from."""
    return df.select(F.col("_metadata.file_name").alias("_file_name"), "*")
