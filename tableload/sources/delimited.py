"""Delimited files: header CSV with string, declared or inferred columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Fixed value: bytes per input split of the large-file reader.
LARGE_FILE_SPLIT_BYTES = 400_000_000


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    schema: StructType | None = None,
    **options: str | bool,
) -> DataFrame:
    """Read header CSV files; without ``schema`` every column is a string.

    A schema spares the look at the first file's header. Each task checks the header of its file against the schema,
    or against the first file's, so files with another column order fail instead of loading into the wrong columns.
    Records with line breaks inside quotes need ``multiLine=True``, which makes each file a single task.
    """
    def reader():
        return spark.read.option("header", True).option("sep", sep).options(**options)

    if schema is None:
        found = reader().csv(path)
        if not _as_written(found.columns) or "enforceSchema" in options:
            return found
        schema = found.schema
    return reader().schema(schema).options(**{"enforceSchema": False, **options}).csv(path)


def _as_written(columns: list[str]) -> bool:
    """Whether the reader took the names from the header as they are; it changes those that are empty or repeated."""
    stems = [c.removesuffix(str(k)).lower() for k, c in enumerate(columns)]
    changed = [c for k, c in enumerate(columns) if c == f"_c{k}" or (c.lower() != stems[k] and stems.count(stems[k]) > 1)]
    return not changed


def split_session(spark: SparkSession, max_partition_bytes: int, exact: bool = False) -> SparkSession:
    """A sibling session whose scans use the given split size.

    The split size is read when a plan becomes physical, so it has to live in a session of its own to leave the
    caller's untouched. SQL settings made on the caller's session are carried over. ``exact`` makes every split as
    large as allowed, also when that gives fewer tasks than cores.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.files.maxPartitionBytes", str(max_partition_bytes))
    if exact:
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        session.conf.set("spark.sql.files.openCostInBytes", "0")
    return session


def scan_large_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    schema: StructType | None = None,
    max_partition_bytes: int = LARGE_FILE_SPLIT_BYTES,
    **options: str | bool,
) -> DataFrame:
    """Read large CSV files in bounded splits, with inferred column types.

    Inference reads everything once more. On big inputs pass ``schema``, or ``samplingRatio`` as an option.
    """
    session = split_session(spark, max_partition_bytes)
    if schema is None:
        options = {"inferSchema": True, **options}
    return scan_csv(session, path, sep, schema, **options)
