"""Sinks for files and catalog tables written with the DataFrame writer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from tableload.functions.names import Names, col, cols, names_of

# How timestamps are written as text.
MICROSECONDS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _writer(df: DataFrame, mode: str, format: str, partition_by: Names, options: dict) -> DataFrameWriter:
    writer = df.write.mode(mode).format(format).options(**options)
    return writer.partitionBy(*names_of(partition_by)) if partition_by else writer


def spread_by(df: DataFrame, columns: Names) -> DataFrame:
    """Bring the rows of each partition value together before a partitioned write, to get few files per value.

    A rebalance lets the adaptive planner split a value that holds much of the data and merge small ones.
    """
    return df.hint("rebalance", *cols(columns)) if columns else df


def append(df: DataFrame, path: str, format: str = "parquet", partition_by: Names = (), **options) -> None:
    _writer(spread_by(df, partition_by), "append", format, partition_by, options).save(path)


def overwrite(df: DataFrame, path: str, format: str = "parquet", partition_by: Names = (), **options) -> None:
    """Replace what is at ``path``, which must not be read by ``df``."""
    options = {"partitionOverwriteMode": "static", **options}
    _writer(spread_by(df, partition_by), "overwrite", format, partition_by, options).save(path)


def create(df: DataFrame, path: str, format: str = "parquet", partition_by: Names = (), **options) -> None:
    """Write to a new path; fails when something is there."""
    _writer(spread_by(df, partition_by), "errorifexists", format, partition_by, options).save(path)


def overwrite_partitions(
    df: DataFrame, path: str, partition_by: Names, format: str = "parquet", spread: bool = True, **options
) -> None:
    """Replace the partitions that ``df`` has rows for and leave all others.

    The new files are moved in when the job is done, so ``df`` may read from ``path`` itself. ``spread=False`` writes
    the rows where they are, for those that already lie together by partition.
    """
    options = {"partitionOverwriteMode": "dynamic", **options}
    df = spread_by(df, partition_by) if spread else df
    _writer(df, "overwrite", format, partition_by, options).save(path)


def write_csv(
    df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists", **options
) -> None:
    """Write CSV; timestamps keep their microseconds, which Spark's default formats cut off."""
    options = {**MICROSECONDS, **options}
    df.write.mode(mode).options(header=header, sep=sep, **options).csv(path)


@dataclass(frozen=True)
class Report:
    """A table whose rows the caller's own lists gave, such as one row per constraint, and which is on the driver."""

    rows: tuple[tuple, ...]
    columns: str

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.columns)


def write_single_csv(spark: SparkSession, report: Report, path: str) -> None:
    """Overwrite ``path`` with one CSV file without header, from a single task.

    Only reports are taken; a DataFrame, which may be of any size, goes to ``write_csv``.
    """
    rows = report.table(spark).repartition(1)
    rows.write.mode("overwrite").options(**MICROSECONDS).csv(path, sep=",")


def load_warehouse(
    df: DataFrame,
    table: str,
    database: str | None = None,
    format: str = "parquet",
    connector_options: dict[str, str] | None = None,
) -> None:
    """Overwrite a whole warehouse table.

    By default that is a table of the session's catalog. With ``connector_options`` the rows go through the connector
    named by ``format``, addressed by those options and ``dbtable``.
    """
    if connector_options is not None:
        df.write.format(format).options(**connector_options).option("dbtable", table).mode("overwrite").save()
        return
    name = f"`{table}`" if database is None else f"`{database}`.`{table}`"
    df.write.format(format).mode("overwrite").saveAsTable(name)


def observe_counts(df: DataFrame, columns: Names = ()) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of their number that is filled in by the first action on them.

    ``observation.get`` has ``rows`` and, for each of ``columns``, its number of non-null values.
    """
    observation = Observation()
    counts = [F.count(col(c)).alias(c) for c in names_of(columns)]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *counts), observation
