"""SQL tables: creation at a location, and inserts by position or by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableload.functions.names import Names, col, cols, names_of, quoted
from tableload.operators.writes import overwrite, overwrite_partitions
from tableload.workspace import remove, scratch_path


def _table(name: str) -> str:
    """``db.table`` with each part quoted."""
    return ".".join(quoted(part) for part in name.split("."))


def create_table(
    spark: SparkSession,
    name: str,
    schema: StructType,
    location: str | None = None,
    partition_by: Names = (),
    properties: dict[str, str] | None = None,
    format: str = "parquet",
    if_not_exists: bool = True,
) -> None:
    """Create an external table at ``location`` (a managed one without), partitioned by columns of its schema."""
    clauses, args = [], {"name": _table(name)}
    if partition_by:
        clauses.append(f"PARTITIONED BY ({', '.join(map(quoted, names_of(partition_by)))})")
    if location is not None:
        clauses.append("LOCATION :location")
        args["location"] = location
    if properties:
        pairs = []
        for i, (key, value) in enumerate(properties.items()):
            pairs.append(f":key{i} = :value{i}")
            args |= {f"key{i}": key, f"value{i}": value}
        clauses.append(f"TBLPROPERTIES ({', '.join(pairs)})")
    spark.sql(
        f"CREATE TABLE {'IF NOT EXISTS' if if_not_exists else ''} IDENTIFIER(:name) ({schema.toDDL()}) "
        f"USING {quoted(format)} {' '.join(clauses)}",
        args=args,
    )


def insert_all(df: DataFrame, name: str) -> None:
    """Insert by position: the first column into the first column, whatever their names are."""
    df.write.insertInto(_table(name))


def insert_by_name(df: DataFrame, name: str, columns: Names | None = None) -> None:
    """Insert ``columns`` of ``df`` (all by default) into the columns of the same names; others become null."""
    rows = df if columns is None else df.select(*cols(columns))
    df.sparkSession.sql(
        "INSERT INTO IDENTIFIER(:name) BY NAME SELECT * FROM {rows}", args={"name": _table(name)}, rows=rows
    )


def point_table(spark: SparkSession, name: str, schema: StructType, location: str) -> None:
    """Let an external table show the files at ``location``.

    Columns that the table lacks are added to it, so that readers by name always find it, and its properties stay. Only a
    table with columns that the files lack or have in another type is created anew.
    """
    if not spark.catalog.tableExists(name):
        create_table(spark, name, schema, location)
        return
    if _other_columns(spark, name, schema):
        spark.sql("DROP TABLE IDENTIFIER(:name)", {"name": _table(name)})
        create_table(spark, name, schema, location)
        return
    add_columns(spark, name, schema)
    spark.sql("ALTER TABLE IDENTIFIER(:name) SET LOCATION :location", {"name": _table(name), "location": location})
    spark.catalog.refreshTable(_table(name))


def add_columns(spark: SparkSession, name: str, schema: StructType) -> None:
    """Add to a table the columns of ``schema`` that it lacks; the others have to be as they are there."""
    other = _other_columns(spark, name, schema)
    if other:
        raise ValueError(f"table {name} has columns {other} that the rows lack or have in another type")
    stored = set(spark.table(_table(name)).columns)
    new = StructType([f for f in schema if f.name not in stored])
    if new.fields:
        spark.sql(f"ALTER TABLE IDENTIFIER(:name) ADD COLUMNS ({new.toDDL()})", {"name": _table(name)})


def _other_columns(spark: SparkSession, name: str, schema: StructType) -> list[str]:
    """Columns of a table that ``schema`` lacks or has in another type."""
    given = {f.name: f.dataType for f in schema}
    return [f.name for f in spark.table(_table(name)).schema if given.get(f.name) != f.dataType]


def drop_partitions(spark: SparkSession, name: str, partition_by: Sequence[str], values: list) -> None:
    """Take partitions whose folders are gone, given by their values as text, out of the table's catalog entry."""
    if any(v is None for row in values for v in row):
        spark.sql("MSCK REPAIR TABLE IDENTIFIER(:name) SYNC PARTITIONS", {"name": _table(name)})
    else:
        for row in values:
            args = {"name": _table(name)} | {f"v{i}": v for i, v in enumerate(row)}
            spec = ", ".join(f"{quoted(c)} = :v{i}" for i, c in enumerate(names_of(partition_by)))
            spark.sql(f"ALTER TABLE IDENTIFIER(:name) DROP IF EXISTS PARTITION ({spec})", args)
    spark.catalog.refreshTable(_table(name))


def add_partitions(spark: SparkSession, name: str, partition_by: Sequence[str], values: list | None) -> None:
    """Register partitions, given by their values as text, that the table's catalog entry lacks; all that lie there
    when ``values`` is None. Null values are found by listing."""
    if values is None or any(v is None for row in values for v in row):
        spark.catalog.recoverPartitions(_table(name))
    else:
        columns = names_of(partition_by)
        for start in range(0, len(values), 500):
            specs, args = [], {"name": _table(name)}
            for k, row in enumerate(values[start : start + 500]):
                args |= {f"v{k}_{i}": v for i, v in enumerate(row)}
                specs.append("PARTITION (" + ", ".join(f"{quoted(c)} = :v{k}_{i}" for i, c in enumerate(columns)) + ")")
            spark.sql(f"ALTER TABLE IDENTIFIER(:name) ADD IF NOT EXISTS {' '.join(specs)}", args)
    spark.catalog.refreshTable(_table(name))


def replace_partitions(df: DataFrame, name: str) -> None:
    """Replace, by name, the partitions of a table that ``df`` has rows for; new ones are registered in the catalog.

    ``df`` is computed once, into the scratch folder; the files are then written to the table's location, with the mode as
    an option of this write alone. Columns that ``df`` lacks become null. ``df`` may read the table.
    """
    spark = df.sparkSession
    described = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED IDENTIFIER(:name)", {"name": _table(name)}).collect()}
    partition_by = [c.name for c in spark.catalog.listColumns(_table(name)) if c.isPartition]
    schema = spark.table(_table(name)).schema
    unknown = set(df.columns) - set(schema.names)
    if unknown or not set(partition_by) <= set(df.columns):
        raise ValueError(f"columns {df.columns} do not fit the table's {schema.names}")
    rows = df.select(
        *[(col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )
    path = scratch_path(spark, "partitions")
    try:
        overwrite(rows, path)
        staged = spark.read.schema(schema).parquet(path)
        values = [list(r) for r in staged.select(*[col(c).cast("string") for c in partition_by]).distinct().collect()]
        overwrite_partitions(staged, described["Location"], partition_by, described["Provider"].lower())
        add_partitions(spark, name, partition_by, values)
    finally:
        remove(spark, path)
