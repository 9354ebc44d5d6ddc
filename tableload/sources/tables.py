"""Typed files, views, SQL tables and tables described by a catalog entry."""

from __future__ import annotations

from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ArrayType,
    ByteType,
    CharType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
    VarcharType,
)

from tableload.sources.delimited import scan_csv
from tableload.workspace import first_file

# What a catalog type without parameters stands for.
BARE_TYPES = {
    "decimal": DecimalType(),
    "array": ArrayType(StringType()),
    "map": MapType(StringType(), StringType()),
    "struct": StructType(),
}

# Stored Parquet type -> declared types Spark can read it as without loss.
_WIDENS_TO = {
    ByteType: (ShortType, IntegerType, LongType, DoubleType),
    ShortType: (IntegerType, LongType, DoubleType),
    IntegerType: (LongType, DoubleType),
    FloatType: (DoubleType,),
    DateType: (TimestampNTZType,),
    TimestampNTZType: (TimestampType,),
    TimestampType: (TimestampNTZType,),
}


def scan(spark: SparkSession, path: str, format: str = "parquet", **options: str | bool) -> DataFrame:
    """Read files of any format the session has a reader for; CSV has a header unless ``header=False`` says otherwise."""
    if format == "csv" and str(options.get("header", True)).lower() == "true":
        return scan_csv(spark, path, str(options.pop("sep", options.pop("delimiter", ","))), **options)
    return spark.read.format(format).options(**options).load(path)


def scan_view(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def _readable(stored: DataType, declared: DataType) -> bool:
    if isinstance(stored, (ArrayType, MapType, StructType)) or isinstance(declared, (ArrayType, MapType, StructType)):
        return type(stored) is type(declared)
    if isinstance(stored, DecimalType) and isinstance(declared, DecimalType):
        return declared.scale >= stored.scale and declared.precision - declared.scale >= stored.precision - stored.scale
    return type(stored) is type(declared) or isinstance(declared, _WIDENS_TO.get(type(stored), ()))


def scan_parquet(
    spark: SparkSession, path: str, schema: StructType | None = None, check_types: bool = True
) -> DataFrame:
    """Read Parquet with a declared schema: other columns are not read, absent ones come back null.

    ``check_types`` compares the schema with the footer of one file and names the columns that cannot be read as
    declared, instead of failing in a task.
    """
    if schema is None:
        return spark.read.parquet(path)
    if not schema.fields:
        raise ValueError("a schema without columns reads nothing")
    file = first_file(spark, path) if check_types else None
    if file is not None:
        stored = {f.name.lower(): f.dataType for f in spark.read.parquet(file).schema}
        clashes = [
            f"{f.name}: stored {stored[f.name.lower()].simpleString()}, declared {f.dataType.simpleString()}"
            for f in schema
            if f.name.lower() in stored and not _readable(stored[f.name.lower()], f.dataType)
        ]
        if clashes:
            raise TypeError("columns not readable as declared: " + "; ".join(clashes))
    return spark.read.schema(schema).parquet(path)


def _plain(data_type: DataType) -> DataType:
    """The same type with char and varchar as string, which is how a reader takes them."""
    if isinstance(data_type, (CharType, VarcharType)):
        return StringType()
    if isinstance(data_type, ArrayType):
        return ArrayType(_plain(data_type.elementType), data_type.containsNull)
    if isinstance(data_type, MapType):
        return MapType(_plain(data_type.keyType), _plain(data_type.valueType), data_type.valueContainsNull)
    if isinstance(data_type, StructType):
        return StructType([StructField(f.name, _plain(f.dataType), f.nullable) for f in data_type])
    return data_type


def catalog_type(text: str | None) -> DataType:
    """Spark type of a catalog type name; string when it is missing or unknown."""
    if text is None:
        return StringType()
    text = text.strip()
    if text.lower() in BARE_TYPES:
        return BARE_TYPES[text.lower()]
    try:
        fields = StructType.fromDDL(f"`c` {text}").fields
    except ParseException:
        return StringType()
    return _plain(fields[0].dataType) if len(fields) == 1 else StringType()


def catalog_schema(columns: list[dict[str, str]]) -> StructType:
    """Schema of a catalog column list ``[{"Name": ..., "Type": ...}, ...]``."""
    if not columns:
        raise ValueError("the catalog entry lists no columns")
    return StructType([StructField(c["Name"], catalog_type(c.get("Type"))) for c in columns])


def scan_catalog_entry(spark: SparkSession, entry: dict[str, Any], format: str = "parquet") -> DataFrame:
    """Read the table an entry describes: its columns as the schema, its location as the path."""
    try:
        storage = entry["Table"]["StorageDescriptor"]
        columns, location = storage["Columns"], storage["Location"]
    except (KeyError, TypeError):
        raise ValueError("the entry needs Table.StorageDescriptor with Columns and Location") from None
    schema = catalog_schema(columns)
    if format == "parquet":
        return scan_parquet(spark, location, schema)
    return spark.read.format(format).schema(schema).load(location)


def scan_catalog_table(spark: SparkSession, database: str, table: str) -> DataFrame:
    """Read a table by its name in the session's catalog."""
    if not spark.catalog.tableExists(f"`{database}`.`{table}`"):
        raise ValueError(f"no table {table} in database {database}")
    return spark.table(f"`{database}`.`{table}`")
