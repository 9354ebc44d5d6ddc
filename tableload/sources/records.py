"""Stream records: envelopes of base64 JSON payloads, and lists of decoded records."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tableload.functions.columns import decode_base64
from tableload.functions.names import Names, cols, names_of, quoted
from tableload.operators.writes import MICROSECONDS

# Fixed value: shape of a stream event.
ENVELOPE_DDL = "Records array<struct<kinesis:struct<data:string>>>"

# Column of records decoded without a schema: their values as text, by payload key.
PAYLOAD = "payload"

BAD_RECORD = "_bad_record"
_CORRUPT = "_corrupt"


def open_envelopes(envelopes: DataFrame, column: str = "value") -> DataFrame:
    """One row per record of JSON event texts: ``_payload`` as text, and ``_raw`` as it came.

    An unreadable event stays as one row without payload; an event with an empty record list has no rows.
    """
    def with_text(record: Column) -> Column:
        data = record["kinesis"]["data"]
        return F.struct(data.alias("data"), F.coalesce(data, F.to_json(record)).alias("text"))

    records = F.transform(F.from_json(column, ENVELOPE_DDL)["Records"], with_text)
    unreadable = F.array(F.struct(F.lit(None).cast("string").alias("data"), F.col(column).alias("text")))
    # An outer explode: for an inner one the planner adds a filter on the list's size, which parses every event twice.
    return (
        envelopes.select(F.explode_outer(F.coalesce(records, unreadable)).alias("_record"))
        .where(F.col("_record").isNotNull())
        .select(decode_base64(F.col("_record.data")).alias("_payload"), F.col("_record.text").alias("_raw"))
    )


def _parse_map(payloads: DataFrame, required: Names) -> DataFrame:
    values = F.from_json("_payload", "map<string,string>")
    df = payloads.select(values.alias(PAYLOAD), "_raw")
    bad = F.col(PAYLOAD).isNull()
    for name in names_of(required):
        bad = bad | F.try_element_at(PAYLOAD, F.lit(name)).isNull()
    return df.select(PAYLOAD, F.when(bad, F.coalesce("_raw", F.lit(""))).alias(BAD_RECORD))


def _parse(payloads: DataFrame, schema: StructType | None, required: Names) -> DataFrame:
    if schema is None:
        return _parse_map(payloads, required)
    parsed = F.from_json(
        "_payload",
        StructType([*schema.fields, StructField(_CORRUPT, StringType())]),
        {"columnNameOfCorruptRecord": _CORRUPT},
    )
    df = payloads.select(parsed.alias("_r"), "_raw")
    bad = F.col("_r").isNull() | F.col(f"_r.{_CORRUPT}").isNotNull()
    for name in names_of(required):
        bad = bad | F.col(f"_r.{quoted(name)}").isNull()
    return df.select(
        *[F.col(f"_r.{quoted(f.name)}").alias(f.name) for f in schema],
        F.when(bad, F.coalesce("_raw", F.lit(""))).alias(BAD_RECORD),
    )


def decode_envelope(
    envelopes: DataFrame,
    schema: StructType | None = None,
    required: Names = (),
    column: str = "value",
) -> DataFrame:
    """One typed row per record, plus ``_bad_record`` holding the raw text of records that cannot be used.

    A record is bad when its base64, UTF-8 or JSON is broken, a value does not fit its type, or a ``required`` column
    is null. Without ``schema`` the one column ``payload`` maps the keys of each record to their values as text.
    Decoding is done by built-in expressions in the tasks that read the events; split the result with ``good_records``
    and ``bad_records``.
    """
    return _parse(open_envelopes(envelopes, column), schema, required)


def good_records(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD)


def bad_records(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col(BAD_RECORD).isNotNull()).select(BAD_RECORD)


def only_good_records(decoded: DataFrame) -> DataFrame:
    """All records; the job fails when one of them is bad."""
    fail = F.raise_error(F.lit("a record cannot be decoded"))
    return decoded.where(F.when(F.col(BAD_RECORD).isNotNull(), fail).otherwise(F.lit(True))).drop(BAD_RECORD)


def records_to_table(
    spark: SparkSession,
    records: list[dict[str, Any]] | DataFrame,
    schema: StructType | None = None,
    column: str = "value",
) -> DataFrame:
    """Records as a table: a driver list of dicts, or a DataFrame of JSON object texts in ``column``.

    The list is for one event's payload. Keys a record lacks are null. Without ``schema`` a list is inferred by Spark,
    and texts give one column ``payload`` that maps keys to values as text. A text that is no such object fails the job.
    """
    if not isinstance(records, DataFrame):
        return spark.createDataFrame(records, schema)
    payloads = records.select(F.col(column).alias("_payload"), F.col(column).alias("_raw"))
    return only_good_records(_parse(payloads, schema, ()))


def encode_envelope(df: DataFrame, records_per_event: int = 1) -> DataFrame:
    """The inverse of ``decode_envelope``, as a producer does it: event texts in column ``value``.

    Each row becomes an event where it lies. With more ``records_per_event``, runs of that many rows of a task share
    one; the encoded records are then shuffled, a run at a time.
    """
    payload = F.to_json(F.struct(*cols(df.columns)), MICROSECONDS)
    data = F.replace(F.base64(F.encode(payload, "UTF-8")), F.lit("\r\n"), F.lit(""))
    record = F.struct(F.struct(data.alias("data")).alias("kinesis"))
    if records_per_event == 1:
        records = df.select(F.array(record).alias("Records"))
    else:
        # the id's lower bits number the rows of a task, its upper bits the tasks
        row = F.monotonically_increasing_id()
        number = F.struct(F.shiftright(row, 33), (row.bitwiseAND(F.lit((1 << 33) - 1)) / records_per_event).cast("long"))
        runs = df.select(record.alias("_record"), number.alias("_run"))
        records = runs.groupBy("_run").agg(F.collect_list("_record").alias("Records")).drop("_run")
    return records.select(F.to_json(F.struct("Records")).alias("value"))
