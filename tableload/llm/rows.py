"""Row helpers shared by the operators: Arrow batches in and out, hashing, scratch tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from tableload.workspace import scratch_path

#: Rows of one Arrow batch that a task turns into Python objects at a time.
SLICE = 256

_WORD_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def ship(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package from where the driver has it.

    On a cluster that has the package elsewhere (``--py-files``, an image) the extra path does no harm.
    """
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{known}" if known else home


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: computed once, and readable after an executor is lost."""
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash with what an operator adds."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices_by_size(batches: Iterable[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts in a column have ``size`` bytes at most together, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def map_texts(docs: DataFrame, make: Callable, fields: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the columns ``fields``, computed per text where the row lies; nothing is shuffled.

    ``make()`` runs once per task and returns a function from a list of texts (null becomes empty) to one tuple per
    text.
    """
    ship(docs.sparkSession)
    source = two_columns(docs, id_col, text_col)
    added = _parse_datatype_string(fields)
    schema = StructType([StructField("doc_id", source.schema["doc_id"].dataType), *added.fields])
    types = [_arrow_type(f) for f in added.fields]

    def run(batches):
        work = make()
        for part in slices(batches):
            rows = work([t or "" for t in part.column(1).to_pylist()])
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=schema.names)

    return source.mapInArrow(run, schema)


def keep_texts(docs: DataFrame, make: Callable, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the function that ``make()`` returns accepts."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        work = make()
        for part in slices(batches):
            yield part.filter(pa.array(work([t or "" for t in part.column(at).to_pylist()]), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _arrow_type(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % F.lit(modulus)


def remainder_of(doc_id, modulus: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes do exactly this, and leave other letters alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` neighbours of ``h``."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out + _WORD_GAMMA) + h[k : len(h) - n + 1 + k]
    return mix(out)


def long_schema(names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names.split()])
