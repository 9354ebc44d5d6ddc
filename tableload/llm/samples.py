"""Bounded samples of labelled documents, drawn by a hash of the id, and fits on them.

A fit runs in a task: only the model comes to the driver, what it was fitted on is gone with the task, and a task that is
lost is run again on the same examples in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableload.llm.rows import ship, written


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int, left_out: int, extra: list[str]) -> DataFrame:
    """``doc_id, text, label`` and ``extra`` of at most ``rows`` labelled documents whose crc32 (id as text) modulo
    ``modulus`` is not ``left_out``. The ids drawn are bounded by ``rows``, so they are broadcast to the documents. Of an id
    with several labels the smallest counts, of one with several texts the smallest text with its other columns."""
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    drawn = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (left != left_out))
    drawn = drawn.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    wanted = docs.select("doc_id", F.col("text").cast("string").alias("text"), *extra)
    found = wanted.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", *extra)).alias("of"))
    return found.select("doc_id", "of.*", "label")


def fitted(examples: DataFrame, learn: Callable[[pa.Table], tuple[bytes, pa.Array]]) -> tuple[bytes, DataFrame]:
    """What ``learn`` makes of all examples, ordered by id, in one task: a model as bytes and the ids it has used."""
    ship(examples.sparkSession)
    kind = examples.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            model, used = learn(pa.Table.from_batches(held).combine_chunks().sort_by("doc_id"))
            ids = pa.concat_arrays([pa.nulls(1, used.type), used])
            models = pa.array([model, *[None] * len(used)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, models], names=["doc_id", "model"])

    found = written(examples.repartition(1).mapInArrow(run, f"doc_id {kind}, model binary"), "model")
    row = found.where(F.col("model").isNotNull()).select("model").first()
    return (bytes(row.model) if row else b""), found.where(F.col("model").isNull()).select("doc_id")
