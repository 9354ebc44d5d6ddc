"""Metrics of growing tables from states that are kept per partition and merged.

A state is what a metric needs of some rows: counts, a sum, a sketch of distinct values, or the number of rows per value.
States of disjoint rows merge into that of all of them, so a new partition is read once, and a check over the table reads
states only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableload.functions.names import col, cols
from tableload.operators.quality import (
    Analyzer,
    ApproxCountDistinct,
    Check,
    Completeness,
    Mean,
    Metric,
    NonNegative,
    Size,
    Uniqueness,
    Verification,
    judged,
    with_problems,
)
from tableload.operators.writes import overwrite
from tableload.workspace import fingerprint, remove, subfolders

# Columns of stored states: which metric, its counts and sums, and its sketch.
STATE_COLUMNS = "analyzer string, matching long, counted long, total double, sketch binary"

_ROWS = "_rows"


def _sketch_bits(rsd: float) -> int:
    """Logarithm of the buckets that a sketch of this relative standard deviation has."""
    return min(21, max(4, math.ceil(2 * math.log2(1.04 / rsd))))


def _state(analyzer: Analyzer) -> tuple[Column, Column, Column, Column]:
    """Rows that match, rows that count, the sum and the sketch of an analyzer, as aggregates."""
    none, rows = F.lit(None), F.count(F.lit(1))
    if isinstance(analyzer, Size):
        return rows, rows, none, none
    column = col(analyzer.column)
    if isinstance(analyzer, Completeness):
        return F.count(column), rows, none, none
    if isinstance(analyzer, Mean):
        number = column.try_cast("double")
        return F.count(number), F.count(number), F.sum(number), none
    if isinstance(analyzer, NonNegative):
        return analyzer.matching(), rows, none, none
    return rows, rows, none, F.hll_sketch_agg(column.cast("string"), _sketch_bits(analyzer.rsd))


def _value(analyzer: Analyzer) -> Column:
    """The metric from merged states."""
    if isinstance(analyzer, Size):
        return F.col("matching").cast("double")
    if isinstance(analyzer, Mean):
        return F.try_divide("total", "counted")
    if isinstance(analyzer, ApproxCountDistinct):
        return F.hll_sketch_estimate("sketch").cast("double")
    return F.try_divide("matching", "counted")


def _grouped_folder(states: str, part: str, columns: Sequence[str]) -> str:
    name = hashlib.sha256("\n".join(columns).encode()).hexdigest()[:16]
    return f"{states}/grouped/{name}/part={part}"


def write_states(df: DataFrame, states: str, part: str, analyzers: Sequence[Analyzer]) -> None:
    """Keep the states of the rows of one part of a table, in place of those the part had.

    One aggregation over the rows, and one grouped count for each set of columns whose uniqueness is asked for.
    """
    scans = [a for a in dict.fromkeys(analyzers) if not isinstance(a, Uniqueness)]
    for analyzer in dict.fromkeys(a for a in analyzers if isinstance(a, Uniqueness)):
        counts = df.groupBy(*cols(analyzer.columns)).agg(F.count(F.lit(1)).alias(_ROWS))
        overwrite(counts, _grouped_folder(states, part, analyzer.columns))
    kinds = ("long", "long", "double", "binary")
    found = [[c.cast(kind) for c, kind in zip(_state(a), kinds, strict=True)] for a in scans]
    wide = df.agg(*[F.struct(*[c.alias(f"s{k}") for k, c in enumerate(s)]).alias(f"m{i}") for i, s in enumerate(found)])
    names = ("matching", "counted", "total", "sketch")
    rows = [
        F.struct(F.lit(str(a)).alias("analyzer"), *[F.col(f"m{i}.s{k}").alias(n) for k, n in enumerate(names)])
        for i, a in enumerate(scans)
    ]
    if rows:
        overwrite(wide.select(F.inline(F.array(*rows))), f"{states}/scanned/part={part}")


def metrics_from_states(spark: SparkSession, states: str, analyzers: Sequence[Analyzer]) -> list[Metric]:
    """The metrics of all parts together."""
    analyzers = list(dict.fromkeys(analyzers))
    scans = [a for a in analyzers if not isinstance(a, Uniqueness)]
    values: dict[Analyzer, float | None] = {}
    if scans:
        stored = spark.read.schema(f"{STATE_COLUMNS}, part string").parquet(f"{states}/scanned")
        sums = [F.sum(c).alias(c) for c in ("matching", "counted", "total")]
        by_name = {str(a): a for a in scans}
        distinct = [n for n, a in by_name.items() if isinstance(a, ApproxCountDistinct)]
        merged = stored.where(F.col("analyzer").isin(*by_name)).groupBy("analyzer").agg(*sums)
        sketches = stored.where(F.col("analyzer").isin(*distinct)).groupBy("analyzer")
        merged = merged.join(sketches.agg(F.hll_union_agg("sketch", True).alias("sketch")), "analyzer", "left")
        value = F.coalesce(*[F.when(F.col("analyzer") == n, _value(a)) for n, a in by_name.items()], F.lit(None).cast("double"))
        values = {by_name[r.analyzer]: r.value for r in merged.select("analyzer", value.alias("value")).collect()}
    for a in analyzers:
        if isinstance(a, Uniqueness):
            counts = spark.read.parquet(_grouped_folder(states, "", a.columns).removesuffix("/part="))
            some_value = F.coalesce(*[col(c).cast("string") for c in a.columns]).isNotNull()
            counts = counts.where(some_value).groupBy(*cols(a.columns)).agg(F.sum(_ROWS).alias(_ROWS))
            values[a] = counts.agg(F.try_divide(F.count_if(F.col(_ROWS) == 1), F.sum(_ROWS))).first()[0]
    return with_problems(analyzers, values)


def check_partitions(spark: SparkSession, path: str, states: str, checks: Sequence[Check]) -> Verification:
    """Verify checks on a table partitioned by folders, reading only partitions that are new or have changed.

    A partition is told by its folder and a fingerprint of the listing of its files, and its states are kept under both;
    those of partitions that are gone, or were rewritten, are removed.
    """
    analyzers = [c.analyzer for check in checks for c in check.constraints]
    folders = [n for n in subfolders(spark, path) if "=" in n]
    parts = {f"{hashlib.sha256(n.encode()).hexdigest()[:16]}-{fingerprint(spark, f'{path}/{n}')}": n for n in folders}
    asked = hashlib.sha256("\n".join(sorted(map(str, analyzers))).encode()).hexdigest()[:16]
    states = f"{states}/{asked}"
    done = {n.removeprefix("part=") for n in subfolders(spark, f"{states}/done")}
    for part in sorted(set(parts) - done):
        rows = spark.read.option("basePath", path).parquet(f"{path}/{parts[part]}")
        write_states(rows, states, part, analyzers)
        overwrite(spark.range(0), f"{states}/done/part={part}")
    for part in done - set(parts):
        remove(spark, f"{states}/done/part={part}")
        remove(spark, f"{states}/scanned/part={part}")
        for name in subfolders(spark, f"{states}/grouped"):
            remove(spark, f"{states}/grouped/{name}/part={part}")
    return judged(metrics_from_states(spark, states, analyzers), checks)
