"""Data-quality metrics and constraint checks.

All metrics of a call come from one Spark job: one aggregation over one scan for those that need no grouping, and one
grouped count per set of columns whose uniqueness is asked for. Only the metric values reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableload.functions.names import Names, col, cols, names_of
from tableload.operators.writes import Report, write_single_csv

# Report columns, report folders and statuses.
METRIC_COLUMNS = "entity string, instance string, name string, value double"
CHECK_COLUMNS = (
    "check string, check_level string, check_status string, "
    "constraint string, constraint_status string, constraint_message string"
)
CHECK_FOLDER = "verification-results"
METRIC_FOLDER = "verification-results-metrics"
SUCCESS, FAILURE = "Success", "Failure"
WARNING, ERROR = "Warning", "Error"


@dataclass(frozen=True)
class Size:
    """Number of rows."""

    entity, instance, name, columns = "Dataset", "*", "Size", ()

    def value(self) -> Column:
        return F.count(F.lit(1)).cast("double")

    def __str__(self) -> str:
        return "Size(None)"


@dataclass(frozen=True)
class Completeness:
    """Share of rows in which ``column`` is not null."""

    column: str
    entity, name = "Column", "Completeness"

    @property
    def instance(self) -> str:
        return self.column

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def value(self) -> Column:
        return F.try_divide(F.count(col(self.column)), F.count(F.lit(1)))

    def __str__(self) -> str:
        return f"Completeness({self.column},None)"


@dataclass(frozen=True)
class ApproxCountDistinct:
    """Estimated number of distinct values, within relative standard deviation ``rsd``."""

    column: str
    rsd: float = 0.05
    entity, name = "Column", "ApproxCountDistinct"

    @property
    def instance(self) -> str:
        return self.column

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def value(self) -> Column:
        return F.approx_count_distinct(col(self.column), self.rsd).cast("double")

    def __str__(self) -> str:
        return f"ApproxCountDistinct({self.column},None)"


@dataclass(frozen=True)
class Mean:
    """Mean of the values that are numbers; text is read as numbers where it can be."""

    column: str
    entity, name = "Column", "Mean"

    @property
    def instance(self) -> str:
        return self.column

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def value(self) -> Column:
        return F.avg(col(self.column).try_cast("double"))

    def __str__(self) -> str:
        return f"Mean({self.column},None)"


@dataclass(frozen=True)
class NonNegative:
    """Share of rows in which ``column`` is not a negative number; null and text count as zero."""

    column: str
    entity, name = "Column", "Compliance"

    @property
    def instance(self) -> str:
        return f"{self.column} is non-negative"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def matching(self) -> Column:
        # ten digits before the point fit the decimal; the sign of a larger number is right as a double
        exact, wide = (col(self.column).try_cast(kind) for kind in ("decimal(20,10)", "double"))
        return F.count_if(F.coalesce(exact >= 0, wide >= 0, F.lit(True)))

    def value(self) -> Column:
        return F.try_divide(self.matching(), F.count(F.lit(1)))

    def __str__(self) -> str:
        return f"Compliance({self.instance},COALESCE(CAST({self.column} AS DECIMAL(20,10)), 0.0) >= 0,None)"


@dataclass(frozen=True)
class Uniqueness:
    """Share of rows whose values in ``columns`` occur once, among rows where they are not all null."""

    columns: Names
    name = "Uniqueness"

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(names_of(self.columns)))

    @property
    def entity(self) -> str:
        return "Column" if len(self.columns) == 1 else "Multicolumn"

    @property
    def instance(self) -> str:
        return ",".join(self.columns)

    def __str__(self) -> str:
        return f"Uniqueness(List({', '.join(self.columns)}),None)"


Analyzer = Size | Completeness | ApproxCountDistinct | Mean | NonNegative | Uniqueness


@dataclass(frozen=True)
class Metric:
    """The value of an analyzer, or why there is none."""

    analyzer: Analyzer
    value: float | None
    problem: str = ""


def _uniqueness(df: DataFrame, position: int, columns: Sequence[str]) -> DataFrame:
    """One row: the share of once-only values. Tasks count their own rows per value before the shuffle."""
    some_value = reduce(or_, [col(c).isNotNull() for c in columns])
    counts = df.where(some_value).groupBy(*cols(columns)).agg(F.count(F.lit(1)).alias("_rows"))
    once = F.try_divide(F.count_if(F.col("_rows") == 1), F.sum("_rows"))
    return counts.agg(F.lit(position).alias("position"), once.alias("value"))


def metric_values(df: DataFrame, analyzers: Sequence[Analyzer]) -> DataFrame:
    """One row ``position, value`` per analyzer, as a lazy DataFrame."""
    scans = [(i, a) for i, a in enumerate(analyzers) if not isinstance(a, Uniqueness)]
    parts = [_uniqueness(df, i, a.columns) for i, a in enumerate(analyzers) if isinstance(a, Uniqueness)]
    if scans:
        wide = df.agg(*[a.value().alias(f"m{i}") for i, a in scans])
        rows = [F.struct(F.lit(i).alias("position"), F.col(f"m{i}").alias("value")) for i, _ in scans]
        parts.insert(0, wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def run_analyzers(df: DataFrame, analyzers: Sequence[Analyzer]) -> list[Metric]:
    """Compute all metrics in one job. One that asks for a column ``df`` lacks has a problem instead of a value."""
    analyzers = list(dict.fromkeys(analyzers))
    known = [a for a in analyzers if set(a.columns) <= set(df.columns)]
    values = {row.position: row.value for row in metric_values(df, known).collect()} if known else {}
    return with_problems(analyzers, {a: values[i] for i, a in enumerate(known)}, df.columns)


def with_problems(analyzers: Sequence[Analyzer], found: dict[Analyzer, float | None], columns: Sequence[str] = ()) -> list[Metric]:
    """The metrics of the analyzers, with the reason for those that have no value."""
    metrics = []
    for a in analyzers:
        if a not in found:
            missing = ", ".join(c for c in a.columns if c not in columns)
            metrics.append(Metric(a, None, f"Input data does not include column {missing}!"))
        elif found[a] is None:
            metrics.append(Metric(a, None, f"Empty state for analyzer {a}, all input values were NULL."))
        else:
            metrics.append(Metric(a, found[a]))
    return metrics


def metrics_table(spark: SparkSession, metrics: Sequence[Metric]) -> DataFrame:
    """Metrics that have a value, as rows ``entity, instance, name, value``."""
    return metrics_report(metrics).table(spark)


def metrics_report(metrics: Sequence[Metric]) -> Report:
    rows = [(m.analyzer.entity, m.analyzer.instance, m.analyzer.name, m.value) for m in metrics if m.value is not None]
    return Report(tuple(rows), METRIC_COLUMNS)


@dataclass(frozen=True)
class Constraint:
    """A condition on the value of one metric."""

    kind: str
    analyzer: Analyzer
    holds: Callable[[float], bool]

    def __str__(self) -> str:
        return f"{self.kind}Constraint({self.analyzer})"


@dataclass(frozen=True)
class Check:
    """A named group of constraints; ``level`` is its status when one of them fails."""

    level: str
    name: str
    constraints: tuple[Constraint, ...] = ()

    def _with(self, kind: str, analyzer: Analyzer, holds: Callable[[float], bool]) -> Check:
        return replace(self, constraints=(*self.constraints, Constraint(kind, analyzer, holds)))

    def has_size(self, holds: Callable[[int], bool]) -> Check:
        return self._with("Size", Size(), lambda rows: holds(int(rows)))

    def is_complete(self, column: str) -> Check:
        return self._with("Completeness", Completeness(column), lambda share: share == 1.0)

    def is_unique(self, *columns: str) -> Check:
        return self._with("Uniqueness", Uniqueness(columns), lambda share: share == 1.0)

    def is_non_negative(self, column: str) -> Check:
        return self._with("Compliance", NonNegative(column), lambda share: share == 1.0)


@dataclass(frozen=True)
class Verification:
    """Outcome of checks, and the metrics behind it."""

    results: tuple[tuple[str, str, str, str, str, str], ...]
    metrics: tuple[Metric, ...]

    def check_report(self) -> Report:
        return Report(self.results, CHECK_COLUMNS)

    def check_table(self, spark: SparkSession) -> DataFrame:
        return self.check_report().table(spark)

    def metrics_table(self, spark: SparkSession) -> DataFrame:
        return metrics_table(spark, self.metrics)


def verify(df: DataFrame, checks: Sequence[Check]) -> Verification:
    """Evaluate all constraints of all checks on ``df``; a metric several of them need is computed once."""
    return judged(run_analyzers(df, [c.analyzer for check in checks for c in check.constraints]), checks)


def judged(metrics: Sequence[Metric], checks: Sequence[Check]) -> Verification:
    """Evaluate all constraints of all checks on metrics that are known."""
    by_analyzer = {m.analyzer: m for m in metrics}
    results = []
    for check in checks:
        outcomes = []
        for constraint in check.constraints:
            metric = by_analyzer[constraint.analyzer]
            if metric.value is None:
                outcomes.append((str(constraint), FAILURE, metric.problem))
            elif constraint.holds(metric.value):
                outcomes.append((str(constraint), SUCCESS, ""))
            else:
                shown = int(metric.value) if isinstance(constraint.analyzer, Size) else metric.value
                outcomes.append((str(constraint), FAILURE, f"Value: {shown} does not meet the constraint requirement!"))
        status = SUCCESS if all(o[1] == SUCCESS for o in outcomes) else check.level
        results += [(check.name, check.level, status, *o) for o in outcomes]
    return Verification(tuple(results), tuple(metrics))


def write_reports(spark: SparkSession, verification: Verification, path: str) -> None:
    """Write both tables as single CSV files below ``path``."""
    write_single_csv(spark, verification.check_report(), f"{path}/{CHECK_FOLDER}")
    write_single_csv(spark, metrics_report(verification.metrics), f"{path}/{METRIC_FOLDER}")
