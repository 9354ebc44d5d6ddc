"""A user's SQL text over named tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def sql_transform(
    spark: SparkSession, statements: str | Sequence[str], views: dict[str, DataFrame] | None = None, **args: Any
) -> DataFrame:
    """Run one or several statements in order with ``views`` to name; returns the last one's result.

    The views last as long as the call; one of the caller's that has the same name is back afterwards. Parameters are
    bound as ``:name``, not spliced into the text.
    """
    views = views or {}
    for name, df in views.items():
        if df.sparkSession is not spark:
            raise ValueError(f"{name} comes from another session; pass its .sparkSession")
    known = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    hidden = {name: spark.table(name) for name in views if name.lower() in known}
    result = None
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        for statement in [statements] if isinstance(statements, str) else statements:
            result = spark.sql(statement, args=args)
    finally:
        for name in views:
            if name in hidden:
                hidden[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
    if result is None:
        raise ValueError("no statement to run")
    return result
