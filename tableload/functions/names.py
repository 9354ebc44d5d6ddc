"""Columns by their exact names: headers of loaded files may contain dots and backticks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# One column name, or several.
Names = str | Sequence[str]


def names_of(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def cols(names: str | Iterable[str]) -> list[Column]:
    return [col(name) for name in names_of(names)]
