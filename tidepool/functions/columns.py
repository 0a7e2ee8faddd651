"""Helpers for columns that may be absent or have dots in their names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col(f"`{name}`")


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Those of the names that ``df`` has, in the order given."""
    have = set(df.columns)
    return [n for n in names if n in have]


def require(df: DataFrame, names: Iterable[str]) -> None:
    """Raise KeyError if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
