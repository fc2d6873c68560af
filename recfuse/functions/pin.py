"""Keeps costly expressions from being evaluated again by a filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row.

    A filter on an ordinary computed column is pushed below the projection, which evaluates the
    expression in the filter and again in the projection. A one-element explode has the same
    result, costs nothing and is not crossed by filters on its output.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` uses it."""
    return F.try_element_at(F.transform(F.array(value), lambda v: then(v)), F.lit(1))


def unless_empty(items: Column) -> Column:
    """The array, or null when it has no elements; evaluated once."""
    return let(items, lambda a: F.when(F.size(a) > 0, a))
