"""Rounding, clipping and comparison rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(column: Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines; minus zero becomes zero."""
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def half_even(column: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(column.cast("double")).cast("long")


def truncated(column: Column) -> Column:
    """Integer part, toward zero."""
    return column.cast("int")


def clip(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def first_argmax(values: Column) -> Column:
    """Place (from 0) of the first largest element of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def first_given(*columns: Column) -> Column:
    """Explicit setting, else stored setting, else default."""
    return F.coalesce(*columns)
