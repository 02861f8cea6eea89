"""Window specifications over the long (asset, d) panel, shared so that Spark plans one exchange and sort for them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ordered():
    """An asset's days in order. Windows are made when asked for, since workers import these modules without a session."""
    return Window.partitionBy("asset").orderBy("d")


def so_far():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def from_here():
    return ordered().rowsBetween(0, Window.unboundedFollowing)


def whole():
    return Window.partitionBy("asset")


def rows(n: int):
    """The last n rows, this one included."""
    return ordered().rowsBetween(1 - n, 0)


def full(value: Column, aggregate: Column, n: int) -> Column:
    """The aggregate over the last n rows where all n have a value, else null."""
    return F.when(F.count(value).over(rows(n)) >= n, aggregate)


def forward_filled(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(so_far())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))
