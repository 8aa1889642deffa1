"""Expressions over small bounded arrays: medians, bins and ordered checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def median_of_sorted(values: Column) -> Column:
    """Median of a sorted array; null for an empty one."""
    n = F.size(values)
    low = F.try_element_at(values, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(values, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (low + high) / F.lit(2.0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda re-evaluates everything it captures for each element, and the
    optimizer may inline a staged column into it.  Binding the value as the
    only element of an array keeps nested array work linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """A generator of one row with ``value``, for costly values that filters and columns read.

    A filter on a plain column is pushed below it and computes its value again; it stays above
    a generator.
    """
    return F.explode(F.array(value))


def median(values: Column) -> Column:
    return let(F.sort_array(values), median_of_sorted)


def median_absolute_deviation(values: Column, center: Column) -> Column:
    return let(center, lambda c: median(F.transform(values, lambda v: F.abs(v - c))))


def adjacent(values: Column, combine) -> Column:
    """``combine(previous, next)`` for every neighbouring pair, in order."""
    def pairs(v):
        length = F.greatest(F.size(v) - 1, F.lit(0))
        return F.zip_with(F.slice(v, 1, length), F.slice(v, 2, length), combine)

    return let(values, pairs)


def has_duplicates(values: Column) -> Column:
    return let(values, lambda v: F.size(F.array_distinct(v)) != F.size(v))
