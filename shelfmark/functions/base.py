"""Two small tools for array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))
