"""Expressions over ARRAY<DOUBLE> / ARRAY<FLOAT> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l1_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x).cast("double"))


def is_usable(v: Column) -> Column:
    """A vector that exists and is not all zero."""
    return v.isNotNull() & (F.coalesce(l1_norm(v), F.lit(0.0)) > 0)


def zeros(dim: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
