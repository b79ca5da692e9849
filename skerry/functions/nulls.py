"""Null rules of the analytics operators: blanks count as missing in metrics, sums of nothing are zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_blank(df: DataFrame, name: str) -> Column:
    """Null, or an empty string in a text column. Other types are only tested for null, so no cast can fail."""
    missing = F.col(name).isNull()
    return missing | (F.col(name) == "") if dict(df.dtypes)[name] == "string" else missing


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def distinct_with_null(value: Column) -> Column:
    """Distinct values, null counting as one of them."""
    return F.count_distinct(value) + F.coalesce(F.max(F.when(value.isNull(), 1).otherwise(0)), F.lit(0))


def finite(value: Column, digits: int | None = None) -> Column:
    """value rounded; null where it isn't a finite number."""
    kept = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    return kept if digits is None else F.round(kept, digits)
