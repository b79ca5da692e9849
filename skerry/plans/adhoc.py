"""Ad-hoc queries: a small closed vocabulary, checked against the schema, compiled to one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.nulls import distinct_with_null, sum_or_zero
from skerry.functions.times import as_timestamp, bound, literal

AGGREGATES = ("count", "count_distinct", "sum", "avg", "min", "max")
OPERATORS = ("eq", "neq", "in", "not_in", "gt", "gte", "lt", "lte", "is_null", "is_not_null")
MAX_DIMENSIONS, MAX_MEASURES, MAX_FILTERS, MAX_LIMIT, DEFAULT_LIMIT = 3, 4, 5, 500, 200


class QueryError(ValueError):
    """A query that the vocabulary or the schema doesn't allow."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Measure:
    aggregate: str
    column: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or ("count" if self.column is None else f"{self.aggregate}_{self.column}")


@dataclass(frozen=True)
class Query:
    measures: list[Measure]
    dimensions: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    time_column: str | None = None
    time_from: str | None = None
    time_to: str | None = None
    order_by: str | None = None
    descending: bool = False
    limit: int = DEFAULT_LIMIT


def validate(df: DataFrame, q: Query) -> None:
    for what, n, low, most in (("dimensions", len(q.dimensions), 0, MAX_DIMENSIONS), ("measures", len(q.measures), 1, MAX_MEASURES), ("filters", len(q.filters), 0, MAX_FILTERS), ("limit", q.limit, 1, MAX_LIMIT)):
        if not low <= n <= most:
            raise QueryError(f"{what}: {n} is not within {low} to {most}")
    named = [*q.dimensions, *(m.column for m in q.measures if m.column), *(f.column for f in q.filters), *([q.time_column] if q.time_column else [])]
    if unknown := sorted(set(named) - set(df.columns)):
        raise QueryError(f"unknown columns: {unknown}")
    for m in q.measures:
        if m.aggregate not in AGGREGATES or (m.column is None and m.aggregate != "count"):
            raise QueryError(f"no such measure: {m.aggregate} of {m.column}")
    for f in q.filters:
        if f.op not in OPERATORS:
            raise QueryError(f"no such operator: {f.op}")
        if f.op in ("in", "not_in") and not isinstance(f.value, list | tuple):
            raise QueryError(f"{f.op} needs a list")
    outputs = [*q.dimensions, *(m.name for m in q.measures)]
    if len(set(outputs)) < len(outputs):
        raise QueryError("output names repeat")
    if q.order_by and q.order_by not in outputs:
        raise QueryError(f"order_by {q.order_by} is not an output")


def predicate(f: Filter) -> Column:
    c = F.col(f.column)
    return {
        "eq": lambda: c == f.value,
        "neq": lambda: c != f.value,
        "in": lambda: c.isin(list(f.value)),
        "not_in": lambda: ~c.isin(list(f.value)),
        "gt": lambda: c > f.value,
        "gte": lambda: c >= f.value,
        "lt": lambda: c < f.value,
        "lte": lambda: c <= f.value,
        "is_null": c.isNull,
        "is_not_null": c.isNotNull,
    }[f.op]()


def measure(m: Measure) -> Column:
    if m.column is None:
        return F.count(F.lit(1)).alias(m.name)
    c = F.col(m.column)
    made = {"count": F.count, "count_distinct": distinct_with_null, "sum": sum_or_zero, "avg": F.avg, "min": F.min, "max": F.max}[m.aggregate](c)
    return made.alias(m.name)


def in_window(df: DataFrame, column: str, start: str | None, end: str | None) -> Column:
    """Both bounds included; what isn't a time is outside."""
    at = as_timestamp(df, column)
    parts = [at.isNotNull(), *([at >= literal(bound(start))] if start else []), *([at <= literal(bound(end))] if end else [])]
    return reduce(lambda a, b: a & b, parts)


def ordered(df: DataFrame, q: Query) -> DataFrame:
    validate(df, q)
    kept = reduce(lambda d, f: d.where(predicate(f)), q.filters, df)
    if q.time_column:
        kept = kept.where(in_window(df, q.time_column, q.time_from, q.time_to))
    out = kept.groupBy(*q.dimensions).agg(*map(measure, q.measures))
    first = [(F.desc_nulls_last if q.descending else F.asc_nulls_last)(q.order_by)] if q.order_by else []
    rest = [F.asc_nulls_last(d) for d in q.dimensions if d != q.order_by]
    return out.orderBy(*first, *rest) if first or rest else out


def run(df: DataFrame, q: Query) -> DataFrame:
    """The answer, up to limit; the plan reads only the columns it names and sorts with a bounded top-k."""
    return ordered(df, q).limit(q.limit).select(*q.dimensions, *(m.name for m in q.measures))


def run_with_truncation(df: DataFrame, q: Query) -> tuple[list, bool]:
    """The answer's rows (500 at most) and whether there were more."""
    rows = ordered(df, q).limit(q.limit + 1).collect()
    return rows[: q.limit], len(rows) > q.limit
