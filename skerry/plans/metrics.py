"""Certified metrics: counts, ratios of totals and duration percentiles over a half-open window."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.nulls import is_blank
from skerry.functions.times import UNIT_SECONDS, as_timestamp, bound, bucket, literal, seconds_between
from skerry.operators.selection import edges, quantile, ranked
from skerry.plans.adhoc import Filter, QueryError

KINDS = ("count", "ratio", "duration_percentile")
OPERATORS = ("is_not_null", "is_null", "eq", "not_in", "in", "lt", "gte")
DEFAULT_LIMIT = 100
MAX_BUCKETS = 730


@dataclass(frozen=True)
class Metric:
    kind: str
    time_basis: str
    eligibility: list[Filter] = field(default_factory=list)
    numerator: list[Filter] = field(default_factory=list)
    denominator: list[Filter] = field(default_factory=list)
    start: str | None = None
    end: str | None = None
    quantile: float = 0.5
    unit: str = "hours"
    timezone: str = "UTC"


def predicate(df: DataFrame, f: Filter) -> Column:
    """Blank-aware tests; a comparison with a missing value is false."""
    if f.op not in OPERATORS:
        raise QueryError(f"no such metric operator: {f.op}")
    c, blank = F.col(f.column), is_blank(df, f.column)
    if f.op == "is_null":
        return blank
    test = {
        "is_not_null": lambda: ~blank,
        "eq": lambda: c == f.value,
        "in": lambda: c.isin(list(f.value)),
        "not_in": lambda: ~c.isin(list(f.value)),
        "lt": lambda: c < f.value,
        "gte": lambda: c >= f.value,
    }[f.op]()
    return F.coalesce(test, F.lit(False))


def all_of(df: DataFrame, filters: list[Filter]) -> Column:
    return reduce(lambda a, b: a & b, (predicate(df, f) for f in filters), F.lit(True))


def population(df: DataFrame, m: Metric, start: str, end: str, filters: list[Filter] = ()) -> DataFrame:
    """Eligible rows in [start, end); bounds without an offset are in the metric's time zone."""
    at = as_timestamp(df, m.time_basis)
    window = (at >= literal(bound(start, m.timezone))) & (at < literal(bound(end, m.timezone)))
    return df.where(window).where(all_of(df, [*m.eligibility, *filters]))


def expressions(df: DataFrame, m: Metric) -> list[Column]:
    """value, and for a ratio its totals and whether the denominator was zero: the one place where metrics are compiled."""
    if m.kind == "count":
        return [F.count_if(all_of(df, m.numerator)).alias("value")]
    if m.kind == "ratio":
        over, under = F.count_if(all_of(df, [*m.denominator, *m.numerator])), F.count_if(all_of(df, m.denominator))
        return [F.round(F.try_divide(over, under), 6).alias("value"), over.alias("numerator"), under.alias("denominator"), (under == 0).alias("zero_denominator")]
    raise QueryError(f"no such metric operator: {f.op}")
    c, blank = F.col(f.column), is_blank(df, f.column)
    if f.op == "is_null":
        return blank
    test = {
        "is_not_null": lambda: ~blank,
        "eq": lambda: c == f.value,
        "in": lambda: c.isin(list(f.value)),
        "not_in": lambda: ~c.isin(list(f.value)),
        "lt": lambda: c < f.value,
        "gte": lambda: c >= f.value,
    }[f.op]()
    return F.coalesce(test, F.lit(False))


def all_of(df: DataFrame, filters: list[Filter]) -> Column:
    return reduce(lambda a, b: a & b, (predicate(df, f) for f in filters), F.lit(True))


def population(df: DataFrame, m: Metric, start: str, end: str, filters: list[Filter] = ()) -> DataFrame:
    """Eligible rows in [start, end); bounds without an offset are in the metric's time zone."""
    at = as_timestamp(df, m.time_basis)
    window = (at >= literal(bound(start, m.timezone))) & (at < literal(bound(end, m.timezone)))
    return df.where(window).where(all_of(df, [*m.eligibility, *filters]))


def expressions(df: DataFrame, m: Metric) -> list[Column]:
    """value, and for a ratio its totals and whether the denominator was zero: the one place where metrics are compiled."""
    if m.kind == "count":
        return [F.count_if(all_of(df, m.numerator)).alias("value")]
    if m.kind == "ratio":
        over, under = F.count_if(all_of(df, [*m.denominator, *m.numerator])), F.count_if(all_of(df, m.denominator))
        return [F.round(F.try_divide(over, under), 6).alias("value"), over.alias("numerator"), under.alias("denominator"), (under == 0).alias("zero_denominator")]
    if m.kind == "duration_percentile":
        span = seconds_between(as_timestamp(df, m.start), as_timestamp(df, m.end)) / F.lit(UNIT_SECONDS[m.unit])
        return [F.round(F.percentile(span, F.lit(m.quantile)), 4).alias("value"), F.count(span).alias("n")]
    raise QueryError(f"no such metric: {m.kind}")


def measured(rows: DataFrame, keys: dict[str, Column], df: DataFrame, m: Metric) -> DataFrame:
    """The metric of each group of rows. Percentiles are selected over counted ranges, so no group's durations are gathered."""
    if m.kind != "duration_percentile":
        return rows.groupBy(*(c.alias(k) for k, c in keys.items())).agg(*expressions(df, m))
    span = seconds_between(as_timestamp(df, m.start), as_timestamp(df, m.end)) / F.lit(UNIT_SECONDS[m.unit])
    spans = rows.select(*(c.alias(k) for k, c in keys.items()), span.alias("_span"))
    known = ranked(spans, list(keys), "_span", edges(spans, "_span"))
    return known.groupBy(*keys).agg(F.round(quantile("_span", m.quantile), 4).alias("value"), F.coalesce(F.max("known"), F.lit(0)).cast("long").alias("n"))


def execute(df: DataFrame, m: Metric, start: str, end: str, dimensions: list[str] = (), filters: list[Filter] = (), limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Sorted by the dimensions, then cut to limit."""
    out = measured(population(df, m, start, end, filters), {d: F.col(d) for d in dimensions}, df, m)
    return out.orderBy(*(F.asc_nulls_last(d) for d in dimensions)).limit(limit) if dimensions else out


def series(df: DataFrame, m: Metric, frequency: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(ds, y): one row for every bucket that has rows, the last MAX_BUCKETS of them."""
    at = as_timestamp(df, m.time_basis)
    rows = df.where(all_of(df, m.eligibility)).where(at.isNotNull())
    if start:
        rows = rows.where(at >= literal(bound(start, m.timezone)))
    if end:
        rows = rows.where(at < literal(bound(end, m.timezone)))
    out = measured(rows, {"ds": bucket(at, frequency)}, df, m).select("ds", F.col("value").cast("double").alias("y"))
    return out.where("y IS NOT NULL").orderBy(F.desc("ds")).limit(MAX_BUCKETS).orderBy("ds")


def numbered(points: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, i, ds, y): places from 0 in each series; repeated times are averaged first."""
    once = points.groupBy(*keys, "ds").agg(F.avg("y").alias("y"))
    return once.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("ds")) - 1)
