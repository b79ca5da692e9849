"""Exact order statistics and places in an order, without a task that holds a whole group.

Values are cut into ranges of about equal size by edges from a bounded random sample, which decide how work is dealt out and nothing else. The ranges are counted;
running sums over the counts, one row for a group and range, say how many values lie before each range, and only inside a range are rows
sorted. Small inputs, by the size that Spark estimates, need one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_RANGE = 5_000_000
SAMPLE = 4096  # values on the driver, and so ranges at most
SMALL = 64 << 20  # bytes
Edges = list


def small(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL


def edges(df: DataFrame, value: str, rows: int | None = None) -> Edges:
    """Values between which about `rows` rows lie each, none if one range will do. Of a small df no rows are read unless `rows` is given."""
    if rows is None and small(df):
        return []
    known = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    ranges = min(SAMPLE, -(-known.count() // (rows or ROWS_A_RANGE)))
    if ranges < 2:
        return []
    found = sorted(r["v"] for r in known.orderBy(F.rand(7)).limit(SAMPLE).collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)})


def range_of(value: Column, cuts: Edges) -> Column:
    """How many edges are at or below the value, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    wide = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    literal = lambda row: F.array(*map(F.lit, row))
    group = F.size(F.filter(literal([g[0] for g in groups]), lambda c: c <= value))
    inside = F.get(F.array(*map(literal, groups)), group - 1)
    return F.when(group < 1, 0).otherwise((group - 1) * wide + F.size(F.filter(inside, lambda c: c <= value)))


def ranked(df: DataFrame, keys: list[str], value: str, cuts: Edges = ()) -> DataFrame:
    """(keys, value, times, upto, known, n): each value of a group once, how often it occurs, how many values are at or below it, how many of the group aren't null, and the
    group's rows. Equal values are counted before they are sorted."""
    if cuts:  # a grouping column, so that the optimiser doesn't put the lookup into join conditions
        df = df.withColumn("_range", range_of(F.col(value), cuts))
    counted = df.groupBy(*keys, value, *(["_range"] if cuts else [])).agg(F.count(F.lit(1)).alias("times"))
    real = F.when(F.col(value).isNotNull(), F.col("times")).otherwise(0)
    running = lambda by: by.rowsBetween(Window.unboundedPreceding, 0)
    if not cuts:
        group = Window.partitionBy(*keys)
        return counted.select("*", F.sum(real).over(running(group.orderBy(value))).alias("upto"), F.sum(real).over(group).alias("known"), F.sum("times").over(group).alias("n"))
    sums = counted.groupBy(*keys, "_range").agg(F.sum(real).alias("_real"), F.sum("times").alias("_times"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_real").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_of"), before.alias("_before"), F.sum("_real").over(group).alias("known"), F.sum("_times").over(group).alias("n"))
    same = F.col("_range").eqNullSafe(F.col("_of"))  # a plain equality lets the optimiser carry the lookup of _range to the other side, without its value
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*keys, "_range")
    joined = counted.join(sums, same)
    return joined.select(*keys, value, "times", (F.sum(real).over(running(inside.orderBy(value))) + F.col("_before")).alias("upto"), "known", "n")


def at_place(value: str, place: Column) -> Column:
    """An aggregate over ranked(): the value at a place from 0."""
    return F.min(F.when(F.col("upto") > place, F.col(value)))


def quantile(value: str, q: float) -> Column:
    """An aggregate over ranked(): the quantile at q (known - 1), between two values in proportion."""
    place = (F.col("known") - 1) * F.lit(float(q))
    low, high, part = at_place(value, F.floor(place)), at_place(value, F.ceil(place)), F.max(place - F.floor(place))
    return low * (1 - part) + high * part


def placed(df: DataFrame, order: list[str], name: str, cuts: Edges = ()) -> DataFrame:
    """df with each row's place from 0 in the order, whose first column `cuts` divide; nulls come first."""
    rows = df.withColumn("_range", range_of(F.col(order[0]), cuts))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long") - 1
    if not cuts:
        return rows.withColumn(name, place).drop("_range")
    sums = rows.groupBy(F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))  # SAMPLE rows at most
    sums = sums.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn(name, place).join(sums, F.col("_range").eqNullSafe(F.col("_of"))).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_of", "_before")
