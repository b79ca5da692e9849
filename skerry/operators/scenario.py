"""Scenarios: what queues would do under other service times, as windows over the arrivals.

A single server takes arrivals in order. The n-th ends at P(n) + max over k <= n of (arrival(k) - P(k - 1)), where P sums service
times: a running sum and a running maximum, so a queue is windows over ranges of its time and no event is simulated by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.selection import Edges, edges, range_of

# What a user can start from.
TEMPLATES = ("capacity_allocation", "overtime_relief", "backlog_burndown", "arrival_surge", "cross_training")


def queue_waits(arrivals: DataFrame, queue: str, at: str, service: str, place: str, cuts: Edges | None = None) -> DataFrame:
    """arrivals (queue, at: seconds, service: seconds, place breaks ties) with starts, ends and waits of each. Rows without a time or
    a service are left out.

    Sums and maxima compose, so a queue's time is cut into ranges (`cuts`, by default edges of equal size for a large input): windows run inside a range, and
    one row for a queue and range carries the service time before it and the largest term of the ranges before it."""
    rows = arrivals.where(F.col(at).isNotNull() & F.col(service).isNotNull())
    cuts = edges(rows, at) if cuts is None else cuts
    rows = rows.withColumn("_range", range_of(F.col(at), cuts))
    order = Window.partitionBy(queue, "_range").orderBy(at, place).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_done", F.sum(service).over(order))
    rows = rows.withColumn("_most", F.max(F.col(at) - (F.col("_done") - F.col(service))).over(order))
    before, most = F.lit(0), F.col("_most")
    if cuts:
        ranges = rows.groupBy(F.col(queue).alias("_queue"), F.col("_range").alias("_of")).agg(F.sum(service).alias("_all"), F.max("_most").alias("_top"))
        earlier = Window.partitionBy("_queue").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
        ranges = ranges.withColumn("_carried", F.max(F.col("_top") - F.col("_before")).over(earlier)).drop("_all", "_top")
        rows = rows.join(ranges, F.col(queue).eqNullSafe(F.col("_queue")) & F.col("_range").eqNullSafe(F.col("_of")))
        before, most = F.col("_before"), F.greatest("_carried", F.col("_most") - F.col("_before"))
    rows = rows.withColumn("ends", before + F.col("_done") + most).withColumn("starts", F.col("ends") - F.col(service))
    return rows.withColumn("waits", F.col("starts") - F.col(at)).drop("_done", "_most", "_range", "_queue", "_of", "_before", "_carried")


def templates(spark) -> DataFrame:
    return spark.createDataFrame([(t, t == "capacity_allocation") for t in TEMPLATES], "template string, has_fixture boolean")
