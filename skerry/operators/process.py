"""Process mining over event logs: one row per event, windows per case, no trace objects.

A case's window is sorted within its key only; everything after it is a hash aggregate with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.times import UNIT_SECONDS, as_timestamp, literal, seconds_between
from skerry.operators.selection import Edges, at_place, edges, quantile, ranked

# Activities that close a case unless the caller names others.
CLOSED = ("closed", "resolved", "completed", "done", "cancelled")


def event_log(df: DataFrame, case: str, event: str, at: str, tiebreak: str) -> DataFrame:
    """(case_id, event, ts, place): rows without any of the first three are left out; equal times go by tiebreak."""
    picked = df.select(F.col(case).cast("string").alias("case_id"), F.col(event).cast("string").alias("event"), as_timestamp(df, at).alias("ts"), F.col(tiebreak).alias("place"))
    return picked.dropna(subset=["case_id", "event", "ts"])


def with_neighbours(log: DataFrame) -> DataFrame:
    order = Window.partitionBy("case_id").orderBy("ts", "place")
    before, after = F.lag("ts").over(order), F.lead("ts").over(order)
    return log.select("*", seconds_between(before, F.col("ts")).alias("waiting_s"), seconds_between(F.col("ts"), after).alias("duration_s"), F.lag("event").over(order).alias("prev_event"), F.lead("event").over(order).alias("next_event"))


def bottlenecks(log: DataFrame, unit: str = "hours", cuts: Edges | None = None) -> DataFrame:
    """A case's last event counts but has no duration, its first one no waiting time. Medians are selected over counted ranges."""
    spans = F.array(F.struct(F.lit("d").alias("side"), (F.col("duration_s") / UNIT_SECONDS[unit]).alias("span")), F.struct(F.lit("w").alias("side"), (F.col("waiting_s") / UNIT_SECONDS[unit]).alias("span")))
    times = with_neighbours(log).select("event", F.explode(spans).alias("x")).select("event", "x.*")
    known = ranked(times, ["event", "side"], "span", edges(times, "span") if cuts is None else cuts)
    sides = known.groupBy("event", "side").agg(F.max("n").alias("n"), quantile("span", 0.5).alias("mid"), F.try_divide(F.sum(F.col("span") * F.col("times")), F.max("known")).alias("avg"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    out = sides.groupBy(F.col("event").alias("activity")).agg(F.max("n").alias("n"), F.round(of("d", "mid"), 3).alias("median"), F.round(of("d", "avg"), 3).alias("avg"), F.round(of("w", "mid"), 3).alias("waiting_time"))
    return out.orderBy(F.desc_nulls_last("median"), "activity")


def traces(log: DataFrame) -> DataFrame:
    """(case_id, path)."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "place", "event")))
    return log.groupBy("case_id").agg(F.transform(steps, lambda x: x.event).alias("path"))


def collapsed(path: Column | str) -> Column:
    """A path without its immediate repeats."""
    path = F.col(path) if isinstance(path, str) else path
    return F.transform(F.filter(F.arrays_zip(path.alias("now"), F.concat(F.array(F.lit(None).cast("string")), path).alias("before")), lambda x: x.now.isNotNull() & ~x.now.eqNullSafe(x.before)), lambda x: x.now)


def variants(log: DataFrame) -> DataFrame:
    """Paths by the number of cases that take them; ties go to the one whose first case comes first."""
    grouped = traces(log).groupBy("path").agg(F.count(F.lit(1)).alias("case_count"), F.min("case_id").alias("first_case"))
    total = log.agg(F.count_distinct("case_id"))
    out = grouped.select("path", collapsed("path").alias("simplified_path"), "case_count", F.round(F.col("case_count") / total.scalar(), 4).alias("frequency"), "first_case")
    return out.orderBy(F.desc("case_count"), "first_case")


def transitions(log: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """(case_id, ts, place, from_activity, to_activity, allowed) for every step of every case."""
    rules = log.sparkSession.createDataFrame(sorted(set(allowed)), "from_activity string, to_activity string").withColumn("allowed", F.lit(True))
    steps = with_neighbours(log).where("next_event IS NOT NULL").select("case_id", "ts", "place", F.col("event").alias("from_activity"), F.col("next_event").alias("to_activity"))
    return steps.join(F.broadcast(rules), ["from_activity", "to_activity"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def conformance(log: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """One row: fitness, precision, violated and total cases, and activities that no rule mentions."""
    if not allowed:
        raise ValueError("conformance needs at least one allowed transition")
    steps = transitions(log, allowed)
    named = F.array(*(F.lit(a) for a in sorted({a for pair in allowed for a in pair})))
    bad = steps.agg(F.count_distinct(F.when(~F.col("allowed"), F.col("case_id"))).alias("violated_cases"), F.count_distinct(F.when(F.col("allowed"), F.struct("from_activity", "to_activity"))).alias("observed"))
    one = bad.select("*", log.agg(F.count_distinct("case_id")).scalar().alias("total_cases"), log.agg(F.array_sort(F.array_except(F.collect_set("event"), named))).scalar().alias("unknown_activities"))
    return one.select(F.round((F.col("total_cases") - F.col("violated_cases")) / F.col("total_cases"), 4).alias("fitness"), F.round(F.col("observed") / F.lit(len(set(allowed))), 4).alias("precision"), "violated_cases", "total_cases", "unknown_activities")


def violations(log: DataFrame, allowed: list[tuple[str, str]], examples: int = 10) -> DataFrame:
    return transitions(log, allowed).where(~F.col("allowed")).select("case_id", "ts", "place", "from_activity", "to_activity").orderBy("case_id", "ts", "place").limit(examples)


def case_metrics(log: DataFrame, sla_hours: float = 48.0, unit: str = "hours", as_of=None, closed: tuple[str, ...] = CLOSED) -> DataFrame:
    """Age, duration, stages and SLA state of each case. Open cases age until as_of, by default the log's last time."""
    grouped = log.groupBy("case_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("event", F.struct("ts", "place")).alias("current"), F.count_distinct("event").alias("stage_count"))
    now = literal(as_of) if as_of else log.agg(F.max("ts")).scalar()
    seconds = seconds_between(F.col("first_ts"), F.col("last_ts"))
    is_closed = F.col("current").isin(list(closed))
    age_s = F.when(is_closed, seconds).otherwise(seconds_between(F.col("first_ts"), now))
    late = age_s / 3600.0 > sla_hours
    status = F.when(late, "breached").when(is_closed, "met").otherwise("in_progress")
    out = grouped.select("case_id", F.round(seconds / UNIT_SECONDS[unit], 3).alias("duration"), F.round(age_s / UNIT_SECONDS[unit], 3).alias("age"), "stage_count", "current", is_closed.alias("closed"), (status == "breached").alias("overdue"), status.alias("sla_status"))
    return out.orderBy(F.desc("age"), "case_id")


def sla_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("total_cases"), *(F.count_if(F.col("sla_status") == s).alias(s) for s in ("met", "in_progress", "breached")))


def throughput(log: DataFrame, unit: str = "hours", cuts: Edges | None = None) -> DataFrame:
    """Time in each stage, selected over counted ranges. p90 is the value at place round(0.9 (n - 1)) of the sorted times."""
    times = with_neighbours(log).select(F.col("event").alias("stage"), (F.col("duration_s") / UNIT_SECONDS[unit]).alias("span"))
    known = ranked(times, ["stage"], "span", edges(times, "span") if cuts is None else cuts)
    p90 = at_place("span", F.floor((F.col("known") - 1) * F.lit(0.9) + 0.5))
    out = known.groupBy("stage").agg(F.max("n").alias("n"), F.round(F.min("span"), 3).alias("min"), F.round(quantile("span", 0.5), 3).alias("median"), F.round(F.max("span"), 3).alias("max"), F.round(p90, 3).alias("p90"))
    return out.orderBy(F.desc_nulls_last("median"), "stage")


def neighbours(log: DataFrame, top: int = 5) -> DataFrame:
    """(stage, side, activity, n, rank): the commonest activities before and after each stage."""
    near = with_neighbours(log)
    both = near.select(F.col("event").alias("stage"), F.explode(F.array(F.struct(F.lit("from").alias("side"), F.col("prev_event").alias("activity")), F.struct(F.lit("to").alias("side"), F.col("next_event").alias("activity")))).alias("x"))
    counted = both.select("stage", "x.*").where("activity IS NOT NULL").groupBy("stage", "side", "activity").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("stage", "side").orderBy(F.desc("n"), "activity"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


def neighbour_maps(log: DataFrame, top: int = 5) -> DataFrame:
    """(stage, from_activities, to_activities) as maps of counts."""
    n = neighbours(log, top)
    pick = lambda side: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "activity", "n")))), lambda x: F.struct(x.activity, x.n)))
    return n.groupBy("stage").agg(pick("from").alias("from_activities"), pick("to").alias("to_activities"))


def readiness(df: DataFrame, case: str, at: str, status: str, place: str, now, deadline: str | None = None, queue: str | None = None) -> DataFrame:
    """One row of counts and a verdict: any blocking count means BLOCKED, else any warning WARNING, else PASS.

    Order within a case is input order, which `place` must name; far future means more than 365 days after now.
    """
    raw = F.col(at).cast("string")
    rows = df.select(F.col(case).cast("string").alias("case_id"), raw.alias("raw"), as_timestamp(df, at).alias("ts"), F.lower(F.col(status).cast("string")).alias("status"), F.col(place).alias("place"))
    known = rows.where("case_id IS NOT NULL AND raw IS NOT NULL")
    order = Window.partitionBy("case_id").orderBy("place")
    steps = known.where("ts IS NOT NULL").withColumn("back", F.lag("ts").over(order) > F.col("ts"))
    first = lambda s: F.min_by(F.when(F.col("status") == s, F.col("ts")), F.when(F.col("status") == s, F.col("place")))
    cases = steps.groupBy("case_id").agg(F.max(F.coalesce(F.col("back").cast("int"), F.lit(0))).alias("back"), first("created").alias("created"), first("completed").alias("completed"), F.count_if(F.col("ts") > literal(now) + F.expr("INTERVAL 365 DAYS")).alias("far"))
    by_case = {"out_of_order_cases": F.coalesce(F.sum("back"), F.lit(0)), "completed_before_created": F.count_if(F.col("completed") < F.col("created")), "far_future": F.coalesce(F.sum("far"), F.lit(0))}
    by_row = rows.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("case_id").alias("unique_cases"), F.count_if(F.col("case_id").isNull()).alias("null_cases"), F.count_if(F.col("raw").isNull()).alias("null_timestamps"), F.count_if(F.col("raw").isNotNull() & F.col("case_id").isNotNull() & F.col("ts").isNull()).alias("bad_timestamps"))
    missing = sum(c not in df.columns for c in (deadline, queue) if c)
    blocked = (F.col("total_rows") == 0) | (F.col("null_cases") + F.col("null_timestamps") + F.col("bad_timestamps") + F.col("out_of_order_cases") + F.col("completed_before_created") > 0)
    counts = by_row.select("*", *(cases.agg(c).scalar().alias(name) for name, c in by_case.items()))
    return counts.withColumn("verdict", F.when(blocked, "BLOCKED").when((F.col("far_future") > 0) | F.lit(missing > 0), "WARNING").otherwise("PASS"))


def mapping_summary(df: DataFrame, case: str, status: str) -> DataFrame:
    """Cases, open and closed populations and event coverage. The statuses that count as closed."""
    closed = F.lower(F.col(status).cast("string")).isin("closed", "resolved", "completed", "done")
    out = df.agg(F.count_distinct(case).alias("case_count"), F.count(F.lit(1)).alias("total_events"), F.count_distinct(F.when(closed, F.col(case))).alias("closed_population"))
    return out.select("case_count", "total_events", F.greatest(F.lit(0), F.col("case_count") - F.col("closed_population")).alias("open_population"), "closed_population", F.round(F.least(F.lit(1.0), F.col("total_events") / F.greatest(F.lit(1), F.col("case_count") * 2)), 2).alias("event_coverage"))


