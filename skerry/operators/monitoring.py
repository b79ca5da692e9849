"""Monitoring of metric series: ranges, residuals, shifts, alert conditions and episodes.

Series are (series_id, i, y) with places from 0, MAX_BUCKETS points at most, so a series is a bounded group and many of them
run side by side. Windows and array functions serve where they can; the prefix range of each point keeps sorted lists per
phase in one pandas function per series.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from skerry.functions.times import literal
from skerry.operators.selection import edges, placed, range_of

TIME_NAMES = ("created_at", "timestamp", "ds", "date")
MAX_BUCKETS = 730  # points of a series that is folded or banded


def _median(values: list[float]) -> float:
    n = len(values)
    return values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2


def _band(values: list[float], k: float) -> tuple[float, float]:
    mid = _median(values)
    spread = _median(sorted(abs(v - mid) for v in values)) or 1.0
    return mid - k * spread, mid + k * spread


def setting(value: float | str) -> Column:
    """A number, or the column that holds it for each series."""
    return F.col(value) if isinstance(value, str) else F.lit(value)


def seasonal_bands(series: DataFrame, season: int | str = 7, k: float | str = 3.0) -> DataFrame:
    """(series_id, i, y, lo, hi): the range each point is held against, from the points before it alone. Before a full
    season it is median +- k MAD of them all, later the envelope over the phases; a MAD of zero counts as one. season and k may be columns."""

    def bands(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        season, k = int(pdf["season"].iloc[0]), float(pdf["k"].iloc[0])
        every: list[float] = []
        phases: dict[int, list[float]] = {}
        known: dict[int, tuple[float, float]] = {}
        lows, highs = [], []
        for n, y in enumerate(pdf["y"].tolist()):
            if n == 0:
                lo = hi = None
            elif n < season:
                lo, hi = _band(every, k)
            else:
                lo, hi = min(b[0] for b in known.values()), max(b[1] for b in known.values())
            lows.append(lo)
            highs.append(hi)
            insort(every, y)
            insort(phases.setdefault(n % season, []), y)
            known[n % season] = _band(phases[n % season], k)
        return pd.DataFrame({"series_id": pdf["series_id"], "i": pdf["i"], "y": pdf["y"], "lo": pd.Series(lows, index=pdf.index, dtype=float), "hi": pd.Series(highs, index=pdf.index, dtype=float)})

    typed = series.select(F.col("series_id").cast("string").alias("series_id"), F.col("i").cast("long").alias("i"), F.col("y").cast("double").alias("y"), setting(season).cast("int").alias("season"), setting(k).cast("double").alias("k"))
    return typed.groupBy("series_id").applyInPandas(bands, "series_id string, i long, y double, lo double, hi double")


def residual_bands(series: DataFrame, season: int | str = 7, k: float | str = 3.0) -> DataFrame:
    """The range of mean +- k standard deviations of the last `season` points before each; one point alone has deviation 1. season and k may be
    columns: then the last MAX_BUCKETS points, all that a series has, stand in an array of which `season` are taken."""
    if isinstance(season, str):
        every = F.collect_list("y").over(Window.partitionBy("series_id").orderBy("i").rowsBetween(-MAX_BUCKETS, -1))
        rows = series.withColumn("_all", every).withColumn("_last", F.slice("_all", F.greatest(F.size("_all") - F.col(season) + 1, F.lit(1)), F.col(season)))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        rows = rows.withColumn("_mean", F.try_divide(total("_last"), F.size("_last")))
        spread = F.when(F.size("_last") >= 2, F.sqrt(total(F.transform("_last", lambda v: (v - F.col("_mean")) * (v - F.col("_mean")))) / F.greatest(F.size("_last") - 1, F.lit(1)))).otherwise(F.lit(1.0))
        return rows.select("series_id", "i", "y", (F.col("_mean") - setting(k) * spread).alias("lo"), (F.col("_mean") + setting(k) * spread).alias("hi"))
    before = Window.partitionBy("series_id").orderBy("i").rowsBetween(-season, -1)
    mean, spread = F.avg("y").over(before), F.when(F.count("y").over(before) >= 2, F.stddev_samp("y").over(before)).otherwise(F.lit(1.0))
    return series.select("series_id", "i", "y", (mean - k * spread).alias("lo"), (mean + k * spread).alias("hi"))


def anomalies(banded: DataFrame, method: str, least_effect: float | str = 0.01) -> DataFrame:
    """Points outside their range by a large enough share of its middle, with how many points up to them (ten at most,
    without gap) are outside that same range."""
    last = F.reverse(F.collect_list("y").over(Window.partitionBy("series_id").orderBy("i").rowsBetween(-9, 0)))
    rows = banded.withColumn("last", last).withColumn("last", F.expr("slice(last, 1, int(greatest(least(i, 10), 1)))"))
    middle = (F.col("lo") + F.col("hi")) / 2
    effect = F.abs(F.col("y") - middle) / (F.abs(middle) + 1e-12)
    run = F.expr("aggregate(last, named_struct('n', 0, 'on', true), (a, v) -> named_struct('n', if(a.on and (v < lo or v > hi), a.n + 1, a.n), 'on', a.on and (v < lo or v > hi)), a -> a.n)")
    out = rows.where((F.col("i") >= 1) & ((F.col("y") < F.col("lo")) | (F.col("y") > F.col("hi")))).where(effect >= setting(least_effect))
    return out.select("series_id", "i", F.col("y").alias("observed"), F.round("lo", 6).alias("expected_lower"), F.round("hi", 6).alias("expected_upper"), F.lit(method).alias("method"), F.round(effect, 6).alias("effect_size"), run.alias("persistent_count"))


def cusum(series: DataFrame, target: float | None = None, threshold: float = 5.0, drift: float = 0.5) -> DataFrame:
    """Level shifts by two cumulative sums that start anew after each hit. The target is the mean of the first half.

    An ordered fold over each series' array of points, which has MAX_BUCKETS of them at most.
    """
    points = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("y").cast("double").alias("y")))).alias("p")).where(F.size("p") >= 5)
    half = F.expr("slice(p, 1, int(size(p) div 2))")
    mean = F.lit(float(target)) if target is not None else F.aggregate(half, F.lit(0.0), lambda a, x: a + x.y) / F.size(half)
    points = points.select("series_id", "p", mean.alias("mu"))
    fold = f"""aggregate(p, named_struct('up', 0D, 'down', 0D, 'hits', cast(array() as array<struct<i:bigint,y:double,up:double,down:double>>)), (a, x) ->
        transform(array(named_struct('u', greatest(0D, a.up + (x.y - mu) - {drift}D), 'd', greatest(0D, a.down - (x.y - mu) - {drift}D))), s ->
            if(s.u > {threshold}D or s.d > {threshold}D,
               named_struct('up', 0D, 'down', 0D, 'hits', concat(a.hits, array(named_struct('i', bigint(x.i), 'y', x.y, 'up', s.u, 'down', s.d)))),
               named_struct('up', s.u, 'down', s.d, 'hits', a.hits)))[0], a -> a.hits)"""
    hits = points.select("series_id", "mu", F.explode(F.expr(fold)).alias("h"))
    return hits.select("series_id", F.col("h.i").alias("i"), F.col("h.y").alias("observed"), F.when(F.col("h.up") > F.col("h.down"), "up").otherwise("down").alias("direction"), F.round(F.greatest("h.up", "h.down"), 4).alias("cumulative_sum"), F.round("mu", 4).alias("baseline_mean"), F.round(F.abs(F.col("h.y") - F.col("mu")) / (F.abs(F.col("mu")) + 1e-12), 6).alias("effect_size"))


def identity(rule: str = "rule_id") -> Column:
    return F.concat_ws(":", F.col(rule), F.col("method"), F.col("i").cast("string"))


def new_episodes(found: DataFrame, open_episodes: DataFrame) -> DataFrame:
    """Anomalies of rules (rule_id, method, i, ...) without an open episode of the same identity."""
    named = found.withColumn("episode_identity", identity())
    return named.join(open_episodes.select("rule_id", "episode_identity"), ["rule_id", "episode_identity"], "left_anti")


def load_series(df: DataFrame, order: list[str], series_id: str, rows: int | None = None) -> DataFrame:
    """(series_id, i, y) of a dataset: the first numeric column in the given order, else how many rows each value of the first time
    column has. `order` names the columns rows go by, as a table has no order of its own; a dataset with neither is refused. Places are
    counted over ranges of the order (of about `rows` rows), so a series may have any length; the detectors that fold a series take the last MAX_BUCKETS of its points."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in order]
    clocks = [c for c in df.columns if c in TIME_NAMES]
    if numbers:
        points = df.select(F.col(numbers[0]).cast("double").alias("y"), *order).dropna(subset=["y"])
    elif clocks:
        points, order = df.groupBy(clocks[0]).agg(F.count(F.lit(1)).cast("double").alias("y")), clocks[:1]
    else:
        raise ValueError("no numeric and no time column")
    return placed(points, order, "i", edges(points, order[0], rows)).select(F.lit(series_id).alias("series_id"), "i", "y")


def evaluate_rules(rules: DataFrame, series: DataFrame, open_episodes: DataFrame) -> DataFrame:
    """Anomalies that open a new episode. Rules (rule_id, series_id, method, season, threshold, min_effect, persistence, enabled) are held
    against series of three points or more; what lasts long enough and has no open episode (rule_id, episode_identity) fires.

    Each rule is evaluated on its own copy of its series, and its settings are columns beside it, so there may be any number of both.
    """
    active, found = rules.where("enabled").withColumn("rule_id", F.col("rule_id").cast("string")), None
    long_enough = series.join(series.groupBy("series_id").count().where("count >= 3").select("series_id"), "series_id", "left_semi")
    for method, bands in BANDS.items():
        own = active.where(F.col("method") == method)
        of_rule = long_enough.join(own.select("rule_id", "series_id", "season", "threshold"), "series_id").select(F.col("rule_id").alias("series_id"), "i", "y", "season", "threshold")
        banded = bands(of_rule, "season", "threshold").join(own.select(F.col("rule_id").alias("series_id"), "min_effect"), "series_id")
        hits = anomalies(banded, method, "min_effect").withColumnRenamed("series_id", "rule_id")
        hits = hits.join(own.select("rule_id", "persistence"), "rule_id").where("persistent_count >= persistence").drop("persistence")
        found = hits if found is None else found.unionByName(hits)
    return new_episodes(found, open_episodes)


BANDS = {"seasonal_naive": seasonal_bands, "residual": residual_bands}


def conditions(fired: DataFrame) -> DataFrame:
    """(rule_id, condition, started_at): states after all evaluations (rule_id, at, event), event being `fire` or `resolve`.

    Firing moves normal and recovered to pending and pending to active; resolving moves to recovered. So the state follows
    from the firings since the last resolve, without a fold.
    """
    last = fired.groupBy("rule_id").agg(F.max(F.when(F.col("event") == "resolve", F.col("at"))).alias("resolved"))
    after = fired.join(last, "rule_id").where((F.col("event") == "fire") & (F.col("resolved").isNull() | (F.col("at") > F.col("resolved"))))
    counted = after.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("started_at"))
    state = F.when(F.col("n") >= 2, "active").when(F.col("n") == 1, "pending").when(F.col("resolved").isNotNull(), "recovered").otherwise("normal")
    return last.join(counted, "rule_id", "left").select("rule_id", state.alias("condition"), F.coalesce("started_at", "resolved").alias("started_at"))


def nearest_rank(values: str, percents: tuple[int, ...] = (50, 95, 99)) -> list[Column]:
    """Latency percentiles: the value at place ceil(p n)."""
    return [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {values})").alias(f"p{p}") for p in percents]


def last_of(df: DataFrame, order: str, n: int = 1000) -> DataFrame:
    """The newest n rows: a bounded top-k."""
    return df.orderBy(F.desc(order)).limit(n)


TOKEN = 60_000_000  # one token, in what a bucket of capacity 1 gains a microsecond


def served(level: int, times: np.ndarray, counts: np.ndarray, last: int, capacity: int) -> tuple[int, np.ndarray]:
    """The level after all requests (times in microseconds, counts at each) from a level at `last`, and how many of each time are allowed."""
    allowed, full = np.zeros(len(times), np.int64), capacity * TOKEN
    for k, (at, n) in enumerate(zip(times.tolist(), counts.tolist(), strict=True)):
        level = min(full, level + (at - last) * capacity)
        last, allowed[k] = at, min(n, level // TOKEN)
        level -= int(allowed[k]) * TOKEN
    return level, allowed


def effect(times: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[int], list[int], list[bool]]:
    """What a block of requests does to the level it starts with, as a table: from `low` on the level ends at `value`, or at the
    level plus `value` where `shifts`. Requests turn a piece of it into a few more at most, as a level shifts, is capped, or pays for
    another token; pieces are joined again where they agree. A table has about capacity + 2 rows, however many requests it stands for."""
    full = capacity * TOKEN
    low, value, shifts, last = [0], [0], [True], int(times[0])
    for at, n in zip(times.tolist(), counts.tolist(), strict=True):
        new: list[tuple[int, int, bool]] = []
        gain, last = (at - last) * capacity, at
        for k, (a, v, s) in enumerate(zip(low, value, shifts, strict=True)):
            end = low[k + 1] if k + 1 < len(low) else full + 1
            if not s:
                new.append((a, (x := min(full, v + gain)) - min(n, x // TOKEN) * TOKEN, False))
                continue
            while a < end:  # levels a.. of this piece come to a + v + gain, capped
                x = a + v + gain
                if x >= full:
                    new.append((a, full - min(n, capacity) * TOKEN, False))
                    break
                paid = min(n, x // TOKEN)
                new.append((a, v + gain - paid * TOKEN, True))
                a = min(full if paid == n else (paid + 1) * TOKEN, full) - v - gain
        kept = [r for k, r in enumerate(new) if not k or r[1:] != new[k - 1][1:]]
        low, value, shifts = (list(c) for c in zip(*kept, strict=True))
    return low, value, shifts


def token_bucket(requests: DataFrame, capacity: int, cuts: list | None = None) -> DataFrame:
    """(key, at, requests, allowed) for each key and time of requests (key, at): buckets of `capacity` start full and refill by capacity / 60 a
    second, and of requests at one time as many are allowed as there are whole tokens.

    Time is cut into blocks (`cuts`, by default edges of equal size for a large input), so a key with very many requests is spread over tasks: each
    block's effect() is a small table, the tables of a key are applied one after the other to find the level each block starts with, and then
    the blocks are served side by side."""
    counted = requests.where("at IS NOT NULL").groupBy(F.col("key").cast("string").alias("key"), "at").agg(F.count(F.lit(1)).alias("requests"))
    cuts = edges(requests, "at") if cuts is None else cuts
    rows = counted.withColumn("block", range_of(F.col("at"), cuts)).withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))
    full = capacity * TOKEN

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us")
        low, value, shifts = effect(pdf["us"].to_numpy(), pdf["requests"].to_numpy(), capacity)
        one = pdf.iloc[:1]
        return pd.DataFrame({"key": one["key"], "block": one["block"], "first": one["us"], "last": pdf["us"].iloc[-1:].to_numpy(), "low": [low], "value": [value], "shifts": [shifts]})

    def serve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us")
        times = pdf["us"].to_numpy()
        _, allowed = served(int(pdf["level"].iloc[0]), times, pdf["requests"].to_numpy(), int(times[0]), capacity)
        return pd.DataFrame({"key": pdf["key"], "at": pdf["at"], "requests": pdf["requests"], "allowed": allowed})

    if cuts:
        tables = rows.groupBy("key", "block").applyInPandas(told, "key string, block int, first long, last long, low array<long>, value array<long>, shifts array<boolean>")
        # one row for a key and block; the fold keeps (block, level at its first request) of the blocks so far
        begin = f"""aggregate(array_sort(collect_list(struct(block, first, last, low, value, shifts))), named_struct('level', {full}L, 'last', cast(null AS bigint), 'found', cast(array() AS array<struct<block:int,level:bigint>>)),
            (a, b) -> transform(array(least({full}L, a.level + coalesce(b.first - a.last, 0L) * {capacity}L)), level -> transform(array(size(filter(b.low, x -> x <= level)) - 1), k ->
                named_struct('level', if(b.shifts[k], level + b.value[k], b.value[k]), 'last', b.last, 'found', concat(a.found, array(named_struct('block', b.block, 'level', level)))))[0])[0], a -> a.found)"""
        levels = tables.groupBy("key").agg(F.expr(begin).alias("found")).select(F.col("key").alias("_key"), F.explode("found").alias("x")).select("_key", F.col("x.block").alias("_block"), F.col("x.level").alias("level"))
        rows = rows.join(levels, F.col("key").eqNullSafe(F.col("_key")) & F.col("block").eqNullSafe(F.col("_block"))).drop("_key", "_block")
    else:
        rows = rows.withColumn("level", F.lit(full).cast("long"))
    return rows.groupBy("key", "block").applyInPandas(serve, "key string, at timestamp_ntz, requests long, allowed long")


def expired_leases(runs: DataFrame, now, seconds: int = 300) -> DataFrame:
    """Validating revisions whose lease has run out become failed."""
    late = (F.col("state") == "validating") & (F.timestamp_diff("SECOND", F.col("started_at"), literal(now)) > seconds)
    return runs.withColumn("state", F.when(late, "failed").otherwise(F.col("state")))
