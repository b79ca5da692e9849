"""Forecasting of bounded series (series_id, i, ds, y): suitability, baselines, smoothing models and their evaluation.

Baselines and all metrics are joins and windows. Theta, simple and Holt smoothing are fitted per series in a pandas function;
a series has some hundred points. AutoARIMA has no counterpart here and is reported as unavailable, never imitated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.times import seconds_between

MIN_PERIODS = 12
BASELINES = ("Naive", "SeasonalNaive")
SMOOTHERS = ("SES", "Holt", "Theta")
UNAVAILABLE = ("AutoARIMA",)
SEASONS = {"D": 7, "W": 52, "MS": 12, "H": 24}
MARGIN = 0.02  # by which a model must beat the best baseline
Z80, Z95 = 1.2815515655446004, 1.959963984540054


class Refused(ValueError):
    """The series can't carry the forecast asked for."""


def season(length: int | None, frequency: str, n_train: int) -> int:
    return max(1, min(length or SEASONS.get(frequency, 1), n_train // 2))


def averaged(points: DataFrame) -> DataFrame:
    """(series_id, i, ds, y): one point for each time, the mean of the points (series_id, ds, y) that share it. Points without a time or
    a number are left out."""
    one = points.select("series_id", "ds", F.col("y").try_cast("double").alias("y")).dropna(subset=["ds", "y"]).groupBy("series_id", "ds").agg(F.avg("y").alias("y"))
    return one.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("ds")) - 1).cast("long").alias("i"), "ds", "y")


def suitability(series: DataFrame, least: int = MIN_PERIODS) -> DataFrame:
    """(series_id, observations, coverage, constant, sufficient): coverage is points over the steps their span has room for."""
    step = seconds_between(F.lag("ds").over(Window.partitionBy("series_id").orderBy("ds")), F.col("ds"))
    out = series.withColumn("step", step).groupBy("series_id").agg(F.count(F.lit(1)).alias("observations"), F.median("step").alias("step"), seconds_between(F.min("ds"), F.max("ds")).alias("span"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("spread"))
    expected = F.floor(F.try_divide(F.col("span"), F.col("step"))) + 1
    enough = F.col("observations") >= least
    return out.select("series_id", "observations", F.when(enough, F.round(F.coalesce(F.try_divide(F.col("observations"), expected), F.lit(1.0)), 4)).alias("coverage"), (F.col("spread") == 0).alias("constant"), enough.alias("sufficient"))


def split(series: DataFrame, holdout: int | None = None, share: float = 0.2) -> DataFrame:
    """series with n and train_end: the last points of each series are held out."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    cut = F.lit(holdout) if holdout else F.greatest(F.lit(3), F.least(F.bround(n * share).cast("int"), n - MIN_PERIODS))
    return series.withColumn("n", n).withColumn("train_end", (F.col("n") - cut).cast("int"))


def baseline(cut: DataFrame, model: str, length: int = 7) -> DataFrame:
    """(series_id, i, ds, y, yhat) for the held-out points: the last training value, or the one a whole number of seasons back."""
    m = F.greatest(F.lit(1), F.least(F.lit(length), F.floor(F.col("train_end") / 2))).cast("int")
    train = cut.where("i < train_end").select("series_id", F.col("i").alias("source"), F.col("y").alias("yhat"))
    test = cut.where("i >= train_end")
    back = F.col("train_end") - 1 if model == "Naive" else F.col("train_end") - m + (F.col("i") - F.col("train_end")) % m
    return test.withColumn("source", back.cast("long")).join(train.withColumn("source", F.col("source").cast("long")), ["series_id", "source"]).select("series_id", "i", "ds", "y", "yhat")


def ahead(series: DataFrame, horizon: int, model: str, length: int = 7) -> DataFrame:
    """(series_id, step, yhat) for the steps after each series' end."""
    n = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    steps = n.select("series_id", "n", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    m = F.greatest(F.lit(1), F.least(F.lit(length), F.floor(F.col("n") / 2)))
    back = F.col("n") - 1 if model == "Naive" else F.col("n") - m + (F.col("step") - 1) % m
    values = series.select("series_id", F.col("i").cast("long").alias("source"), F.col("y").alias("yhat"))
    return steps.withColumn("source", back.cast("long")).join(values, ["series_id", "source"]).select("series_id", "step", "yhat")


def scale(cut: DataFrame, length: int = 7) -> DataFrame:
    """(series_id, scale): mean absolute seasonal difference of the training part."""
    order = Window.partitionBy("series_id").orderBy("i")
    m = F.greatest(F.lit(1), F.least(F.lit(length), F.floor(F.col("train_end") / 2)))
    train = cut.where("i < train_end").withColumn("m", m)
    seasonal = F.when((F.col("m") > 1) & (F.col("train_end") > F.col("m")), F.abs(F.col("y") - F.lag("y", length).over(order))).otherwise(F.abs(F.col("y") - F.lag("y", 1).over(order)))
    return train.withColumn("d", seasonal).groupBy("series_id").agg(F.avg("d").alias("scale"))


def errors(predicted: DataFrame, scales: DataFrame) -> DataFrame:
    """(series_id, mae, mape, rmse, mase): MAPE over nonzero actuals, MASE null where the scale is zero."""
    e = F.abs(F.col("y") - F.col("yhat"))
    out = predicted.groupBy("series_id").agg(F.avg(e).alias("mae"), (F.avg(F.when(F.col("y") != 0, e / F.abs(F.col("y")))) * 100).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return out.join(scales, "series_id", "left").select("series_id", F.round("mae", 6).alias("mae"), F.round("mape", 6).alias("mape"), F.round("rmse", 6).alias("rmse"), F.round(F.when(F.col("scale") > 0, F.col("mae") / F.col("scale")), 6).alias("mase"))


def pinball(actual: Column, predicted: Column, q: float) -> Column:
    e = actual - predicted
    return F.avg(F.greatest(q * e, (q - 1) * e))


def intervals_valid(df: DataFrame) -> DataFrame:
    """(series_id, valid_bounds, valid_nesting) of rows (yhat, lo80, hi80, lo95, hi95); missing bounds are passed over."""
    le = lambda a, b: F.coalesce(F.col(a) <= F.col(b) + 1e-9, F.lit(True))
    return df.groupBy("series_id").agg(F.every(le("lo95", "yhat") & le("yhat", "hi95")).alias("valid_bounds"), F.every(le("lo95", "lo80") & le("lo80", "yhat") & le("yhat", "hi80") & le("hi80", "hi95")).alias("valid_nesting"))


def folds(series: DataFrame, horizon: int = 1, n_folds: int = 3, least: int = MIN_PERIODS) -> DataFrame:
    """series once for every expanding fold, with fold and train_end; keyed `series_id:fold` so that folds are series of their own."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    usable = F.greatest(F.lit(1), F.floor((F.col("n") - least) / horizon)).cast("int")
    out = series.withColumn("n", n).where(F.col("n") >= least + horizon).withColumn("folds", F.least(F.lit(n_folds), usable))
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)))
    out = out.withColumn("train_end", (F.col("n") - (F.col("folds") - F.col("fold")) * horizon).cast("int")).where(F.col("i") < F.col("train_end") + horizon)
    return out.withColumn("series_id", F.concat_ws(":", F.col("series_id"), F.col("fold").cast("string")))


def rolling_origin(series: DataFrame, horizon: int = 1, n_folds: int = 3, length: int = 7, models: tuple[str, ...] = BASELINES) -> DataFrame:
    """(model, mae, rmse, mase, folds), means over the folds of every series; the season is clamped to half the least history."""
    cut, m = folds(series, horizon, n_folds), season(length, "D", MIN_PERIODS)
    scales, out = scale(cut, m), None
    for model in models:
        predicted = baseline(cut, model, m) if model in BASELINES else smoothed(cut, model)
        one = errors(predicted, scales).agg(F.round(F.avg("mae"), 6).alias("mae"), F.round(F.avg("rmse"), 6).alias("rmse"), F.round(F.avg("mase"), 6).alias("mase"), F.count(F.lit(1)).alias("folds")).select(F.lit(model).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _ses(y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    level, fitted = y[0], np.empty(len(y))
    for t, v in enumerate(y):
        fitted[t] = level
        level += alpha * (v - level)
    return level, fitted


def _best_ses(y: np.ndarray) -> tuple[float, np.ndarray, float]:
    tries = [(*_ses(y, a), a) for a in np.linspace(0.05, 0.95, 19)]
    return min(tries, key=lambda x: float(((y - x[1])[1:] ** 2).sum()))


def _holt(y: np.ndarray, horizon: int) -> tuple[np.ndarray, float]:
    best = None
    for a in np.linspace(0.1, 0.9, 9):
        for b in np.linspace(0.05, 0.5, 6):
            level, trend, sse = y[0], y[1] - y[0] if len(y) > 1 else 0.0, 0.0
            for v in y[1:]:
                e = v - (level + trend)
                level, trend, sse = level + trend + a * e, trend + a * b * e, sse + e * e
            if best is None or sse < best[0]:
                best = (sse, level, trend)
    return best[1] + best[2] * np.arange(1, horizon + 1), float(np.sqrt(best[0] / max(1, len(y) - 2)))


def predict(y: np.ndarray, model: str, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and their standard errors."""
    steps = np.arange(1, horizon + 1)
    if model == "Holt":
        yhat, sigma = _holt(y, horizon)
        return yhat, sigma * np.sqrt(steps)
    if model == "Naive":
        return np.full(horizon, y[-1]), float(np.std(np.diff(y))) * np.sqrt(steps)
    if model == "SES":
        level, fitted, alpha = _best_ses(y)
        yhat = np.full(horizon, level)
    elif model == "Theta":  # half the linear trend, the rest by smoothing the line with doubled curvature
        t = np.arange(len(y))
        slope, base = np.polyfit(t, y, 1)
        level, fitted, alpha = _best_ses(2 * y - (base + slope * t))
        yhat = (level + base + slope * (len(y) - 1 + steps)) / 2
        fitted = (fitted + base + slope * t) / 2
    else:
        raise Refused(f"{model} is not available")
    sigma = float(np.std(y - fitted, ddof=1)) if len(y) > 2 else 0.0
    return yhat, sigma * np.sqrt(1 + (steps - 1) * alpha**2)


def smoothed(cut: DataFrame, model: str) -> DataFrame:
    """(series_id, i, ds, y, yhat, lo80, hi80, lo95, hi95) for the held-out points of series with train_end."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        test = pdf[pdf["i"] >= pdf["train_end"]]
        yhat, s = predict(pdf["y"][pdf["i"] < pdf["train_end"]].to_numpy(float), model, len(test))
        return test[["series_id", "i", "ds", "y"]].assign(yhat=yhat, lo80=yhat - Z80 * s, hi80=yhat + Z80 * s, lo95=yhat - Z95 * s, hi95=yhat + Z95 * s)

    typed = cut.select(F.col("series_id").cast("string").alias("series_id"), F.col("i").cast("long").alias("i"), "ds", F.col("y").cast("double").alias("y"), F.col("train_end").cast("long").alias("train_end"))
    return typed.groupBy("series_id").applyInPandas(fit, "series_id string, i long, ds timestamp_ntz, y double, yhat double, lo80 double, hi80 double, lo95 double, hi95 double")


def forecast(series: DataFrame, model: str, horizon: int) -> DataFrame:
    """(series_id, step, yhat, lo80, hi80, lo95, hi95): refits from the stored series, so a model needs no state of its own."""
    if model in UNAVAILABLE:
        raise Refused(f"{model} is not available")
    if not 1 <= horizon <= 365:
        raise Refused("the horizon must be 1 to 365")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("i")["y"].to_numpy(float)
        if len(y) < MIN_PERIODS:
            return pd.DataFrame({c: [] for c in ("series_id", "step", "yhat", "lo80", "hi80", "lo95", "hi95")})
        yhat, s = predict(y, model, horizon)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "step": np.arange(1, horizon + 1), "yhat": yhat, "lo80": yhat - Z80 * s, "hi80": yhat + Z80 * s, "lo95": yhat - Z95 * s, "hi95": yhat + Z95 * s})

    typed = series.select(F.col("series_id").cast("string").alias("series_id"), F.col("i").cast("long").alias("i"), F.col("y").cast("double").alias("y"))
    return typed.groupBy("series_id").applyInPandas(fit, "series_id string, step long, yhat double, lo80 double, hi80 double, lo95 double, hi95 double")


def evaluate(series: DataFrame, length: int = 7, models: tuple[str, ...] = (*BASELINES, *SMOOTHERS)) -> DataFrame:
    """(series_id, model, mae, mape, rmse, mase, relative_mae) on the holdout; relative to Naive."""
    cut = split(series)
    scales, out = scale(cut, length), None
    for model in models:
        one = errors(baseline(cut, model, length) if model in BASELINES else smoothed(cut, model), scales).withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    naive = out.where("model = 'Naive'").select("series_id", F.col("mae").alias("ref"))
    return out.join(naive, "series_id", "left").select("series_id", "model", "mae", "mape", "rmse", "mase", F.round(F.when(F.col("ref") > 0, F.col("mae") / F.col("ref")), 6).alias("relative_mae"))


def chosen(evaluated: DataFrame) -> DataFrame:
    """(series_id, model): the best model by MASE if it beats the best baseline by more than MARGIN, else that baseline."""
    base = F.col("model").isin(list(BASELINES))
    pick = lambda on: F.min(F.when(on & F.col("mase").isNotNull(), F.struct("mase", "model")))
    best = evaluated.groupBy("series_id").agg(pick(base).alias("b"), pick(~base).alias("c"))
    better = F.col("b").isNull() | (F.col("c.mase") < F.col("b.mase") * (1 - MARGIN))
    return best.select("series_id", F.coalesce(F.when(better, F.col("c.model")), F.col("b.model"), F.lit("Naive")).alias("model"))


def interval_coverage(series: DataFrame, horizon: int = 1, n_folds: int = 3, models: tuple[str, ...] = ("Naive", *SMOOTHERS)) -> DataFrame:
    """(model, coverage_80, coverage_95, folds): the share of a fold's points that lie within its prediction ranges, mean over the rolling folds of every series."""
    cut, out = folds(series, horizon, n_folds), None
    for model in models:
        y = F.col("y")
        of_fold = smoothed(cut, model).groupBy("series_id").agg(*(F.avg(y.between(F.col(f"lo{p}"), F.col(f"hi{p}")).cast("int")).alias(f"c{p}") for p in (80, 95)))
        one = of_fold.agg(*(F.round(F.avg(f"c{p}"), 6).alias(f"coverage_{p}") for p in (80, 95)), F.count(F.lit(1)).alias("folds")).select(F.lit(model).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# The grid of smoothing weights that ets() searches.
ALPHAS, BETAS, GAMMAS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.1, 0.3, 0.5), (0.1, 0.3, 0.5)


def ets_grid(season: int) -> list[tuple[str, float, float, float, int]]:
    """(model, alpha, beta, gamma, parameters): additive exponential smoothing with or without trend and season. Parameters are the weights,
    the starting values and the variance."""
    out = []
    for trend in (False, True):
        for seasonal in (False, True):
            name = f"A{'A' if trend else 'N'}{'A' if seasonal else 'N'}"
            for a in ALPHAS:
                out += [(name, a, b, g, 3 + 2 * trend + season * seasonal) for b in (BETAS if trend else (0.0,)) for g in (GAMMAS if seasonal else (0.0,))]
    return out


def ets(series: DataFrame, season: int = 7) -> DataFrame:
    """(series_id, model, alpha, beta, gamma, aicc, yhat): of all rows of ets_grid() the one with the least corrected information criterion, for each series
    (series_id, i, y), and its forecast of the next point.

    Each grid row is a row beside the series' ordered points, which an aggregate() folds into level, trend, season and squared errors. All
    models start from the same first points (a season of them, where there are two seasons at least; else two, and models with a season are left
    out) and are judged on the same rest, so their criteria can be compared. Series shorter than MIN_PERIODS are left out."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("y").cast("double").alias("y")))), lambda p: p["y"])
    rows = series.groupBy("series_id").agg(points.alias("y")).where(F.size("y") >= MIN_PERIODS)
    rows = rows.withColumn("begin", F.when(F.size("y") >= 2 * season, season).otherwise(2))
    grid = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma"), F.lit(k).alias("k"), F.lit(n).alias("place")) for n, (m, a, b, g, k) in enumerate(ets_grid(season))))
    rows = rows.withColumn("x", F.explode(grid)).select("series_id", "y", "begin", "x.*").where(~F.col("model").endswith("A") | (F.col("begin") == season))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    first = F.slice("y", F.lit(1), F.col("begin"))
    rows = rows.withColumn("level", total(first) / F.col("begin")).withColumn("trend", F.when(F.substring("model", 2, 1) == "A", (F.get("y", F.col("begin") - 1) - F.get("y", F.lit(0))) / (F.col("begin") - 1)).otherwise(0.0))
    rows = rows.withColumn("seasons", F.when(F.col("model").endswith("A"), F.transform(first, lambda v: v - F.col("level"))).otherwise(F.array(F.lit(0.0))))

    def state(level: Column, trend: Column, seasons: Column, sse: Column) -> Column:
        return F.struct(level.alias("level"), trend.alias("trend"), seasons.alias("seasons"), sse.alias("sse"))

    def step(at: Column, y: Column) -> Column:
        now = F.get(at["seasons"], F.lit(0))
        moved = lambda e: state(at["level"] + at["trend"] + F.col("alpha") * e, at["trend"] + F.col("alpha") * F.col("beta") * e, F.concat(F.slice(at["seasons"], F.lit(2), F.size(at["seasons"])), F.array(now + F.col("gamma") * e)), at["sse"] + e * e)
        return F.get(F.transform(F.array(y - at["level"] - at["trend"] - now), moved), F.lit(0))

    rest = F.slice("y", F.col("begin") + 1, F.size("y"))
    rows = rows.withColumn("end", F.aggregate(rest, state(F.col("level"), F.col("trend"), F.col("seasons"), F.lit(0.0)), step)).withColumn("n", F.size("y") - F.col("begin"))
    rows = rows.where(F.col("n") > F.col("k") + 1)
    aicc = F.col("n") * F.log(F.greatest(F.col("end.sse") / F.col("n"), F.lit(1e-12))) + 2 * F.col("k") + 2 * F.col("k") * (F.col("k") + 1) / (F.col("n") - F.col("k") - 1)
    rows = rows.withColumn("aicc", aicc).withColumn("yhat", F.col("end.level") + F.col("end.trend") + F.get("end.seasons", F.lit(0)))
    best = rows.groupBy("series_id").agg(F.min_by(F.struct("model", "alpha", "beta", "gamma", "aicc", "yhat"), F.struct("aicc", "place")).alias("b"))
    return best.select("series_id", "b.model", "b.alpha", "b.beta", "b.gamma", F.round("b.aicc", 4).alias("aicc"), F.round("b.yhat", 4).alias("yhat"))
