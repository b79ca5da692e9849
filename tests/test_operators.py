"""Operators against small literals and invariants."""

import json
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import text as words
from skerry.functions.times import duration_seconds
from skerry.operators import forecasting, monitoring, process, quality, registry, risk, scenario, selection
from skerry.plans import adhoc, metrics
from skerry.plans.adhoc import Filter, Measure, Query, QueryError
from skerry.plans.metrics import Metric


def log(spark, rows):
    return process.event_log(spark.createDataFrame(rows, "c string, e string, t string, n long"), "c", "e", "t", "n")


def test_ratio_is_of_totals_and_windows_are_half_open(spark):
    rows = [("A", "2026-01-01T00:00:00Z", "x" if i < 9 else "") for i in range(10)] + [("B", "2026-02-01T00:00:00Z", "x" if i < 10 else "") for i in range(1000)] + [("B", "2026-04-01T00:00:00Z", "x")]
    df = spark.createDataFrame(rows, "branch string, at string, reply string")
    m = Metric("ratio", "at", numerator=[Filter("reply", "is_not_null")])
    total = metrics.execute(df, m, "2026-01-01T00:00:00Z", "2026-04-01T00:00:00Z").first()
    assert (total["numerator"], total["denominator"], total["value"]) == (19, 1010, round(19 / 1010, 6))
    by = {r["branch"]: r["value"] for r in metrics.execute(df, m, "2026-01-01", "2026-04-01", ["branch"]).collect()}
    assert by == {"A": 0.9, "B": 0.01}


def test_query_vocabulary_is_closed(spark):
    df = spark.range(3)
    for q in (Query([]), Query([Measure("sum", "nope")]), Query([Measure("median", "id")]), Query([Measure("count")], limit=501), Query([Measure("count"), Measure("count")]), Query([Measure("count")], filters=[Filter("id", "in", 3)]), Query([Measure("count")], order_by="id")):
        with pytest.raises(QueryError):
            adhoc.run(df, q)
    rows, more = adhoc.run_with_truncation(df, Query([Measure("count")], ["id"], limit=2))
    assert len(rows) == 2 and more


def test_sums_of_nothing_are_zero(spark):
    row = adhoc.run(spark.createDataFrame([], "v long, k string"), Query([Measure("sum", "v"), Measure("count_distinct", "k")])).first()
    assert tuple(row) == (0, 0)


def test_conformance_reports_unknown_activities(spark):
    rows = [("X1", "open", "2026-01-01T00:00:00", 1), ("X1", "review", "2026-01-01T01:00:00", 2), ("X1", "close", "2026-01-01T02:00:00", 3), ("X2", "open", "2026-01-01T00:00:00", 4), ("X2", "archive", "2026-01-01T03:00:00", 5)]
    out = process.conformance(log(spark, rows), [("open", "review"), ("review", "close")]).first()
    assert out["unknown_activities"] == ["archive"] and out["fitness"] == 0.5 and out["violated_cases"] == 1 and out["precision"] == 1.0
    assert [r["case_count"] for r in process.variants(log(spark, rows)).collect()] == [1, 1]


def test_readiness(spark):
    good = spark.createDataFrame([("a", "2026-01-01T00:00:00", "created", 1), ("a", "2026-01-02T00:00:00", "completed", 2)], "c string, t string, s string, n long")
    bad = spark.createDataFrame([("a", "2026-01-02T00:00:00", "created", 1), ("a", "2026-01-01T00:00:00", "completed", 2), (None, "x", "created", 3)], "c string, t string, s string, n long")
    now = datetime(2026, 2, 1)
    assert process.readiness(good, "c", "t", "s", "n", now).first()["verdict"] == "PASS"
    out = process.readiness(bad, "c", "t", "s", "n", now).first()
    assert out["verdict"] == "BLOCKED" and out["out_of_order_cases"] == 1 and out["completed_before_created"] == 1 and out["null_cases"] == 1
    assert process.readiness(good.limit(0), "c", "t", "s", "n", now).first()["verdict"] == "BLOCKED"


def test_rules_count_blanks_as_missing(spark):
    df = spark.createDataFrame([("1", "10", "x"), ("2", "20", "y"), ("2", "60", ""), ("", "abc", "z"), ("4", None, "w")], "id string, amount string, label string")
    rules = [quality.Rule("not_null", "id"), quality.Rule("unique", "id"), quality.Rule("range", "amount", 15, 50), quality.Rule("regex", "label", pattern="[a-d]"), quality.Rule("unique", "none"), quality.Rule("regex", "label", pattern="(")]
    out = quality.evaluate(df, rules).collect()
    assert [(r["checked"], r["violations"]) for r in out] == [(5, 1), (4, 1), (4, 3), (4, 4), (0, 0), (0, 0)]
    assert all(r["status"].startswith("error") for r in out[4:])


def test_grain_choice(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "x_id string, y long, z long")
    evidence = quality.grain(df)
    assert quality.chosen_grain(evidence) == ("x_id", "y")


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "series_id string, i long, y double")


def brute_bands(values, season, k):
    def band(v):
        m = statistics.median(v)
        d = statistics.median(abs(x - m) for x in v) or 1.0
        return m - k * d, m + k * d

    out = []
    for i in range(1, len(values)):
        before = values[:i]
        bands = [band(before)] if len(before) < season else [band(before[p::season]) for p in range(season)]
        out.append((min(b[0] for b in bands), max(b[1] for b in bands)))
    return out


def test_seasonal_bands_match_brute_force(spark):
    values = [float((i * 7919) % 23) for i in range(40)]
    got = monitoring.seasonal_bands(series(spark, values)).orderBy("i").collect()
    want = brute_bands(values, 7, 3.0)
    assert all(abs(r["lo"] - w[0]) < 1e-9 and abs(r["hi"] - w[1]) < 1e-9 for r, w in zip(got[1:], want, strict=True))


def test_spikes_constants_and_shifts(spark):
    spike = monitoring.anomalies(monitoring.seasonal_bands(series(spark, [10] * 10 + [200] + [10] * 10)), "seasonal_naive").collect()
    assert [r["i"] for r in spike if r["observed"] == 200] == [10]
    assert monitoring.anomalies(monitoring.seasonal_bands(series(spark, [50] * 30)), "seasonal_naive").count() == 0
    shifts = monitoring.cusum(series(spark, [10] * 20 + [30] * 20)).orderBy("i").collect()
    assert shifts[0]["direction"] == "up" and shifts[0]["i"] == 20


def test_forecasts(spark):
    rows = [("s", i, datetime(2026, 1, 1 + i), float(100 + 0.8 * i + (i % 7))) for i in range(28)]
    df = spark.createDataFrame(rows, "series_id string, i long, ds timestamp_ntz, y double")
    out = {r["model"]: r for r in forecasting.evaluate(df).collect()}
    assert set(out) == {*forecasting.BASELINES, *forecasting.SMOOTHERS} and out["Naive"]["relative_mae"] == 1.0
    assert forecasting.chosen(forecasting.evaluate(df)).first()["model"] in out
    ahead = forecasting.forecast(df, "Theta", 7)
    assert forecasting.intervals_valid(ahead).first()["valid_nesting"] and ahead.count() == 7
    with pytest.raises(forecasting.Refused):
        forecasting.forecast(df, "AutoARIMA", 3)


def test_risk(spark):
    with pytest.raises(risk.LeakageError):
        risk.guard(spark.createDataFrame([], "case_id long, final_outcome string"), ["final_outcome"])
    events = spark.createDataFrame([("c", datetime(2026, 1, 1, 8), 4.0), ("c", datetime(2026, 1, 1, 12), 8.0)], "case_id string, timestamp timestamp_ntz, case_age_hours double")
    cuts = spark.createDataFrame([("c", datetime(2026, 1, 1, 10))], "case_id string, observed_at timestamp_ntz")
    assert risk.point_in_time(events, cuts, ["case_age_hours"]).first()["case_age_hours"] == 4.0
    runs = [("forest", True, 0.1, 0.5, 0.2, 0.3), ("worse", True, 0.2, 0.31, 0.2, 0.3), ("raw", False, 0.1, 0.5, 0.2, 0.3), ("none", True, None, 0.5, 0.2, 0.3), ("finer", True, 0.2, 0.4, 0.2, 0.3), ("zero", True, 0.2, 0.4, 0.2, 0.0)]
    runs = spark.createDataFrame(runs, "name string, calibrated boolean, brier_score double, pr_auc double, base_brier_score double, base_pr_auc double")
    assert [r[0] for r in runs.select(risk.promotion()[0]).collect()] == ["forest", "BaseRate", "BaseRate", "BaseRate", "finer", "BaseRate"]
    rows = [(i, 1.0 if (i * 31 + i // 10) % 10 < i % 10 else 0.0, float(i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y double, x double")
    model = risk.fit_model(df, ["x"])
    scored = risk.predict(model, df)
    assert risk.ranking_metrics(scored).first()["roc_auc"] > 0.6
    assert risk.calibrate(scored) is not None and risk.calibrate(scored.limit(5)) is None


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_scores_are_those_of_the_fitted_model(spark, kind):
    from pyspark.ml.functions import vector_to_array

    rows = [(i, float((i * 31 + i // 10) % 10 < i % 10), float(i % 10), float(i % 7) * 1e3, 5.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y double, x double, z double, same double")
    model = risk.fit_model(df, ["x", "z", "same"], kind=kind)
    want = {r["id"]: r["q"] for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("q")).collect()}
    got = risk.predict(model, df)
    assert got.columns == [*df.columns, "p"] and max(abs(r["p"] - want[r["id"]]) for r in got.collect()) < 1e-9
    assert len(set(want.values())) > 5


def test_as_of_merge_splits_a_large_case(spark):
    rng = random.Random(1)
    events = [("hot" if i % 3 else f"c{i % 50}", rng.randrange(900), rng.random(), i) for i in range(1500)] + [(None, 5, 0.5, 1500), ("c1", None, 0.5, 1501), ("hot", 3, None, 1502)]
    asked = list({(rng.choice(["hot", "hot", "c3", "c7", "new"]), rng.randrange(-5, 905)) for _ in range(400)}) + [("hot", None), (None, 7)]
    at = lambda s: None if s is None else datetime(2026, 1, 1) + timedelta(seconds=s)
    log = spark.createDataFrame([(c, at(t), v, p) for c, t, v, p in events], "case_id string, timestamp timestamp_ntz, v double, place long")
    cuts = spark.createDataFrame([(c, at(t)) for c, t in asked + asked[:9]], "case_id string, observed_at timestamp_ntz")

    def plain(c, t):
        known = [(s, p, v) for k, s, v, p in events if c is not None and k == c and s is not None and t is not None and s <= t]
        return max(known, key=lambda r: r[:2])[2] if known else None

    want = sorted(((str(c), str(at(t)), plain(c, t)) for c, t in asked), key=str)
    pieces = selection.edges(log, "timestamp", 60)
    assert 15 < len(pieces) < 30 and not selection.edges(log, "timestamp")
    for cut in (pieces, [], pieces[:1]):
        got = risk.point_in_time(log, cuts, ["v"], place="place", pieces=cut).collect()
        assert sorted(((str(r["case_id"]), str(r["observed_at"]), r["v"]) for r in got), key=str) == want
    sizes = log.select("case_id", selection.range_of(F.col("timestamp"), pieces).alias("piece")).groupBy("case_id", "piece").count().agg(F.max("count")).first()[0]
    assert sizes < 120


def test_selection_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), None if i % 17 == 0 else float(rng.choice([rng.randrange(30), rng.lognormvariate(3, 3)]))) for i in range(3000)] + [("c", None), ("d", 1.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert selection.edges(df, "v") == []
    cuts = selection.edges(df, "v", 100)
    assert 20 < len(cuts) <= 30
    for c in (cuts, []):
        got = selection.ranked(df, ["k"], "v", c).groupBy("k").agg(F.max("n").alias("n"), *(selection.quantile("v", q).alias(f"q{i}") for i, q in enumerate((0, 0.31, 0.5, 1)))).collect()
        for r in got:
            own = sorted(v for k, v in rows if k == r["k"] and v is not None)
            want = [np.quantile(own, q) if own else None for q in (0, 0.31, 0.5, 1)]
            assert r["n"] == sum(k == r["k"] for k, _ in rows) and all((r[f"q{i}"] is None) if w is None else r[f"q{i}"] == pytest.approx(w, rel=1e-12) for i, w in enumerate(want))
        ranges = selection.ranked(df, ["k"], "v", c)._jdf.queryExecution().toString()
        assert "percentile" not in ranges
        at = selection.placed(df, ["v", "k"], "i", c).orderBy("i").collect()
        assert [r["i"] for r in at] == list(range(len(rows))) and [r["v"] for r in at] == sorted((v for _, v in rows), key=lambda v: (v is not None, v))


@pytest.mark.parametrize("capacity", [1, 3, 20])
def test_token_bucket_in_blocks(spark, capacity):
    rng, start, at, rows = random.Random(capacity), datetime(2026, 1, 1), 0, []
    for _ in range(700):
        at += rng.choice([0, 1, 7, 50, 4_000_000, 61_000_000, 9 * 10**9]) * rng.randrange(2)
        rows.append((rng.choice(["hot", "hot", "hot", "k", None]), start + timedelta(microseconds=at)))
    want, state = {}, {}
    for key, t in rows:
        level, last = state.get(key, (capacity * monitoring.TOKEN, t))
        level = min(capacity * monitoring.TOKEN, level + (t - last) // timedelta(microseconds=1) * capacity)
        ok = level >= monitoring.TOKEN
        state[key] = (level - ok * monitoring.TOKEN, t)
        n, yes = want.get((key, t), (0, 0))
        want[key, t] = (n + 1, yes + ok)
    df = spark.createDataFrame(rows, "key string, at timestamp_ntz")
    cuts = selection.edges(df, "at", 30)
    assert len(cuts) > 15
    for c in (cuts, []):
        got = monitoring.token_bucket(df, capacity, c).collect()
        assert {(r["key"], r["at"]): (r["requests"], r["allowed"]) for r in got} == want and len(got) == len(want)


def test_any_number_of_rule_settings(spark):
    points = [("s", i, float((i * 7) % 11 + (60 if i in (20, 33) else 0))) for i in range(40)]
    series = spark.createDataFrame(points, "series_id string, i long, y double")
    rules = [(f"r{k}", "s", "residual" if k % 2 else "seasonal_naive", 2 + k % 9, 1.0 + k / 40, 0.01 * (k % 3), 1, True) for k in range(60)]
    schema = "rule_id string, series_id string, method string, season int, threshold double, min_effect double, persistence int, enabled boolean"
    none = spark.createDataFrame([], "rule_id string, episode_identity string")
    got = {(r["rule_id"], r["i"], r["expected_lower"], r["expected_upper"]) for r in monitoring.evaluate_rules(spark.createDataFrame(rules, schema), series, none).collect()}
    want = set()
    for rule, _, method, season, k, effect, _, _ in rules[::7]:
        bands = monitoring.residual_bands if method == "residual" else monitoring.seasonal_bands
        want |= {(rule, r["i"], r["expected_lower"], r["expected_upper"]) for r in monitoring.anomalies(bands(series, season, k), method, effect).collect()}
    assert want and {g for g in got if g[0] in {r[0] for r in rules[::7]}} == want and len({g[0] for g in got}) == 60


def test_queues(spark):
    rows = [("q", 0, 5, 1), ("q", 1, 5, 2), ("q", 20, 1, 3), ("q", 20, 2, 4), ("r", 3, 1, 5), (None, 3, 1, 6), ("r", None, 1, 7)]
    out = scenario.queue_waits(spark.createDataFrame(rows, "queue string, at long, service long, id long"), "queue", "at", "service", "id")
    assert {r["id"]: (r["starts"], r["ends"], r["waits"]) for r in out.collect()} == {1: (0, 5, 0), 2: (5, 10, 4), 3: (20, 21, 0), 4: (21, 23, 1), 5: (3, 4, 0), 6: (3, 4, 0)}


def test_queues_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["q", "q", "q", "r", None]), rng.randrange(4000), rng.randrange(12), i) for i in range(900)]
    want, free = {}, {}
    for q, at, service, i in sorted(rows, key=lambda r: (r[1], r[3])):
        start = max(at, free.get(q, 0))
        free[q] = start + service
        want[i] = (start, start + service, start - at)
    df = spark.createDataFrame(rows, "queue string, at long, service long, id long")
    cuts = selection.edges(df, "at", 40)
    assert len(cuts) > 15 and sum(w > 0 for _, _, w in want.values()) > 100
    for c in (cuts, []):
        out = scenario.queue_waits(df, "queue", "at", "service", "id", c)
        assert out.columns == [*df.columns, "ends", "starts", "waits"]
        assert {r["id"]: (r["starts"], r["ends"], r["waits"]) for r in out.collect()} == want


def test_text_functions(spark):
    df = spark.createDataFrame([("أهلاً  Wörld",), ("café",), (None,)], "t string")
    got = [r[0] for r in df.select(words.normalise(F.col("t"))).collect()]
    assert got == ["اهلاً wörld", "café", None]
    al = words.aliases(F.lit("Closed tickets"), F.lit("مغلقة"), F.array(F.lit("done")), composed=True)
    one = spark.range(1).select(*(words.matches(q, al) for q in ("", "CLOSED", "done", "مغلقه", "open"))).first()
    assert tuple(one) == (True, True, True, True, False)
    assert spark.range(1).select(*(duration_seconds(F.lit(x)) for x in ("24h", "7d", "60m", "3600s", "15", "x"))).first()[:] == (86400.0, 604800.0, 3600.0, 3600.0, 15.0, None)


def test_registers(spark, tmp_path):
    moves = spark.createDataFrame([("revision", "staged", "validating"), ("revision", "published", "staged")], "machine string, from_state string, to_state string")
    assert [r["from_state"] for r in registry.illegal_moves(moves).collect()] == ["published"]
    small = registry.capture_evidence(spark.range(5), str(tmp_path / "a"))
    large = registry.capture_evidence(spark.range(500), str(tmp_path / "b"))
    assert "rows" in small and "path" in large and len(registry.read_evidence(spark, large)) == 500
    with pytest.raises(ValueError):
        registry.read_evidence(spark, small | {"rows": []})
    states = monitoring.conditions(spark.createDataFrame([("r", datetime(2026, 1, d), e) for d, e in ((1, "fire"), (2, "resolve"), (3, "fire"), (4, "fire"))], "rule_id string, at timestamp_ntz, event string"))
    assert states.first()["condition"] == "active"


def test_evidence_of_any_size(spark, tmp_path):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("x"))
    kept = registry.capture_evidence(rows, str(tmp_path / "a"))
    assert kept["row_count"] == registry.evidence_table(spark, kept).count() == 60_000
    assert registry.table_digest(rows.orderBy(F.desc("id")))[0] == kept["sha256"] == registry.table_digest(rows.repartition(7))[0]
    for other in (rows.where("id > 0"), rows.union(rows.limit(1)), rows.withColumn("x", F.when(F.col("id") != 9, F.col("x")))):
        assert registry.table_digest(other)[0] != kept["sha256"]
    spark.range(1).select("id", F.lit(1).cast("long").alias("x")).write.mode("append").parquet(kept["path"])
    with pytest.raises(ValueError):
        registry.evidence_table(spark, kept)


def test_profile_counts_values_once(spark):
    rows = spark.createDataFrame([(1, "2024-01-02", "a"), (2, "2024-01-01", ""), (2, "", None), (None, None, "a")], "x int, day string, t string")
    got = quality.profile(rows)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()  # no row is copied for each distinct count
    assert {tuple(r)[0]: tuple(r)[1:] for r in got.collect()} == {
        "x": ("integer", 4, 1, 0.25, 2, "1", "2"),
        "day": ("string", 4, 2, 0.5, 2, "2024-01-01", "2024-01-02"),
        "t": ("string", 4, 2, 0.5, 1, None, None),
    }
    assert [tuple(r)[2:] for r in quality.profile(rows.limit(0)).collect()] == [(0, 0, 0.0, 0, None, None)] * 3


def test_saved_analyses(spark):
    from skerry.plans import saved

    q = Query([Measure("count")], ["k"], [Filter("k", "gte", 1)])
    df = spark.range(9).select((F.col("id") % 3).alias("k"))
    text = saved.saved(q)
    assert saved.loaded(text) == q and saved.rerun(df, text)["sha256"] == saved.rerun(df, text)["sha256"] and len(saved.rerun(df, text)["rows"]) == 2


def test_rule_evaluation_settings(spark):
    points = spark.createDataFrame([("s", i, 9.0 if i == 8 else 1.0 + i % 2) for i in range(10)] + [("t", 0, 1.0), ("t", 1, 99.0)], "series_id string, i long, y double")
    rules = spark.createDataFrame([("a", "s", "residual", 4, 3.0, 0.01, 1, True), ("b", "s", "seasonal_naive", 4, 3.0, 0.01, 1, True), ("c", "s", "residual", 4, 3.0, 0.01, 2, True), ("d", "t", "residual", 4, 3.0, 0.01, 1, True), ("e", "s", "residual", 4, 3.0, 0.01, 1, False)], "rule_id string, series_id string, method string, season int, threshold double, min_effect double, persistence int, enabled boolean")
    none = spark.createDataFrame([], "rule_id string, episode_identity string")
    got = sorted((r["rule_id"], r["i"]) for r in monitoring.evaluate_rules(rules, points, none).collect())
    assert ("a", 8) in got and ("b", 8) in got and not {"c", "d", "e"} & {r for r, _ in got}
    held = none.union(spark.createDataFrame([("a", "a:residual:8")], "rule_id string, episode_identity string"))
    assert ("a", 8) not in {(r["rule_id"], r["i"]) for r in monitoring.evaluate_rules(rules, points, held).collect()}
    assert monitoring.evaluate_rules(rules.limit(0), points, none).count() == 0


def test_series_without_columns_is_refused(spark):
    with pytest.raises(ValueError):
        monitoring.load_series(spark.createDataFrame([("a",)], "name string"), [], "x")
