"""Every query of the analytics operators, by name, with its DuckDB twin.

Roles of the input tables: events are an event log (case user_id, activity event_type, ties by event_id) and, by day, a
metric series; orders are a metric population; customers and orders stand in for control tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as words
from skerry.functions import times
from skerry.operators import forecasting, monitoring, process, quality, registry, risk, selection
from skerry.plans import adhoc, metrics
from skerry.plans.adhoc import Filter, Measure, Query
from skerry.plans.metrics import Metric
from skerry.session import shared_folder, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- ad-hoc queries ---------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS \"count\", coalesce(sum(l_quantity), 0) AS sum_l_quantity, round(avg(l_extendedprice), 6) AS avg_price, min(l_discount) AS min_l_discount FROM lineitem")
def adhoc_scalar_aggs(spark: SparkSession, d: str) -> DataFrame:
    out = adhoc.run(table(spark, d, "lineitem"), Query([Measure("count"), Measure("sum", "l_quantity"), Measure("avg", "l_extendedprice", "avg_price"), Measure("min", "l_discount")]))
    return out.withColumn("avg_price", F.round("avg_price", 6))


@query("SELECT l_returnflag, l_linestatus, count(*) AS \"count\", round(sum(l_extendedprice), 2) AS total, max(l_tax) AS max_l_tax FROM lineitem GROUP BY 1, 2")
def adhoc_grouped(spark: SparkSession, d: str) -> DataFrame:
    out = adhoc.run(table(spark, d, "lineitem"), Query([Measure("count"), Measure("sum", "l_extendedprice", "total"), Measure("max", "l_tax")], ["l_returnflag", "l_linestatus"]))
    return out.withColumn("total", F.round("total", 2))


@query("""SELECT o_orderpriority, count(*) AS "count" FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
    AND o_totalprice >= 1000 AND o_totalprice < 300000 AND o_orderstatus NOT IN ('X') GROUP BY 1""")
def adhoc_filter_ops(spark: SparkSession, d: str) -> DataFrame:
    f = [Filter("o_orderstatus", "neq", "P"), Filter("o_orderpriority", "in", ["1-URGENT", "2-HIGH", "5-LOW"]), Filter("o_totalprice", "gte", 1000), Filter("o_totalprice", "lt", 300000), Filter("o_orderstatus", "not_in", ["X"])]
    return adhoc.run(table(spark, d, "orders"), Query([Measure("count")], ["o_orderpriority"], f))


@query("""SELECT event_type, count(*) AS "count", count(value) AS count_value FROM events
    WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-10 12:00:00' AND value IS NOT NULL GROUP BY 1""")
def adhoc_time_window(spark: SparkSession, d: str) -> DataFrame:
    q = Query([Measure("count"), Measure("count", "value")], ["event_type"], [Filter("value", "is_not_null")], "ts", "2024-01-05T00:00:00Z", "2024-01-10T12:00:00Z")
    return adhoc.run(table(spark, d, "events"), q)


@query("""SELECT o_custkey, count(*) AS "count", round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY count(*) DESC NULLS LAST, o_custkey NULLS LAST LIMIT 25""")
def adhoc_topk_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    q = Query([Measure("count"), Measure("sum", "o_totalprice", "total")], ["o_custkey"], order_by="count", descending=True, limit=25)
    return adhoc.run(table(spark, d, "orders"), q).withColumn("total", F.round("total", 2))


@query("""SELECT g, count(DISTINCT k) + max(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS count_distinct_k, CAST(coalesce(sum(v), 0) AS BIGINT) AS sum_v
    FROM (SELECT p_size % 5 AS g, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS k, CASE WHEN p_size % 5 = 1 THEN NULL ELSE CAST(p_size AS BIGINT) END AS v FROM part) GROUP BY 1""")
def adhoc_count_distinct_nulls(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    rows = table(spark, d, "part").select((s % 5).alias("g"), F.when(s % 3 != 0, F.col("p_brand")).alias("k"), F.when(s % 5 != 1, s.cast("long")).alias("v"))
    return adhoc.run(rows, Query([Measure("count_distinct", "k"), Measure("sum", "v")], ["g"]))


@query("""SELECT n.n_name, count(*) AS "count" FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE contains(lower(n.n_name), 'tion') GROUP BY 1""")
def folded_substring(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return adhoc.run(rows.where(words.contains_folded(F.col("n_name"), "tIOn")), Query([Measure("count")], ["n_name"]))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return registry.page(out.withColumn("_d", -F.col("o_totalprice")), ["_d", "o_orderkey"], 100, 50).drop("_d")


# --- metrics ----------------------------------------------------------------------------------------------------------

RATIO = Metric("ratio", "o_orderdate", [Filter("o_orderstatus", "not_in", ["P"])], [Filter("o_totalprice", "gte", 100000)])


@query("""SELECT o_orderpriority, round(count_if(o_totalprice >= 100000) / nullif(count(*), 0), 6) AS value, count_if(o_totalprice >= 100000)::BIGINT AS numerator, count(*) AS denominator, count(*) = 0 AS zero_denominator
    FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus NOT IN ('P') GROUP BY 1""")
def metric_ratio_of_totals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.execute(table(spark, d, "orders"), RATIO, "1995-01-01T00:00:00", "1998-01-01T00:00:00", ["o_orderpriority"])


@query("SELECT CAST(NULL AS DOUBLE) AS value, 0::BIGINT AS numerator, 0::BIGINT AS denominator, true AS zero_denominator")
def metric_zero_denominator(spark: SparkSession, d: str) -> DataFrame:
    return metrics.execute(table(spark, d, "orders"), Metric("ratio", "o_orderdate", denominator=[Filter("o_orderstatus", "eq", "none")]), "1995-01-01", "1998-01-01")


@query("""SELECT o_orderstatus, count_if(o_orderpriority = '1-URGENT')::BIGINT AS value FROM orders
    WHERE o_orderdate >= TIMESTAMP '1995-12-31 21:00:00' AND o_orderdate < TIMESTAMP '1996-12-31 21:00:00' GROUP BY 1""")
def metric_count(spark: SparkSession, d: str) -> DataFrame:
    m = Metric("count", "o_orderdate", numerator=[Filter("o_orderpriority", "eq", "1-URGENT")], timezone="Asia/Bahrain")
    return metrics.execute(table(spark, d, "orders"), m, "1996-01-01T00:00:00", "1997-01-01T00:00:00", ["o_orderstatus"])


def spans(spark: SparkSession, d: str) -> DataFrame:
    log = process.with_neighbours(process.event_log(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id"))
    return log.select("event", "ts", F.timestamp_add("SECOND", F.col("duration_s"), F.col("ts")).alias("until"))


LEAD = "SELECT user_id, event_id, event_type, ts, lead(ts) OVER w AS nts, lag(ts) OVER w AS pts, lead(event_type) OVER w AS nev, lag(event_type) OVER w AS pev FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
SECONDS = "((epoch_us({b}) - epoch_us({a})) // 1000000)"
DUR, WAIT = SECONDS.format(a="ts", b="nts"), SECONDS.format(a="pts", b="ts")


@query(f"""SELECT event_type AS event, round(quantile_cont({DUR} / 3600.0, 0.9), 4) AS value, count(nts) AS n FROM ({LEAD})
    WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""")
def metric_duration_percentile(spark: SparkSession, d: str) -> DataFrame:
    m = Metric("duration_percentile", "ts", start="ts", end="until", quantile=0.9)
    return metrics.execute(spans(spark, d), m, "2024-01-01", "2024-01-20", ["event"])


def series_sql(part: str) -> str:
    return f"SELECT date_trunc('{part}', o_orderdate)::TIMESTAMP AS ds, round(count_if(o_totalprice >= 100000) / count(*), 6)::DOUBLE AS y FROM orders WHERE o_orderstatus NOT IN ('P') GROUP BY 1 ORDER BY ds DESC LIMIT 730"


@query(series_sql("day"))
def metric_series_daily(spark: SparkSession, d: str) -> DataFrame:
    return metrics.series(table(spark, d, "orders"), RATIO, "D")


@query(series_sql("week"))
def metric_series_weekly(spark: SparkSession, d: str) -> DataFrame:
    return metrics.series(table(spark, d, "orders"), RATIO, "W")


@query(series_sql("month"))
def metric_series_monthly(spark: SparkSession, d: str) -> DataFrame:
    return metrics.series(table(spark, d, "orders"), RATIO, "MS")


# --- process mining ---------------------------------------------------------------------------------------------------

ALLOWED = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("purchase", "view"), ("click", "view")]
RULES = " , ".join(f"('{a}', '{b}')" for a, b in ALLOWED)
CLOSING = ("purchase", "error")
PATHS = "SELECT user_id::VARCHAR AS case_id, list(event_type ORDER BY ts, event_id) AS path FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL GROUP BY user_id"


def log_of(spark: SparkSession, d: str) -> DataFrame:
    return process.event_log(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query(f"""SELECT event_type AS activity, count(*) AS n, round(median({DUR} / 3600.0), 3) AS median, round(avg({DUR} / 3600.0), 3) AS avg, round(median({WAIT} / 3600.0), 3) AS waiting_time
    FROM ({LEAD}) GROUP BY 1""")
def bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    return process.bottlenecks(log_of(spark, d))


@query(f"""SELECT array_to_string(path, '>') AS path, count(*) AS case_count, round(count(*) / (SELECT count(DISTINCT user_id) FROM events), 4) AS frequency, min(case_id) AS first_case
    FROM ({PATHS}) GROUP BY path""")
def variants(spark: SparkSession, d: str) -> DataFrame:
    return process.variants(log_of(spark, d)).select(F.array_join("path", ">").alias("path"), "case_count", "frequency", "first_case")


@query(f"""SELECT case_id, len(path) AS steps, array_to_string(list_transform(list_filter(generate_series(1, len(path)), lambda i: i = 1 OR path[i] <> path[i - 1]), lambda i: path[i]), '>') AS simplified FROM ({PATHS})""")
def collapsed_paths(spark: SparkSession, d: str) -> DataFrame:
    return process.traces(log_of(spark, d)).select("case_id", F.size("path").cast("long").alias("steps"), F.array_join(process.collapsed("path"), ">").alias("simplified"))


@query(f"""WITH s AS (SELECT user_id, event_type AS a, nev AS b, (event_type, nev) IN ({RULES}) AS ok FROM ({LEAD}) WHERE nev IS NOT NULL)
    SELECT round((t - v) / t, 4) AS fitness, round((SELECT count(*) FROM (SELECT DISTINCT a, b FROM s WHERE ok)) / {len(ALLOWED)}, 4) AS "precision", v AS violated_cases, t AS total_cases,
           (SELECT coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') FROM events WHERE event_type NOT IN ('signup', 'view', 'click', 'purchase')) AS unknown_activities
    FROM (SELECT (SELECT count(DISTINCT user_id) FROM s WHERE NOT ok) AS v, (SELECT count(DISTINCT user_id) FROM events) AS t)""")
def conformance_summary(spark: SparkSession, d: str) -> DataFrame:
    return process.conformance(log_of(spark, d), ALLOWED).withColumn("unknown_activities", F.array_join("unknown_activities", ","))


@query(f"""SELECT user_id::VARCHAR AS case_id, ts, event_id AS place, event_type AS from_activity, nev AS to_activity FROM ({LEAD}) WHERE nev IS NOT NULL AND (event_type, nev) NOT IN ({RULES})
    ORDER BY case_id, ts, place LIMIT 10""")
def conformance_violations(spark: SparkSession, d: str) -> DataFrame:
    return process.violations(log_of(spark, d), ALLOWED)


CASES = f"""SELECT case_id, round(dur / 3600.0, 3) AS duration, round(age / 3600.0, 3) AS age, stage_count, cur AS current, closed, age / 3600.0 > 48 AS overdue,
    CASE WHEN age / 3600.0 > 48 THEN 'breached' WHEN closed THEN 'met' ELSE 'in_progress' END AS sla_status
    FROM (SELECT *, CASE WHEN closed THEN dur ELSE (epoch_us(now) - epoch_us(lo)) // 1000000 END AS age FROM (
        SELECT user_id::VARCHAR AS case_id, min(ts) AS lo, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS dur, arg_max(event_type, (ts, event_id)) AS cur,
               count(DISTINCT event_type) AS stage_count, arg_max(event_type, (ts, event_id)) IN ('purchase', 'error') AS closed, (SELECT max(ts) FROM events) AS now FROM events GROUP BY user_id))"""


@query(CASES)
def case_metrics_sla(spark: SparkSession, d: str) -> DataFrame:
    return process.case_metrics(log_of(spark, d), closed=CLOSING)


@query(f"SELECT count(*) AS total_cases, count_if(sla_status = 'met')::BIGINT AS met, count_if(sla_status = 'in_progress')::BIGINT AS in_progress, count_if(sla_status = 'breached')::BIGINT AS breached FROM ({CASES})")
def sla_summary(spark: SparkSession, d: str) -> DataFrame:
    return process.sla_summary(process.case_metrics(log_of(spark, d), closed=CLOSING))


@query(f"""SELECT event_type AS stage, count(*) AS n, round(min({DUR} / 3600.0), 3) AS min, round(median({DUR} / 3600.0), 3) AS median, round(max({DUR} / 3600.0), 3) AS max,
    round(list_sort(list({DUR} / 3600.0) FILTER (WHERE nts IS NOT NULL))[floor((count(nts) - 1) * 0.9 + 0.5)::BIGINT + 1], 3) AS p90 FROM ({LEAD}) GROUP BY 1""")
def throughput_times(spark: SparkSession, d: str) -> DataFrame:
    return process.throughput(log_of(spark, d))


@query(f"""SELECT stage, side, activity, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY stage, side ORDER BY n DESC, activity) AS rank FROM (
    SELECT event_type AS stage, 'from' AS side, pev AS activity, count(*) AS n FROM ({LEAD}) WHERE pev IS NOT NULL GROUP BY ALL
    UNION ALL SELECT event_type, 'to', nev, count(*) FROM ({LEAD}) WHERE nev IS NOT NULL GROUP BY ALL)) WHERE rank <= 3""")
def throughput_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return process.neighbours(log_of(spark, d), 3).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT count(*) AS total_rows, count(DISTINCT o_custkey) AS unique_cases, 0::BIGINT AS null_cases, 0::BIGINT AS null_timestamps, 0::BIGINT AS bad_timestamps,
    (SELECT count(*) FROM (SELECT o_custkey FROM (SELECT o_custkey, o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back FROM orders) GROUP BY 1 HAVING bool_or(back))) AS out_of_order_cases,
    0::BIGINT AS completed_before_created, count_if(o_orderdate > TIMESTAMP '1995-06-01' + INTERVAL 365 DAY)::BIGINT AS far_future, 'BLOCKED' AS verdict FROM orders""")
def readiness_gate(spark: SparkSession, d: str) -> DataFrame:
    return process.readiness(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderstatus", "o_orderkey", datetime(1995, 6, 1))


@query("""SELECT cases AS case_count, n AS total_events, cases - closed AS open_population, closed AS closed_population, round(least(1.0, n / (cases * 2)), 2)::DOUBLE AS event_coverage
    FROM (SELECT count(DISTINCT user_id) AS cases, count(*) AS n, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS closed FROM events)""")
def mapping_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("state", F.when(F.col("event_type") == "purchase", "Done").otherwise(F.col("event_type")))
    return process.mapping_summary(rows, "user_id", "state")


# --- quality ----------------------------------------------------------------------------------------------------------


def profile_sql(name: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        full = f"nullif({c}, '')" if kind == "string" else c
        bounds = "NULL::VARCHAR AS min_value, NULL::VARCHAR AS max_value" if kind == "string" else f"min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value"
        parts.append(f"SELECT '{c}' AS name, '{kind}' AS inferred_type, count(*) AS row_count, count(*) - count({full}) AS null_count, round((count(*) - count({full})) / count(*), 4) AS null_rate, count(DISTINCT {full}) AS distinct_count, {bounds} FROM {name}")
    return " UNION ALL ".join(parts)


@query(profile_sql("part", {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_size": "integer"}))
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return quality.profile(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"))


def rule_sql(kind: str, column: str, checked: str, broken: str, source: str) -> str:
    return f"SELECT '{kind}' AS kind, '{column}' AS \"column\", {checked} AS checked, {broken} AS violations, CASE WHEN {broken} = 0 THEN 'passed' ELSE 'failed' END AS status FROM {source}"


@query(rule_sql("not_null", "value", "count(*)", "count(*) - count(value)", "events"))
def rule_not_null(spark: SparkSession, d: str) -> DataFrame:
    return quality.evaluate(table(spark, d, "events"), [quality.Rule("not_null", "value")])


@query(rule_sql("unique", "o_custkey", "count(o_custkey)", "count(o_custkey) - count(DISTINCT o_custkey)", "orders"))
def rule_unique(spark: SparkSession, d: str) -> DataFrame:
    return quality.evaluate(table(spark, d, "orders"), [quality.Rule("unique", "o_custkey")])


@query(rule_sql("range", "l_quantity", "count(l_quantity)", "count_if(l_quantity < 5 OR l_quantity > 40)::BIGINT", "lineitem"))
def rule_range(spark: SparkSession, d: str) -> DataFrame:
    return quality.evaluate(table(spark, d, "lineitem"), [quality.Rule("range", "l_quantity", 5, 40)])


@query(rule_sql("regex", "p_brand", "count(nullif(p_brand, ''))", "count_if(nullif(p_brand, '') IS NOT NULL AND NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]'))::BIGINT", "part"))
def rule_regex(spark: SparkSession, d: str) -> DataFrame:
    return quality.evaluate(table(spark, d, "part"), [quality.Rule("regex", "p_brand", pattern="Brand#[1-3][0-9]")])


KEYS = [("l_orderkey",), ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey")]


def grain_sql(name: str, keys: list[tuple[str, ...]]) -> str:
    one = "SELECT '{k}' AS key_columns, 0::BIGINT AS null_components, count_if(n > 1)::BIGINT AS duplicate_groups, max(n) AS worst, max(n) <= 1 AS unique_over_full_data FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"
    return " UNION ALL ".join(one.format(k=",".join(k), t=name) for k in keys)


@query(grain_sql("lineitem", KEYS))
def grain_candidates(spark: SparkSession, d: str) -> DataFrame:
    return quality.grain(table(spark, d, "lineitem"), KEYS)


@query("SELECT l_orderkey, l_suppkey, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 3")
def grain_duplicate_examples(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_examples(table(spark, d, "lineitem"), ("l_orderkey", "l_suppkey"))


@query("""WITH a AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT (SELECT max(n) FROM a) <= 1 AS left_unique, (SELECT max(n) FROM b) AS right_max_fanout, round((SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) / (SELECT count(*) FROM b), 4) AS unmatched_right_rate,
           CASE WHEN (SELECT max(n) FROM b) > 1 THEN 'one-to-many' WHEN (SELECT count(*) FROM a) = (SELECT count(*) FROM b) THEN 'one-to-one' ELSE 'many-to-one' END AS cardinality""")
def relationship_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.relationship(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey")


@query("""SELECT o_custkey::VARCHAR AS dataset, count(*) AS revision_count, max(o_orderkey) AS latest_revision, round((epoch_us(TIMESTAMP '1998-08-01') - epoch_us(arg_max(o_orderdate, o_orderkey))) // 1000000 / 3600.0, 2) AS freshness_hours,
    CASE WHEN (epoch_us(TIMESTAMP '1998-08-01') - epoch_us(arg_max(o_orderdate, o_orderkey))) // 1000000 / 3600.0 > 168 THEN 'suspended' WHEN (epoch_us(TIMESTAMP '1998-08-01') - epoch_us(arg_max(o_orderdate, o_orderkey))) // 1000000 / 3600.0 > 72 THEN 'stale' ELSE 'fresh' END AS status
    FROM orders GROUP BY 1""")
def health_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("dataset"), F.col("o_orderkey").alias("revision"), F.col("o_orderdate").alias("created_at"))
    return quality.health(rows, datetime(1998, 8, 1))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON c_custkey = o_custkey AND n = 1""")
def latest_result_per_rule(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return quality.latest_result(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey", "o_totalprice")


# --- registers --------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return registry.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""WITH v AS (SELECT o_orderstatus AS tenant_id, o_custkey AS definition_id, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey) AS version, o_orderkey, o_orderdate FROM orders),
    p AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS effective_to FROM v WHERE o_orderkey % 2 = 0)
    SELECT v.tenant_id, v.definition_id, v.version, CASE WHEN p.version IS NULL THEN 'proposed' WHEN p.effective_to IS NULL THEN 'approved'
        WHEN v.version < (SELECT max(version) FROM p x WHERE x.tenant_id = v.tenant_id AND x.definition_id = v.definition_id) THEN 'superseded' ELSE 'withdrawn' END AS status
    FROM v LEFT JOIN p USING (tenant_id, definition_id, version)""")
def definition_versions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    v = table(spark, d, "orders").select(F.col("o_orderstatus").alias("tenant_id"), F.col("o_custkey").alias("definition_id"), "o_orderkey", "o_orderdate")
    v = v.withColumn("version", F.row_number().over(Window.partitionBy("tenant_id", "definition_id").orderBy("o_orderkey")).cast("long"))
    p = v.where("o_orderkey % 2 = 0").select("tenant_id", "definition_id", "version", F.col("o_orderdate").alias("effective_from"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("effective_to"))
    return registry.definition_status(v, p).select("tenant_id", "definition_id", "version", "status")


@query("""SELECT s_nationkey AS tenant_id, s_suppkey AS artifact_id, count(*) AS bindings, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey GROUP BY 1, 2""")
def evidence_join(spark: SparkSession, d: str) -> DataFrame:
    artifacts = table(spark, d, "supplier").select(F.col("s_nationkey").alias("tenant_id"), F.col("s_suppkey").alias("artifact_id"), "s_acctbal")
    bindings = table(spark, d, "customer").select(F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("artifact_id"))
    return registry.evidence_of(bindings, artifacts).groupBy("tenant_id", "artifact_id").agg(F.count(F.lit(1)).alias("bindings"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""SELECT o_orderstatus AS provider, o_orderpriority AS model, substr(o_orderdate::VARCHAR, 1, 7) AS day, CAST(grouping(o_orderstatus, o_orderpriority, substr(o_orderdate::VARCHAR, 1, 7)) AS BIGINT) AS level, count(*) AS calls,
    CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS tokens, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY GROUPING SETS ((), (1), (2), (3), (1, 2, 3))""")
def usage_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("month", F.substring(F.col("o_orderdate").cast("string"), 1, 7))
    return registry.usage(rows, "o_orderstatus", "o_orderpriority", "month", "o_orderkey", "o_totalprice").withColumn("cost", F.round("cost", 2))


@query("SELECT p.id AS id, t.n_name AS target, m.r_name AS model FROM (SELECT c_custkey AS id, c_nationkey FROM customer) p LEFT JOIN nation t ON p.c_nationkey = t.n_nationkey LEFT JOIN region m ON p.c_nationkey % 7 = m.r_regionkey")
def prediction_joins(spark: SparkSession, d: str) -> DataFrame:
    """Customers as predictions, nations as their targets, regions as models; some models aren't known."""
    made = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("target_id"), (F.col("c_nationkey") % 7).alias("model_id"))
    targets = table(spark, d, "nation").select(F.col("n_nationkey").alias("target_id"), F.col("n_name").alias("target"))
    models = table(spark, d, "region").select(F.col("r_regionkey").alias("model_id"), F.col("r_name").alias("model"))
    return registry.predictions(made, targets, models).select("id", "target", "model")


@query("""SELECT c_custkey AS id, c_name AS name, n_name AS publication FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2""")
def current_publications(spark: SparkSession, d: str) -> DataFrame:
    """Nations as publications of the customers in them; those of one region have ended."""
    publications = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("publication"), F.when(F.col("n_regionkey") == 2, F.lit("1996-01-01")).alias("effective_to"))
    return registry.with_current(table(spark, d, "customer"), publications, "c_nationkey").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "publication")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def tenant_rows(spark: SparkSession, d: str) -> DataFrame:
    return registry.scoped(table(spark, d, "customer"), 7, "c_nationkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, round(CASE WHEN isfinite(v) THEN v END, 3) AS v FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE c_acctbal / 7 END AS v FROM customer)")
def finite_values(spark: SparkSession, d: str) -> DataFrame:
    from skerry.functions.nulls import finite

    k = F.col("c_custkey") % 4
    value = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("c_acctbal") / 7)
    return table(spark, d, "customer").select("c_custkey", finite(value, 3).alias("v"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE lower(n_name) END AS label FROM nation")
def labels_by_locale(spark: SparkSession, d: str) -> DataFrame:
    """Names in two languages; those of one region have an English one only."""
    both = F.when(F.col("n_regionkey") == 1, F.create_map(F.lit("en"), F.col("n_name"))).otherwise(F.create_map(F.lit("en"), F.col("n_name"), F.lit("ar"), F.lower("n_name")))
    return table(spark, d, "nation").select("n_nationkey", words.label(both, "ar").alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 300 SECOND THEN 'failed' WHEN o_orderstatus = 'O' THEN 'validating' ELSE 'validated' END AS state FROM orders")
def lease_sweep(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "validating").otherwise("validated").alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"))
    return monitoring.expired_leases(runs, datetime(1996, 1, 1)).select("o_orderkey", "state")


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 1000")
def newest_latencies(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.last_of(table(spark, d, "events").select("event_id", "value"), "event_id")


@query("""SELECT 'c_nationkey' AS name, round(count_if(c_nationkey IS NULL) / count(*), 4)::DOUBLE AS null_rate, (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT c_nationkey::VARCHAR AS v, min(c_custkey) AS k FROM customer GROUP BY 1 ORDER BY k LIMIT 3)) AS sample FROM customer
    UNION ALL SELECT 'c_mktsegment', round(count_if(c_mktsegment = 'BUILDING') / count(*), 4)::DOUBLE, (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT c_mktsegment AS v, min(c_custkey) AS k FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 ORDER BY k LIMIT 3)) FROM customer""")
def column_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of the customers in order of their keys, one market segment being blank."""
    from skerry.sources.ingest import column_meta

    rows = table(spark, d, "customer").orderBy("c_custkey").select("c_nationkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("c_mktsegment"))
    return column_meta(rows).select("name", "null_rate", F.array_join("sample", "|").alias("sample"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' AND o_orderstatus = 'F'")
def formula_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders of which some hold a cell that a spreadsheet would run."""
    from skerry.sources.ingest import formula_cells

    p = F.substring("o_orderpriority", 1, 1)
    cell = F.when(p == "2", F.lit("=SUM(A1:A9)")).when((p == "3") & (F.col("o_orderstatus") == "F"), F.lit(" @cmd|' /C calc'!A0")).when(p == "3", F.lit("-12.5")).otherwise(F.lit("a=(b)"))
    lines = table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", F.col("o_orderkey").cast("string"), cell, "o_orderstatus").alias("value"))
    return formula_cells(lines).select("o_orderkey")


@query("SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, '1996-01-02' AS day FROM customer")
def refreshed_csv(spark: SparkSession, d: str) -> DataFrame:
    """Customers delivered as CSV and read with inferred types; days stay texts."""
    from skerry.sources.ingest import refresh_rows

    rows = table(spark, d, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.format_string("%.2f", "c_acctbal"), F.lit("1996-01-02")).alias("value"))
    got = refresh_rows(spark, delivered(spark, rows, "c_custkey,c_name,c_mktsegment,c_acctbal,day"))
    return got.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment", F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"), "day")


@query("SELECT n_regionkey, sum(n)::BIGINT AS rows_held, bool_and(true) AS intact FROM (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) GROUP BY 1")
def captured_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The customers of each region captured as evidence (as Parquet, being many; a region of 100 or fewer as text), read again with its digest verified."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey", "c_name")
    folder, out = shared_folder(spark, "evidence"), []
    for k in range(5):
        manifest = registry.capture_evidence(rows.where(F.col("n_regionkey") == k).orderBy("c_custkey"), f"{folder}/{k}")
        out.append((k, registry.evidence_table(spark, manifest).count(), True))
    return spark.createDataFrame(out, "n_regionkey long, rows_held long, intact boolean").where("rows_held > 0")


@query("SELECT o_custkey AS rule_id, o_orderpriority AS method, o_orderkey AS i, concat_ws(':', o_custkey, o_orderpriority, o_orderkey) AS episode_identity FROM orders WHERE o_orderkey % 3 <> 0")
def episode_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every third order is an episode that is open already."""
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("rule_id"), F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("i"))
    held = found.where("i % 3 = 0").select("rule_id", monitoring.identity().alias("episode_identity"))
    return monitoring.new_episodes(found, held).select("rule_id", "method", "i", "episode_identity")


@query("SELECT o_orderkey AS state_id, o_custkey AS rule_id, c_name AS rule_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def condition_rules(spark: SparkSession, d: str) -> DataFrame:
    """Orders as condition states; every other customer is a rule that still exists."""
    states = table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("tenant_id"), F.col("o_custkey").alias("rule_id"), F.col("o_orderkey").alias("state_id"))
    rules = table(spark, d, "customer").where("c_custkey % 2 = 0").select((F.col("c_custkey") % 3).alias("tenant_id"), F.col("c_custkey").alias("rule_id"), F.col("c_name").alias("name"))
    return registry.conditions_with_rules(states, rules).select("state_id", "rule_id", "rule_name")


@query("SELECT l_suppkey AS provider_id, s_name AS provider_name, count(*) AS calls, sum(l_linenumber)::BIGINT AS tokens, round(sum(l_extendedprice), 2) AS cost FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON l_suppkey = s_suppkey GROUP BY 1, 2")
def usage_by_provider(spark: SparkSession, d: str) -> DataFrame:
    """Lines as usage, every other supplier as a provider."""
    rows = table(spark, d, "lineitem").select(F.lit(1).alias("tenant_id"), F.col("l_suppkey").alias("provider_id"), F.col("l_linenumber").cast("long").alias("tokens"), F.col("l_extendedprice").alias("cost"))
    providers = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.lit(1).alias("tenant_id"), F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("name"))
    return registry.usage_by_provider(rows, providers).select("provider_id", "provider_name", "calls", "tokens", F.round("cost", 2).alias("cost"))


@query("SELECT s_suppkey AS role, n_name AS provider_name, n_regionkey AS provider_status, k AS known_only FROM supplier JOIN (VALUES (false), (true)) v(k) ON true LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey WHERE NOT k OR n_name IS NOT NULL")
def role_providers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as roles, every other nation as a provider; both forms of the join."""
    roles = table(spark, d, "supplier").select(F.lit(1).alias("tenant_id"), F.col("s_nationkey").alias("provider_id"), F.col("s_suppkey").alias("role"))
    providers = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.lit(1).alias("tenant_id"), F.col("n_nationkey").alias("provider_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("status"))
    both = [registry.roles_with_providers(roles, providers, k).select("role", "provider_name", "provider_status", F.lit(k).alias("known_only")) for k in (False, True)]
    return both[0].union(both[1])


@query("SELECT event_type AS source_type, user_id AS source_id, min(event_id) AS request_id FROM events WHERE NOT (event_type = 'purchase' AND user_id % 2 = 0) GROUP BY 1, 2")
def new_investigations(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests; purchases of users with even ids are being investigated already."""
    rows = table(spark, d, "events").select(F.lit(1).alias("tenant_id"), F.col("event_type").alias("source_type"), F.col("user_id").alias("source_id"), F.col("event_id").alias("request_id"))
    held = rows.where("source_type = 'purchase' AND source_id % 2 = 0")
    return registry.new_investigations(rows, held).select("source_type", "source_id", "request_id")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def paged_orders(spark: SparkSession, d: str) -> DataFrame:
    rows, total = registry.page_with_total(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 100, 50)
    return rows.select("o_orderkey", F.lit(total).cast("long").alias("total"))


def delivered(spark: SparkSession, rows: DataFrame, header: str, encoding: str | None = None) -> str:
    """The lines of rows (value) as files under one header, as a source would deliver them."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1).cast("long")) == 0
    lines, folder = rows.select(F.when(first, F.concat(F.lit(header + "\n"), "value")).otherwise(F.col("value")).alias("value")), shared_folder(spark, "csv")
    if encoding:
        lines = lines.select(F.encode("value", encoding).cast("string").alias("value"))  # bytes as they are
    lines.write.text(folder)
    return folder


@query("SELECT n_nationkey, n_name, n_regionkey, 'integer' AS key_type, 'string' AS name_type, 0::BIGINT AS rejected FROM nation")
def parsed_csv(spark: SparkSession, d: str) -> DataFrame:
    """Nations, written as one CSV file to the shared folder and taken in again."""
    from skerry.sources.ingest import parse_file

    folder = shared_folder(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.option("header", True).csv(folder)
    name = next(r[0] for r in spark.read.format("binaryFile").load(folder).select("path").collect())  # one file
    got = parse_file(spark, name)
    return got.accepted.select("*", F.lit(got.types["n_nationkey"]).alias("key_type"), F.lit(got.types["n_name"]).alias("name_type"), F.lit(got.rejected.count()).cast("long").alias("rejected"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang = 'de', false) AS more FROM documents)
    SELECT 'kept' AS outcome, doc_id::VARCHAR AS doc_id, sha256(t) AS text_sha256, 1::BIGINT AS n FROM d WHERE NOT more AND length(t) <= 32767
    UNION ALL SELECT 'expected 3 fields, got 4', NULL, NULL, count(*) FROM d WHERE more HAVING count(*) > 0
    UNION ALL SELECT 'cell exceeds max length', NULL, NULL, count(*) FROM d WHERE NOT more AND length(t) > 32767 HAVING count(*) > 0""")
def csv_records_over_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents, with their line breaks and quotes, as cells of CSV files; German ones have a cell too many."""
    from skerry.sources.ingest import parse_csv

    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = table(spark, d, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted(F.col("source")), quoted(F.col("text")), F.when(F.col("lang") == "de", "more")).alias("value"))
    got = parse_csv(spark, delivered(spark, rows, "doc_id,source,text"))
    kept = got.accepted.select(F.lit("kept").alias("outcome"), "doc_id", F.sha2("text", 256).alias("text_sha256"), F.lit(1).cast("long").alias("n"))
    return kept.unionByName(got.rejected.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"


@query(f"SELECT c_custkey, translate(lower(c_name), '{LATIN}', '{ARABIC}') AS name, round(c_acctbal, 2) AS balance FROM customer")
def csv_in_arabic_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Customers with Arabic names, delivered in cp1256 with semicolons between the cells."""
    from skerry.sources.ingest import parse_csv

    rows = table(spark, d, "customer").select(F.concat_ws(";", "c_custkey", F.translate(F.lower("c_name"), LATIN, ARABIC.encode("cp1256").decode("iso-8859-1")), F.format_string("%.2f", "c_acctbal")).alias("value"))
    got = parse_csv(spark, delivered(spark, rows, "c_custkey;name;balance", "iso-8859-1")).accepted  # the same bytes
    return got.select(F.col("c_custkey").cast("long").alias("c_custkey"), "name", F.col("balance").cast("double").alias("balance"))


CONTROL_SQL = """WITH c AS (SELECT o_custkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS t, o_orderpriority = '5-LOW' AS gone, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey % 3 DESC, o_orderkey DESC) AS r FROM orders),
    o AS (SELECT *, lag(CASE WHEN gone THEN 'gone' ELSE concat_ws('|', status, price) END) OVER (PARTITION BY k ORDER BY t) AS before, CASE WHEN gone THEN 'gone' ELSE concat_ws('|', status, price) END AS now FROM c WHERE r = 1),
    v AS (SELECT k, status, price, gone, t AS valid_from, lead(t) OVER (PARTITION BY k ORDER BY t) AS valid_to FROM o WHERE before IS NULL OR before <> now)"""


@query(CONTROL_SQL + " SELECT k AS o_custkey, CASE WHEN NOT gone THEN status END AS status, CASE WHEN NOT gone THEN round(price, 2) END AS price, gone AS tombstone, valid_from, valid_to FROM v")
def control_table_history(spark: SparkSession, d: str) -> DataFrame:
    """Customers' last orders as a control table: three merges, orders of low priority being tombstones."""
    from skerry.sources import control

    folder, orders = shared_folder(spark, "control"), table(spark, d, "orders")
    changes = orders.select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("at"), (F.col("o_orderpriority") == "5-LOW").alias("deleted"), "o_orderkey")
    for k in range(3):
        control.upsert(changes.where(F.col("o_orderkey") % 3 == k), folder, ["o_custkey"], place="o_orderkey")
    rows = control.history(spark, folder)
    return rows.select("o_custkey", *(F.when(~F.col("tombstone"), F.col(c)).alias(c) for c in ("status",)), F.when(~F.col("tombstone"), F.round("price", 2)).alias("price"), "tombstone", "valid_from", "valid_to")


@query("""WITH o AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) AS revision, count(*) AS row_count FROM orders GROUP BY 1)
    SELECT revision, row_count, row_count AS rows_read, lag(revision) OVER (ORDER BY revision) AS previous, revision = max(revision) OVER () AS current FROM o""")
def published_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Orders published priority by priority, and what readers find of each revision."""
    from skerry.sources import publishing

    orders, folder = table(spark, d, "orders"), shared_folder(spark, "revisions")
    kinds = sorted(r[0] for r in orders.select("o_orderpriority").distinct().collect())  # five
    said = [publishing.publish(orders.where(F.col("o_orderpriority") == p), folder, before=k) for k, p in enumerate(kinds)]
    last = publishing.newest(spark, folder)[1]["revision"]
    read = [(m["revision"], m["row_count"], publishing.published(spark, folder, m["revision"]).count(), m["previous"], m["revision"] == last) for m in said]
    return spark.createDataFrame(read, "revision long, row_count long, rows_read long, previous long, current boolean")


@query("SELECT CASE WHEN bool_and(try_cast(o_orderkey AS DOUBLE) IS NOT NULL) THEN max(o_orderkey)::VARCHAR END AS numeric_mark, max(o_orderpriority) AS text_mark FROM orders")
def watermarks(spark: SparkSession, d: str) -> DataFrame:
    from skerry.sources.ingest import watermark

    orders = table(spark, d, "orders")
    return orders.agg(watermark("o_orderkey").alias("numeric_mark"), watermark("o_orderpriority").alias("text_mark"))


@query("""WITH r AS (SELECT o_custkey AS dataset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, o_orderkey AS row_count FROM orders),
    x AS (SELECT dataset_id, max(revision) AS latest_revision, arg_max(row_count, revision) AS latest_rows FROM r GROUP BY 1)
    SELECT c_custkey AS dataset_id, latest_revision, latest_rows, r.row_count AS published_rows FROM customer LEFT JOIN x ON c_custkey = x.dataset_id LEFT JOIN r ON c_custkey = r.dataset_id AND r.revision = 2""")
def dataset_revisions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    orders = table(spark, d, "orders").select(F.lit(1).alias("tenant_id"), F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("row_count"))
    revisions = orders.withColumn("revision", F.row_number().over(Window.partitionBy("dataset_id").orderBy("row_count")).cast("long"))
    datasets = table(spark, d, "customer").select(F.lit(1).alias("tenant_id"), F.col("c_custkey").alias("dataset_id"), F.lit(2).cast("long").alias("published"))
    return registry.datasets_with_revisions(datasets, revisions).select("dataset_id", "latest_revision", "latest_rows", "published_rows")


@query("""SELECT a.c_custkey AS decision_id, m.metric, m.expected, o.value, o.value - m.expected AS difference FROM customer a, (VALUES ('balance', 100.0::DOUBLE), ('orders', 10.0::DOUBLE)) m(metric, expected)
    LEFT JOIN (SELECT o_custkey, 'orders' AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 1) o ON o.o_custkey = a.c_custkey AND o.metric = m.metric""")
def outcome_comparison(spark: SparkSession, d: str) -> DataFrame:
    evidence = table(spark, d, "customer").select(F.col("c_custkey").alias("decision_id"), F.create_map(F.lit("balance"), F.lit(100.0), F.lit("orders"), F.lit(10.0)).alias("metrics"))
    observed = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("decision_id")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit("orders"))
    return registry.outcome_comparison(evidence, observed).select("decision_id", "metric", "expected", "value", "difference")


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS open_alerts, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS high_risk_cases, (SELECT count(*) FROM orders WHERE o_orderpriority <> '5-LOW') AS active_investigations,
    count_if(c_nationkey % 4 = 0)::BIGINT AS open_decisions, count_if(c_nationkey % 4 = 1)::BIGINT AS reviews_due, count_if(c_nationkey % 4 = 2)::BIGINT AS completed_reviews FROM customer""")
def pilot_summary(spark: SparkSession, d: str) -> DataFrame:
    """Orders as alerts and investigations, customers as scored cases and decisions."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    alerts = orders.select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("resolved_at"))
    scored_cases = customers.select(F.when(F.col("c_acctbal") < 0, "HIGH").otherwise("LOW").alias("risk_tier"))
    inquiries = orders.select(F.when(F.col("o_orderpriority") == "5-LOW", "closed").otherwise("open").alias("status"))
    k = F.col("c_nationkey") % 4
    decisions = customers.select(F.when(k == 0, "active").when(k == 1, "review_due").when(k == 2, "evaluated").otherwise("withdrawn").alias("status"))
    return registry.pilot_summary(alerts, scored_cases, inquiries, decisions)


@query("""SELECT 'metric' AS machine, o_custkey AS id, string_agg(s, '>' ORDER BY o_orderkey) AS states, bool_and(ok) AS legal FROM (
    SELECT *, (f, s) IN (('proposed', 'approved'), ('approved', 'superseded'), ('approved', 'withdrawn')) AND (p IS NULL OR p = f) AS ok FROM (
        SELECT *, lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM (SELECT o_custkey, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'proposed' ELSE 'approved' END AS f,
            CASE o_orderkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'superseded' ELSE 'withdrawn' END AS s FROM orders))) GROUP BY 2""")
def lifecycle_histories(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    moves = table(spark, d, "orders").select(F.lit("metric").alias("machine"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), F.when(k == 0, "proposed").otherwise("approved").alias("from_state"), F.when(k == 0, "approved").when(k == 1, "superseded").otherwise("withdrawn").alias("to_state"))
    return registry.histories(moves).withColumn("states", F.array_join("states", ">"))


# --- monitoring -------------------------------------------------------------------------------------------------------

DAILY = "SELECT CAST(row_number() OVER (ORDER BY ds) - 1 AS BIGINT) AS i, ds, y FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    points = metrics.series(table(spark, d, "events"), Metric("count", "ts"), "D").withColumn("series_id", F.lit("events"))
    return metrics.numbered(points, ["series_id"])


BANDED_END = """, hits AS (SELECT *, abs(y - (lo + hi) / 2) / (abs((lo + hi) / 2) + 1e-12) AS e FROM band WHERE i >= 1 AND (y < lo OR y > hi))
    SELECT i, y AS observed, round(lo, 6) AS expected_lower, round(hi, 6) AS expected_upper, '{m}' AS method, round(e, 6) AS effect_size,
        (SELECT coalesce(min(k), least(h.i, 10)) FROM (SELECT h.i - j.i AS k FROM s j WHERE j.i <= h.i AND j.i > greatest(0, h.i - 10) AND NOT (j.y < h.lo OR j.y > h.hi))) AS persistent_count
    FROM hits h WHERE e >= 0.01"""


@query(f"""WITH s AS ({DAILY}), band AS (SELECT i, y, avg(y) OVER w - 1.2 * coalesce(stddev_samp(y) OVER w, 1.0) AS lo, avg(y) OVER w + 1.2 * coalesce(stddev_samp(y) OVER w, 1.0) AS hi FROM s WINDOW w AS (ORDER BY i ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"""
       + BANDED_END.format(m="residual"))
def residual_anomalies(spark: SparkSession, d: str) -> DataFrame:
    out = monitoring.anomalies(monitoring.residual_bands(daily(spark, d), 7, 1.2), "residual")
    return out.drop("series_id").withColumns({"i": F.col("i").cast("long"), "persistent_count": F.col("persistent_count").cast("long")})


@query(f"""WITH s AS ({DAILY}), pre AS (SELECT a.i, CASE WHEN a.i < 7 THEN 0 ELSE b.i % 7 END AS ph, b.y FROM s a JOIN s b ON b.i < a.i),
    mid AS (SELECT i, ph, median(y) AS m FROM pre GROUP BY 1, 2),
    mad AS (SELECT i, ph, m, CASE WHEN median(abs(y - m)) = 0 THEN 1.0 ELSE median(abs(y - m)) END AS d FROM pre JOIN mid USING (i, ph) GROUP BY 1, 2, 3),
    env AS (SELECT i, min(m - 1.5 * d) AS lo, max(m + 1.5 * d) AS hi FROM mad GROUP BY 1), band AS (SELECT s.i, s.y, lo, hi FROM s JOIN env USING (i))"""
       + BANDED_END.format(m="seasonal_naive"))
def seasonal_naive_anomalies(spark: SparkSession, d: str) -> DataFrame:
    out = monitoring.anomalies(monitoring.seasonal_bands(daily(spark, d), 7, 1.5), "seasonal_naive")
    return out.drop("series_id").withColumn("persistent_count", F.col("persistent_count").cast("long"))


@query("SELECT r_regionkey::VARCHAR AS rule_id, i, observed, concat(r_regionkey, ':', method, ':', i) AS episode_identity FROM (" + ORACLES["residual_anomalies"] + ") JOIN region ON persistent_count >= 1 + r_regionkey % 2 WHERE r_regionkey <> 4 AND NOT (r_regionkey = 0 AND i % 2 = 0)")
def rule_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Regions as rules over the daily counts: the last one is off, and of the first one every other place has an open episode."""
    rules = table(spark, d, "region").selectExpr("cast(r_regionkey AS string) AS rule_id", "'events' AS series_id", "'residual' AS method", "7 AS season", "1.2D AS threshold", "0.01D AS min_effect", "1 + r_regionkey % 2 AS persistence", "r_regionkey <> 4 AS enabled")
    points = daily(spark, d)
    held = points.where("i % 2 = 0").selectExpr("'0' AS rule_id", "concat('0:residual:', i) AS episode_identity")
    return monitoring.evaluate_rules(rules, points, held).select("rule_id", "i", "observed", "episode_identity")


@query(f"SELECT 'numbers' AS series_id, (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS i, p_size::DOUBLE AS y FROM part WHERE p_size IS NOT NULL UNION ALL SELECT 'counts', i, y FROM ({DAILY})")
def loaded_series(spark: SparkSession, d: str) -> DataFrame:
    numbers = monitoring.load_series(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey"], "numbers")
    days = table(spark, d, "events").select("event_type", F.date_trunc("day", "ts").alias("ds"))
    return numbers.union(monitoring.load_series(days, [], "counts"))


@query("SELECT (row_number() OVER (ORDER BY o_orderdate) - 1)::BIGINT AS i, o_orderdate AS ds, round(avg(o_totalprice), 4) AS y FROM orders WHERE o_orderdate IS NOT NULL GROUP BY o_orderdate")
def averaged_series(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "orders").select(F.lit("orders").alias("series_id"), F.col("o_orderdate").alias("ds"), F.col("o_totalprice").alias("y"))
    return forecasting.averaged(points).select("i", "ds", F.round("y", 4).alias("y"))


@query(f"""WITH RECURSIVE s AS ({DAILY}), mu AS (SELECT avg(y) AS mu FROM s WHERE i < (SELECT count(*) // 2 FROM s)),
    f(i, y, u, d) AS (SELECT -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
        SELECT s.i, s.y, greatest(0, CASE WHEN f.u > 5 OR f.d > 5 THEN 0 ELSE f.u END + (s.y - mu) - 0.5), greatest(0, CASE WHEN f.u > 5 OR f.d > 5 THEN 0 ELSE f.d END - (s.y - mu) - 0.5) FROM f JOIN s ON s.i = f.i + 1, mu)
    SELECT i, y AS observed, CASE WHEN u > d THEN 'up' ELSE 'down' END AS direction, round(greatest(u, d), 4) AS cumulative_sum, round(mu, 4) AS baseline_mean, round(abs(y - mu) / (abs(mu) + 1e-12), 6) AS effect_size FROM f, mu WHERE u > 5 OR d > 5""")
def cusum_shifts(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.cusum(daily(spark, d)).drop("series_id")


@query("""WITH e AS (SELECT user_id, ts, event_type = 'error' AS fire FROM events WHERE event_type IN ('error', 'purchase')), l AS (SELECT user_id, max(CASE WHEN NOT fire THEN ts END) AS r FROM e GROUP BY 1),
    n AS (SELECT e.user_id, count(*) AS n, max(ts) AS started FROM e JOIN l USING (user_id) WHERE fire AND (r IS NULL OR ts > r) GROUP BY 1)
    SELECT user_id AS rule_id, CASE WHEN n >= 2 THEN 'active' WHEN n = 1 THEN 'pending' WHEN r IS NOT NULL THEN 'recovered' ELSE 'normal' END AS condition, coalesce(started, r) AS started_at FROM l LEFT JOIN n USING (user_id)""")
def alert_conditions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type IN ('error', 'purchase')")
    return monitoring.conditions(rows.select(F.col("user_id").alias("rule_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "fire").otherwise("resolve").alias("event")))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value IS NOT NULL").groupBy("event_type").agg(*monitoring.nearest_rank("value"))


def bucket_sql(key: str, capacity: int) -> str:
    """Levels in sixtieths of a millionth of a token, so that all of it is in whole numbers."""
    full, token = capacity * monitoring.TOKEN, monitoring.TOKEN
    return f"""WITH RECURSIVE e AS (SELECT {key} AS key, epoch_us(ts) AS us, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS i FROM events WHERE ts IS NOT NULL GROUP BY {key}, ts),
    q AS (SELECT key, us, n, i, least(n, {capacity})::BIGINT AS ok, {full}::BIGINT - least(n, {capacity})::BIGINT * {token} AS level FROM e WHERE i = 1
        UNION ALL SELECT e.key, e.us, e.n, e.i, least(e.n, least({full}, level + (e.us - q.us) * {capacity}) // {token})::BIGINT, (least({full}, level + (e.us - q.us) * {capacity}) - least(e.n, least({full}, level + (e.us - q.us) * {capacity}) // {token}) * {token})::BIGINT
        FROM q JOIN e ON e.key IS NOT DISTINCT FROM q.key AND e.i = q.i + 1)
    SELECT key, sum(ok)::BIGINT AS allowed, sum(n)::BIGINT AS requests FROM q GROUP BY key"""


@query(bucket_sql("user_id::VARCHAR", 1))
def token_bucket_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return monitoring.token_bucket(rows, 1).groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("requests").alias("requests"))


@query(bucket_sql("event_type", 2))
def token_bucket_of_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    """Five keys with all events, served in some thirty blocks of time."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("ts").alias("at"))
    cuts = selection.edges(rows, "at", max(1, rows.count() // 30))
    return monitoring.token_bucket(rows, 2, cuts).groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("requests").alias("requests"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate NULLS FIRST, l_orderkey, l_linenumber) - 1 AS place FROM lineitem")
def places_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Every line's place by date, counted over some twenty ranges of dates."""
    lines = table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return selection.placed(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], "place", selection.edges(lines, "l_shipdate", max(1, lines.count() // 20))).drop("l_shipdate")


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, count(l_extendedprice) AS n FROM lineitem GROUP BY 1""")
def quantiles_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of three large groups, selected over some fifty counted ranges of prices."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    known = selection.ranked(lines, ["l_returnflag"], "l_extendedprice", selection.edges(lines, "l_extendedprice", max(1, lines.count() // 50)))
    return known.groupBy("l_returnflag").agg(F.round(selection.quantile("l_extendedprice", 0.5), 4).alias("median"), F.round(selection.quantile("l_extendedprice", 0.99), 4).alias("p99"), F.max("known").alias("n"))


ETS_SQL = f"""WITH RECURSIVE p AS (SELECT series_id, i::BIGINT AS i, y::DOUBLE AS y FROM (SELECT o_orderpriority AS series_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) - 1 AS i, n AS y FROM (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL))),
    a AS (SELECT series_id, list(y ORDER BY i) AS y, count(*) AS len FROM p GROUP BY 1 HAVING count(*) >= {forecasting.MIN_PERIODS}),
    g(model, alpha, beta, gamma, k, place) AS (VALUES {", ".join(str((*row, n)) for n, row in enumerate(forecasting.ets_grid(12)))}),
    r AS (SELECT a.*, g.*, CASE WHEN len >= 24 THEN 12 ELSE 2 END AS begin FROM a, g WHERE model NOT LIKE '__A' OR len >= 24),
    q AS (SELECT series_id, place, y, len, begin, begin::BIGINT AS i, list_sum(y[1:begin]) / begin AS level, CASE WHEN model LIKE '_A_' THEN (y[begin] - y[1]) / (begin - 1) ELSE 0.0::DOUBLE END AS trend,
            CASE WHEN model LIKE '__A' THEN list_transform(y[1:begin], lambda v: v - list_sum(y[1:begin]) / begin) ELSE [0.0::DOUBLE] END AS s, 0.0::DOUBLE AS sse, alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, gamma::DOUBLE AS gamma FROM r
        UNION ALL SELECT series_id, place, y, len, begin, i + 1, level + trend + alpha * e, trend + alpha * beta * e, list_append(s[2:], s[1] + gamma * e), sse + e * e, alpha, beta, gamma FROM (SELECT *, y[i + 1] - level - trend - s[1] AS e FROM q WHERE i < len)),
    c AS (SELECT q.series_id, g.model, q.alpha, q.beta, q.gamma, g.place, (q.len - q.begin) * ln(greatest(sse / (q.len - q.begin), 1e-12)) + 2 * k + 2 * k * (k + 1) / (q.len - q.begin - k - 1) AS aicc, level + trend + s[1] AS yhat FROM q JOIN g USING (place) WHERE i = len AND q.len - q.begin > k + 1)
    SELECT series_id, model, alpha, beta, gamma, round(aicc, 4) AS aicc, round(yhat, 4) AS yhat FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aicc, place) = 1"""


@query(ETS_SQL)
def ets_selection(spark: SparkSession, d: str) -> DataFrame:
    """The best exponential smoothing of the monthly orders of each priority."""
    months = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("month", "o_orderdate").alias("ds")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return forecasting.ets(metrics.numbered(months, ["series_id"]), 12)


# --- text -------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'))::BIGINT AS n_tokens FROM documents")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(words.tokens(F.lower("text"))).cast("long").alias("n_tokens"))


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS normalised_sha256 FROM documents")
def normalize_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(words.normalise(F.col("text")), 256).alias("normalised_sha256"))


@query("SELECT p_partkey, contains(lower(p_name), 'steel') OR list_contains(regexp_extract_all(lower(p_name), '[\\p{L}\\p{M}\\p{N}_]+'), 'steel') AS matched FROM part")
def search_match(spark: SparkSession, d: str) -> DataFrame:
    alias = words.aliases(F.col("p_name"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), composed=True)
    return table(spark, d, "part").select("p_partkey", F.coalesce(words.matches("Steel", alias), F.lit(False)).alias("matched"))


@query("SELECT event_id, ts AS at, ts + INTERVAL 3 HOUR AS local_at, date_trunc('hour', ts)::TIMESTAMP AS hour, date_trunc('week', ts)::TIMESTAMP AS week, (event_id % 48) * 3600.0 AS seconds FROM events")
def time_functions(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ts")
    span = times.duration_seconds(F.concat((F.col("event_id") % 48).cast("string"), F.lit("h")))
    return table(spark, d, "events").select("event_id", at.alias("at"), times.convert(at, "UTC", "Asia/Bahrain").alias("local_at"), times.bucket(at, "H").alias("hour"), times.bucket(at, "W").alias("week"), span.alias("seconds"))


# --- forecasting ------------------------------------------------------------------------------------------------------


@query(f"""WITH s AS ({DAILY}), st AS (SELECT *, (epoch_us(ds) - epoch_us(lag(ds) OVER (ORDER BY ds))) // 1000000 AS step FROM s)
    SELECT 'events' AS series_id, count(*) AS observations, round(count(*) / (floor(((epoch_us(max(ds)) - epoch_us(min(ds))) // 1000000) / median(step)) + 1), 4) AS coverage, stddev_samp(y) = 0 AS constant, count(*) >= 12 AS sufficient FROM st""")
def suitability(spark: SparkSession, d: str) -> DataFrame:
    return forecasting.suitability(daily(spark, d))


def ahead_sql(back: str) -> str:
    return f"WITH s AS ({DAILY}), n AS (SELECT count(*) AS n FROM s) SELECT g.step::INTEGER AS step, s.y AS yhat FROM n, generate_series(1, 14) g(step), s WHERE s.i = {back}"


@query(ahead_sql("n - 1"))
def naive_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecasting.ahead(daily(spark, d), 14, "Naive").select("step", "yhat")


@query(ahead_sql("n - 7 + (step - 1) % 7"))
def seasonal_naive_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecasting.ahead(daily(spark, d), 14, "SeasonalNaive").select("step", "yhat")


HELD = f"WITH s AS ({DAILY}), n AS (SELECT count(*) AS n, count(*) - greatest(3, least(round_even(count(*) * 0.2, 0)::BIGINT, count(*) - 12)) AS cut FROM s)"


@query(f"""{HELD}, p AS (SELECT s.y, b.y AS yhat FROM s, n, s b WHERE s.i >= cut AND b.i = cut - 7 + (s.i - cut) % 7), sc AS (SELECT avg(abs(d)) AS scale FROM (SELECT y - lag(y, 7) OVER (ORDER BY i) AS d FROM s, n WHERE i < cut))
    SELECT round(avg(abs(y - yhat)), 6) AS mae, round(avg(abs(y - yhat) / abs(y)) * 100, 6) AS mape, round(sqrt(avg((y - yhat) ** 2)), 6) AS rmse, round(avg(abs(y - yhat)) / (SELECT scale FROM sc), 6) AS mase FROM p""")
def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    cut = forecasting.split(daily(spark, d))
    return forecasting.errors(forecasting.baseline(cut, "SeasonalNaive"), forecasting.scale(cut)).drop("series_id")


@query(f"""{HELD}, p AS (SELECT s.y, b.y AS yhat FROM s, n, s b WHERE s.i >= cut AND b.i = cut - 1) SELECT round(avg(greatest(0.1 * (y - yhat), -0.9 * (y - yhat))), 6) AS q10, round(avg(greatest(0.9 * (y - yhat), -0.1 * (y - yhat))), 6) AS q90 FROM p""")
def pinball_loss(spark: SparkSession, d: str) -> DataFrame:
    p = forecasting.baseline(forecasting.split(daily(spark, d)), "Naive")
    return p.agg(*(F.round(forecasting.pinball(F.col("y"), F.col("yhat"), q), 6).alias(f"q{round(q * 100)}") for q in (0.1, 0.9)))


@query(f"""WITH s AS ({DAILY}), n AS (SELECT count(*) AS n FROM s), f AS (SELECT k AS fold, n - (3 - k) * 3 AS cut FROM n, generate_series(0, 2) g(k)),
    p AS (SELECT fold, m, s.y, b.y AS yhat FROM f, (VALUES ('Naive'), ('SeasonalNaive')) v(m), s, s b WHERE s.i >= cut AND s.i < cut + 3 AND b.i = CASE m WHEN 'Naive' THEN cut - 1 ELSE cut - 6 + (s.i - cut) % 6 END),
    sc AS (SELECT fold, avg(abs(dd)) AS scale FROM (SELECT fold, y - lag(y, 6) OVER (PARTITION BY fold ORDER BY i) AS dd FROM f, s WHERE i < cut) GROUP BY 1),
    e AS (SELECT fold, m, round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) ** 2)), 6) AS rmse, round(avg(abs(y - yhat)) / any_value(scale), 6) AS mase FROM p JOIN sc USING (fold) GROUP BY 1, 2)
    SELECT m AS model, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(mase), 6) AS mase, count(*) AS folds FROM e GROUP BY 1""")
def rolling_origin(spark: SparkSession, d: str) -> DataFrame:
    return forecasting.rolling_origin(daily(spark, d), 3, 3)


@query(f"""WITH s AS ({DAILY}), n AS (SELECT count(*) AS n FROM s), f AS (SELECT k AS fold, n - (3 - k) * 3 AS cut FROM n, generate_series(0, 2) g(k)),
    d AS (SELECT i, y, y - lag(y) OVER (ORDER BY i) AS step FROM s), e AS (SELECT fold, cut, stddev_pop(step) AS sd FROM f JOIN d ON d.i < cut GROUP BY ALL),
    p AS (SELECT fold, abs(s.y - b.y) AS off, sd * sqrt(s.i - cut + 1) AS w FROM e JOIN s ON s.i >= cut AND s.i < cut + 3 JOIN s b ON b.i = cut - 1)
    SELECT 'Naive' AS model, round(avg(c80), 6) AS coverage_80, round(avg(c95), 6) AS coverage_95, count(*) AS folds FROM (SELECT fold, avg((off <= {forecasting.Z80} * w)::INT) AS c80, avg((off <= {forecasting.Z95} * w)::INT) AS c95 FROM p GROUP BY 1)""")
def rolling_coverage(spark: SparkSession, d: str) -> DataFrame:
    return forecasting.interval_coverage(daily(spark, d), 3, 3, ("Naive",))


@query()
def forecast_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return forecasting.evaluate(daily(spark, d))


@query()
def theta_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecasting.forecast(daily(spark, d), "Theta", 14)


# --- risk -------------------------------------------------------------------------------------------------------------


@query("""SELECT state, count(*) AS cases FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'EXCLUDED' WHEN TIMESTAMP '1996-01-01' >= o_orderdate + INTERVAL 90 DAY THEN 'ALREADY_OVERDUE' ELSE 'ELIGIBLE' END AS state FROM orders) GROUP BY 1""")
def case_state(spark: SparkSession, d: str) -> DataFrame:
    at = times.literal(datetime(1996, 1, 1))
    state = risk.case_state(at, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"), F.col("o_orderpriority"), ("5-LOW",))
    return table(spark, d, "orders").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("cases"))


@query("""SELECT mature, label, count(*) AS cases FROM (SELECT occ OR now >= fin AS mature, CASE WHEN occ THEN CASE WHEN hap <= fin THEN 1 ELSE 0 END WHEN now >= fin THEN 0 END AS label FROM (
    SELECT o_orderpriority = '1-URGENT' AS occ, o_orderdate + INTERVAL 7 DAY AS fin, o_orderdate + to_days((o_orderkey % 10)::INTEGER) AS hap, TIMESTAMP '1996-06-01' AS now FROM orders)) GROUP BY ALL""")
def outcome_maturity(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    happened = F.timestamp_add("DAY", F.col("o_orderkey") % 10, F.col("o_orderdate"))
    mature, label = risk.outcome_maturity(F.col("o_orderdate"), F.lit("7d"), times.literal(datetime(1996, 6, 1)), F.col("o_orderpriority") == "1-URGENT", happened)
    return orders.groupBy(mature.alias("mature"), label.alias("label")).agg(F.count(F.lit(1)).alias("cases"))


@query("""SELECT c_custkey AS case_id, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderdate <= TIMESTAMP '1996-01-01') AS last_price FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def point_in_time_features(spark: SparkSession, d: str) -> DataFrame:
    cuts = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), times.literal(datetime(1996, 1, 1)).alias("observed_at"))
    events = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("last_price"), F.col("o_orderkey").alias("place"))
    risk.guard(events, ["last_price", "place"])
    return risk.point_in_time(events, cuts, ["last_price"], place="place", pieces=selection.edges(events, "timestamp")).select("case_id", "last_price")


@query("""SELECT q.event_id, arg_max(e.value, (e.ts, e.event_id)) AS last_value, arg_max(e.event_type, (e.ts, e.event_id)) AS last_type
    FROM events q LEFT JOIN events e ON e.user_id = q.user_id AND e.ts <= q.ts - INTERVAL 1 HOUR GROUP BY q.event_id""")
def as_of_events(spark: SparkSession, d: str) -> DataFrame:
    """What was known of an event's user an hour before it, the users' time split into some twenty pieces."""
    events = table(spark, d, "events")
    early = events.select("event_id", F.col("user_id").alias("case_id"), F.expr("ts - INTERVAL 1 HOUR").alias("observed_at"))
    log = events.select(F.col("user_id").alias("case_id"), F.col("ts").alias("timestamp"), F.struct("value").alias("last_value"), F.col("event_type").alias("last_type"), F.col("event_id").alias("place"))
    known = risk.point_in_time(log, early, ["last_value", "last_type"], place="place", pieces=selection.edges(log, "timestamp", max(1, log.count() // 20)))
    return early.join(known, [early.case_id.eqNullSafe(known.case_id), early.observed_at.eqNullSafe(known.observed_at)], "left").select("event_id", "last_value.value", "last_type").toDF("event_id", "last_value", "last_type")


SCORED = "SELECT toxic AS y, round((l.doc_id * 37 % 101) / 100.0 * 0.7 + toxic * 0.3, 4) AS p FROM labels l WHERE toxic IS NOT NULL"


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").where("toxic IS NOT NULL")
    return rows.select(F.col("toxic").alias("y"), F.round((F.col("doc_id") * 37 % 101) / 100.0 * 0.7 + F.col("toxic") * 0.3, 4).alias("p"))


@query("SELECT count(*) AS n_samples, sum(toxic)::BIGINT AS n_positive, count(*) - sum(toxic)::BIGINT AS n_negative, round(sum(toxic) / count(*), 4) AS prevalence, round((count(*) - sum(toxic)) / sum(toxic), 2) AS imbalance_ratio, 'SUITABLE' AS status, true AS suitable FROM labels")
def risk_suitability(spark: SparkSession, d: str) -> DataFrame:
    return risk.suitability(table(spark, d, "labels"), "toxic")


@query(f"""WITH s AS ({SCORED}), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s),
    c AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1), k AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k FROM c)
    SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc, (SELECT round(sum(pos * tp / k) / sum(pos), 6) FROM k) AS pr_auc FROM r""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return risk.ranking_metrics(scored(spark, d))


@query(f"""SELECT count(*) AS sample_count, sum(y)::BIGINT AS positive_count, round(avg((p - y) ** 2), 6) AS brier_score, round(avg(-(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))), 6) AS log_loss,
    count_if(p >= 0.5 AND y = 1)::BIGINT AS tp, count_if(p >= 0.5 AND y = 0)::BIGINT AS fp, count_if(p < 0.5 AND y = 1)::BIGINT AS fn, count_if(p < 0.5 AND y = 0)::BIGINT AS tn,
    round(count_if(p >= 0.5 AND y = 1) / count_if(p >= 0.5), 4) AS "precision", round(count_if(p >= 0.5 AND y = 1) / sum(y), 4) AS recall FROM ({SCORED})""")
def score_metrics(spark: SparkSession, d: str) -> DataFrame:
    return risk.score_metrics(scored(spark, d))


@query(f"WITH s AS ({SCORED}), t AS (SELECT min(p) AS t FROM (SELECT p FROM s ORDER BY p DESC LIMIT 20)) SELECT round(t, 4) AS threshold, (SELECT count(*) FROM s WHERE p >= t) AS flagged_count FROM t")
def capacity_threshold(spark: SparkSession, d: str) -> DataFrame:
    return risk.capacity_threshold(scored(spark, d), 20)


def target_sql(pick: str, test: str) -> str:
    return f"""WITH s AS ({SCORED}), c AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1), k AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k, sum(pos) OVER () AS pos FROM c),
    t AS (SELECT coalesce({pick}(p), 0.5) AS t FROM k WHERE {test}) SELECT round(t, 4) AS threshold, (SELECT count(*) FROM s WHERE p >= t) AS flagged_count FROM t"""


@query(target_sql("min", "tp / k >= 0.3"))
def precision_threshold(spark: SparkSession, d: str) -> DataFrame:
    return risk.target_threshold(scored(spark, d), "precision", 0.3)


@query(target_sql("max", "tp / pos >= 0.8"))
def recall_threshold(spark: SparkSession, d: str) -> DataFrame:
    return risk.target_threshold(scored(spark, d), "recall", 0.8)


def risk_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents with two features, to learn from and held back."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("toxic").cast("double").alias("y"), F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", "\n")).cast("double").alias("lines"))
    return rows.where("doc_id % 4 <> 2"), rows.where("doc_id % 4 = 2")


@query()
def logistic_risk(spark: SparkSession, d: str) -> DataFrame:
    train, held = risk_rows(spark, d)
    return risk.predict(risk.fit_model(train, ["chars", "lines"]), held).select("doc_id", "y", F.round("p", 6).alias("p"))


@query()
def forest_risk(spark: SparkSession, d: str) -> DataFrame:
    train, held = risk_rows(spark, d)
    return risk.predict(risk.fit_model(train, ["chars", "lines"], kind="forest"), held).select("doc_id", "y", F.round("p", 6).alias("p"))


@query("""WITH r AS (SELECT l.doc_id, l.toxic::DOUBLE AS y FROM labels l JOIN documents USING (doc_id))
    SELECT doc_id, y, round((SELECT avg(y) FROM r WHERE doc_id % 4 <> 2), 6) AS p FROM r WHERE doc_id % 4 = 2""")
def base_rate_risk(spark: SparkSession, d: str) -> DataFrame:
    train, held = risk_rows(spark, d)
    return risk.base_rate(train, held).select("doc_id", "y", F.round("p", 6).alias("p"))


@query()
def platt_risk(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a logistic model, calibrated on rows that it wasn't fitted on; the raw ones where these are too few."""
    train, held = risk_rows(spark, d)
    model = risk.fit_model(train.where("doc_id % 4 <> 1"), ["chars", "lines"])
    curve = risk.calibrate(risk.predict(model, train.where("doc_id % 4 = 1")))
    raw = risk.predict(model, held)
    out = raw.withColumn("calibrated", F.col("p")) if curve is None else risk.predict(curve, risk.with_logit(raw.withColumnRenamed("p", "raw"), "raw")).withColumnsRenamed({"p": "calibrated", "raw": "p"})
    return out.select("doc_id", "y", F.round("p", 6).alias("p"), F.round("calibrated", 6).alias("calibrated"))


# --- streaming twins in batch form, ingestion and scenarios -----------------------------------------------------------


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    from skerry.streaming.events import hourly

    return hourly(table(spark, d, "events"))


@query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    from skerry.streaming.events import sessions

    return sessions(table(spark, d, "events"))


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""WITH RECURSIVE e AS (SELECT event_type, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS arrived, 60 + event_id % 600 AS service, row_number() OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM events WHERE ts IS NOT NULL),
    q AS (SELECT event_type, event_id, n, arrived, arrived AS starts, arrived + service AS ends FROM e WHERE n = 1
        UNION ALL SELECT e.event_type, e.event_id, e.n, e.arrived, greatest(e.arrived, q.ends), greatest(e.arrived, q.ends) + e.service FROM q JOIN e ON e.event_type IS NOT DISTINCT FROM q.event_type AND e.n = q.n + 1)
    SELECT event_id, starts, ends, starts - arrived AS waits FROM q""")
def queue_waits(spark: SparkSession, d: str) -> DataFrame:
    """Every event as an arrival at the single server of its type."""
    from skerry.operators import scenario

    rows = table(spark, d, "events").select("event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"), (60 + F.col("event_id") % 600).alias("service"))
    return scenario.queue_waits(rows, "event_type", "at", "service", "event_id").select("event_id", "starts", "ends", "waits")
