"""Registers and provenance: joins over control tables, lifecycles, versions, digests and evidence.

Every table carries a tenant, and every join includes it.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Lifecycles as edges.
EDGES = {
    "revision": [("staged", "validating"), ("validating", "validated"), ("validated", "published"), ("validating", "failed")],
    "condition": [("normal", "pending"), ("recovered", "pending"), ("pending", "active"), ("pending", "recovered"), ("active", "recovered")],
    "metric": [("proposed", "approved"), ("approved", "superseded"), ("approved", "withdrawn")],
    "ingest_run": [("queued", "running"), ("running", "succeeded"), ("running", "failed")],
    "model": [("draft", "evaluated"), ("draft", "retired"), ("evaluated", "approved"), ("evaluated", "retired"), ("approved", "active"), ("approved", "retired"), ("active", "degraded"), ("active", "suspended"), ("active", "retired"), ("degraded", "active"), ("degraded", "suspended"), ("degraded", "retired"), ("suspended", "active"), ("suspended", "retired")],
    "pilot": [("draft", "configuration"), ("draft", "abandoned"), ("configuration", "ready_for_evaluation"), ("configuration", "abandoned"), ("ready_for_evaluation", "active"), ("ready_for_evaluation", "configuration"), ("ready_for_evaluation", "abandoned"), ("active", "review"), ("active", "abandoned"), ("review", "completed"), ("review", "active"), ("review", "abandoned")],
    "investigation": [("open", "in_progress"), ("open", "resolved"), ("open", "closed"), ("in_progress", "resolved"), ("in_progress", "closed"), ("in_progress", "open"), ("resolved", "closed"), ("resolved", "in_progress"), ("resolved", "open"), ("closed", "open")],
    "decision": [
        ("draft", "proposed"), ("draft", "abandoned"), ("draft", "deferred"), ("proposed", "accepted"), ("proposed", "rejected"), ("proposed", "deferred"), ("proposed", "abandoned"), ("proposed", "draft"),
        ("accepted", "implementation_pending"), ("accepted", "active"), ("accepted", "superseded"), ("accepted", "abandoned"), ("accepted", "deferred"),
        ("implementation_pending", "active"), ("implementation_pending", "superseded"), ("implementation_pending", "abandoned"), ("active", "review_due"), ("active", "evaluated"), ("active", "superseded"), ("active", "abandoned"),
        ("review_due", "evaluated"), ("review_due", "active"), ("review_due", "superseded"), ("review_due", "abandoned"), ("evaluated", "closed"), ("evaluated", "superseded"), ("evaluated", "abandoned"),
        ("closed", "superseded"), ("rejected", "draft"), ("rejected", "proposed"), ("deferred", "draft"), ("deferred", "proposed"), ("abandoned", "draft"),
    ],
}
# Decision states from which on evidence can't be bound any more.
FROZEN = ("accepted", "implementation_pending", "active", "review_due", "evaluated", "closed", "superseded")
INLINE_ROWS = 100


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, a, b) for m, pairs in EDGES.items() for a, b in pairs], "machine string, from_state string, to_state string")


def illegal_moves(moves: DataFrame) -> DataFrame:
    """Moves (machine, from_state, to_state, ...) that no edge allows."""
    return moves.join(F.broadcast(edges(moves.sparkSession)), ["machine", "from_state", "to_state"], "left_anti")


def histories(moves: DataFrame) -> DataFrame:
    """(machine, id, states, legal) of ordered moves (machine, id, at, from_state, to_state): a history is legal if every move is an
    edge and begins where the last one ended."""
    order = Window.partitionBy("machine", "id").orderBy("at")
    known = edges(moves.sparkSession).withColumn("edge", F.lit(True))
    steps = moves.withColumn("before", F.lag("to_state").over(order)).join(F.broadcast(known), ["machine", "from_state", "to_state"], "left")
    good = F.coalesce("edge", F.lit(False)) & (F.col("before").isNull() | (F.col("before") == F.col("from_state")))
    return steps.groupBy("machine", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "to_state"))), lambda x: x.to_state).alias("states"), F.every(good).alias("legal"))


def bindable(decisions: DataFrame) -> DataFrame:
    """Decisions whose evidence may still change."""
    return decisions.where(~F.col("status").isin(list(FROZEN)))


def amended(register: DataFrame, amendments: DataFrame) -> DataFrame:
    """An append-only register with each decision's amendments in order beside it; entries themselves never change."""
    notes = amendments.groupBy("tenant_id", "decision_id").agg(F.array_sort(F.collect_list(F.struct("at", "note"))).alias("amendments"))
    return register.join(notes, ["tenant_id", "decision_id"], "left")


def datasets_with_revisions(datasets: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each dataset (tenant_id, dataset_id, published) with its latest and its published revision, without a lookup per row."""
    key = ["tenant_id", "dataset_id"]
    newest = revisions.groupBy(*key).agg(F.max("revision").alias("latest_revision"), F.max_by("row_count", "revision").alias("latest_rows"))
    live = revisions.select(*key, F.col("revision").alias("published"), F.col("row_count").alias("published_rows"))
    return datasets.join(newest, key, "left").join(live, [*key, "published"], "left")


def scoped(df: DataFrame, tenant, column: str = "tenant_id") -> DataFrame:
    return df.where(F.col(column) == tenant)


def evidence_of(bindings: DataFrame, artifacts: DataFrame) -> DataFrame:
    return bindings.join(artifacts, ["tenant_id", "artifact_id"])


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of every key."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def definition_status(versions: DataFrame, publications: DataFrame) -> DataFrame:
    """Each version (tenant_id, definition_id, version) with its state: approved while its publication is open, superseded
    once a later version is published, withdrawn if its own ended without one, else proposed."""
    key = ["tenant_id", "definition_id"]
    newest = publications.groupBy(*key).agg(F.max("version").alias("newest"))
    out = versions.join(publications.select(*key, "version", "effective_from", "effective_to"), [*key, "version"], "left").join(newest, key, "left")
    published = F.col("effective_from").isNotNull()
    state = F.when(published & F.col("effective_to").isNull(), "approved").when(published & (F.col("version") < F.col("newest")), "superseded").when(published, "withdrawn").otherwise("proposed")
    return out.withColumn("status", state)


def current(publications: DataFrame) -> DataFrame:
    return publications.where(F.col("effective_to").isNull())


def with_current(definitions: DataFrame, publications: DataFrame, key: str) -> DataFrame:
    """Each definition with its publication in force, if it has one."""
    return definitions.join(current(publications), key, "left")


def predictions(made: DataFrame, targets: DataFrame, models: DataFrame) -> DataFrame:
    """Each prediction (target_id, model_id, ...) with its target and its model, where they are known. Sizes decide how the sides are joined."""
    return made.join(targets, "target_id", "left").join(models, "model_id", "left")


# States of decisions that are open, and that are done with.
OPEN, DONE = ("draft", "proposed", "accepted", "active"), ("evaluated", "closed")


def pilot_summary(alerts: DataFrame, scored: DataFrame, investigations: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row of counts over one tenant's tables: each table is read once, whatever the number of counts over it."""
    state = F.col("status")
    of_alerts = alerts.agg(F.count_if(F.col("resolved_at").isNull()).alias("open_alerts"))
    of_scores = scored.agg(F.count_if(F.col("risk_tier") == "HIGH").alias("high_risk_cases"))
    of_inquiries = investigations.agg(F.count_if(state != "closed").alias("active_investigations"))
    of_decisions = decisions.agg(F.count_if(state.isin(*OPEN)).alias("open_decisions"), F.count_if(state == "review_due").alias("reviews_due"), F.count_if(state.isin(*DONE)).alias("completed_reviews"))
    rest = [of_scores.scalar().alias("high_risk_cases"), of_inquiries.scalar().alias("active_investigations"), of_decisions.select(F.struct("*")).scalar().alias("_decisions")]
    return of_alerts.select("open_alerts", *rest).select("open_alerts", "high_risk_cases", "active_investigations", "_decisions.*")


def usage(rows: DataFrame, provider: str, model: str, day: str, tokens: str, cost: str) -> DataFrame:
    """Totals, by provider, by model, by day, and by all three, from one scan with grouping sets. Costs stay null where none
    is known; token sums of nothing are zero."""
    rows.createOrReplaceTempView("usage_rows")
    return rows.sparkSession.sql(f"""
        SELECT {provider} AS provider, {model} AS model, {day} AS day, CAST(grouping_id() AS BIGINT) AS level, count(*) AS calls,
               coalesce(sum({tokens}), 0) AS tokens, round(sum({cost}), 4) AS cost
        FROM usage_rows GROUP BY GROUPING SETS ((), ({provider}), ({model}), ({day}), ({provider}, {model}, {day}))""")


def conditions_with_rules(states: DataFrame, rules: DataFrame) -> DataFrame:
    """Every condition state with the name of its rule, null where the rule is gone."""
    return states.join(rules.select("tenant_id", "rule_id", F.col("name").alias("rule_name")), ["tenant_id", "rule_id"], "left")


def usage_by_provider(rows: DataFrame, providers: DataFrame) -> DataFrame:
    """Totals of usage rows (tenant_id, provider_id, tokens, cost) by provider, with the provider's name. Rows are added up before
    names are looked up, so the join meets one row for each provider."""
    totals = rows.groupBy("tenant_id", "provider_id").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sum("cost").alias("cost"))
    return totals.join(providers.select("tenant_id", "provider_id", F.col("name").alias("provider_name")), ["tenant_id", "provider_id"], "left")


def roles_with_providers(roles: DataFrame, providers: DataFrame, known_only: bool = False) -> DataFrame:
    """Model roles with their provider's name and status; known_only leaves out roles whose provider is gone."""
    names = providers.select("tenant_id", "provider_id", F.col("name").alias("provider_name"), F.col("status").alias("provider_status"))
    return roles.join(names, ["tenant_id", "provider_id"], "inner" if known_only else "left")


def new_investigations(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Of requests (tenant_id, source_type, source_id, request_id) the first for every source that has no investigation yet."""
    source = ["tenant_id", "source_type", "source_id"]
    return requests.groupBy(*source).agg(F.min("request_id").alias("request_id")).join(held.select(*source), source, "left_anti")


def page_with_total(df: DataFrame, order: list[str], offset: int, limit: int) -> tuple[DataFrame, int]:
    """A page and the number of rows of all pages."""
    return page(df, order, offset, limit), df.count()


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("a page has 1 to 500 rows")
    return df.orderBy(*order).offset(offset).limit(limit)


def outcome_comparison(evidence: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected values (decision_id, metrics map) beside observed (decision_id, metric, value)."""
    expected = evidence.select("decision_id", F.explode("metrics").alias("metric", "expected"))
    return expected.join(observed, ["decision_id", "metric"], "left").withColumn("difference", F.col("value") - F.col("expected"))


def digest(rows: list) -> str:
    """SHA-256 of rows as canonical JSON: sorted keys, no spaces."""
    plain = [r.asDict(recursive=True) if hasattr(r, "asDict") else r for r in rows]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":"), default=str, ensure_ascii=False).encode()).hexdigest()


def row_digests(df: DataFrame) -> DataFrame:
    """df with a digest per row, computed where the rows are."""
    return df.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))


def table_digest(df: DataFrame) -> tuple[str, int]:
    """SHA-256 of df's rows as a multiset, and their number. Rows are hashed where they are and equal ones counted; digests are then hashed in
    order by their first four hex digits, these by the first two, and these together, so no task or driver holds more than such a part."""
    parts = df.select(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))), 256).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("k", F.concat_ws(":", "k", "n").alias("v"), "n")
    for digits in (4, 2, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), ",")
        parts = parts.groupBy(F.substring("k", 1, digits).alias("k")).agg(F.sha2(joined, 256).alias("v"), F.sum("n").alias("n"))
    whole = parts.first()  # one row, or none
    return (whole["v"], whole["n"]) if whole else (hashlib.sha256(b"").hexdigest(), 0)


def capture_evidence(df: DataFrame, path: str) -> dict:
    """Evidence of any size: up to INLINE_ROWS rows inside the manifest, more as Parquet beside it, under one digest."""
    rows = df.limit(INLINE_ROWS + 1).collect()
    out = {"columns": df.columns, "schema": df.schema.json()}
    if len(rows) <= INLINE_ROWS:
        return out | {"sha256": digest(rows), "row_count": len(rows), "rows": [r.asDict(recursive=True) for r in rows]}
    df.write.mode("errorifexists").parquet(path)
    sha, n = table_digest(df.sparkSession.read.schema(df.schema).parquet(path))
    return out | {"sha256": sha, "row_count": n, "path": path}


def evidence_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """The rows as a table, if their digest still is the one recorded. Those in Parquet have no certain order."""
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    if "rows" in manifest:
        return spark.createDataFrame(read_evidence(spark, manifest), schema)
    rows = spark.read.schema(schema).parquet(manifest["path"])
    if table_digest(rows)[0] != manifest["sha256"]:
        raise ValueError("evidence doesn't match its digest")
    return rows


def read_evidence(spark: SparkSession, manifest: dict) -> list[dict]:
    """The rows on the driver, for evidence known to be small (the manifest has their number), if their digest still is the one recorded."""
    if "rows" not in manifest:
        return [r.asDict(recursive=True) for r in evidence_table(spark, manifest).collect()]
    if digest(manifest["rows"]) != manifest["sha256"]:
        raise ValueError("evidence doesn't match its digest")
    return manifest["rows"]
