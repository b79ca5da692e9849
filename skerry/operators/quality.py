"""Profiles, quality rules, grain proofs, relationships and data health. Everything is counted over all rows, in one pass
where the counts share one grouping."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations, islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.nulls import is_blank
from skerry.functions.times import literal

MAX_KEYS = 25
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
TYPE_NAMES = {"string": "string", "boolean": "boolean", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "float": "float", "double": "float"}
ISO = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"


def type_name(kind: str) -> str:
    return TYPE_NAMES.get(kind, kind)


def profile(df: DataFrame) -> DataFrame:
    """(name, inferred_type, row_count, null_count, null_rate, distinct_count, min_value, max_value), a row per column.

    Blanks count as missing. Bounds are given for numbers, dates, and text that is ISO dates throughout.
    """
    kinds, found = dict(df.dtypes), []
    for c in df.columns:
        # values are counted first, by a hash aggregate over this column alone: rows aren't copied for each column, nor sorted
        values = df.select(F.when(~is_blank(df, c), F.col(c)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        lo, hi = F.min("v").cast("string"), F.max("v").cast("string")
        if kinds[c] == "string":
            dates = F.count("v") == F.count_if(F.col("v").rlike(ISO))
            lo, hi = F.when(dates, lo), F.when(dates, hi)
        elif kinds[c] not in (*NUMBERS, "date", "timestamp", "timestamp_ntz"):
            lo = hi = F.lit(None).cast("string")
        rows, full = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
        one = values.agg(rows.alias("row_count"), (rows - full).alias("null_count"), F.round((rows - full) / F.greatest(rows, F.lit(1)), 4).alias("null_rate"), F.count("v").alias("distinct_count"), lo.alias("min_value"), hi.alias("max_value"))
        found.append(one.select(F.lit(c).alias("name"), F.lit(type_name(kinds[c])).alias("inferred_type"), "*"))
    return reduce(DataFrame.unionByName, found)


@dataclass(frozen=True)
class Rule:
    kind: str  # not_null, unique, range, regex
    column: str
    low: float | None = None
    high: float | None = None
    pattern: str | None = None

    def problem(self, df: DataFrame) -> str | None:
        if self.column not in df.columns:
            return "no such column"
        if self.kind == "range" and (self.low is None and self.high is None or None not in (self.low, self.high) and self.low > self.high):
            return "range needs bounds in order"
        if self.kind == "regex":
            try:
                re.compile(self.pattern or "")
            except re.error as e:
                return f"bad pattern: {e}"
        return None if self.kind in ("not_null", "unique", "range", "regex") else "no such rule"


def rule_counts(df: DataFrame, r: Rule) -> tuple[Column, Column]:
    """(checked, violations)."""
    c, blank = F.col(r.column), is_blank(df, r.column)
    full = F.when(~blank, c)
    if r.kind == "not_null":
        return F.count(F.lit(1)), F.count_if(blank)
    if r.kind == "unique":
        return F.count(full), F.count(full) - F.count_distinct(full)
    if r.kind == "range":
        value = full.try_cast("double")
        outside = reduce(lambda a, b: a | b, [value.isNull(), *([value < r.low] if r.low is not None else []), *([value > r.high] if r.high is not None else [])])
        return F.count(full), F.count_if(~blank & outside)
    return F.count(full), F.count_if(~blank & ~full.cast("string").rlike(rf"^(?:{r.pattern})\z"))


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(kind, column, checked, violations, status), a row per rule, from one aggregation over df."""
    made, rows = [], []
    for i, r in enumerate(rules):
        if problem := r.problem(df):
            checked, broken, status = F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(f"error: {problem}")
        else:
            a, b = rule_counts(df, r)
            made += [a.alias(f"c{i}"), b.alias(f"v{i}")]
            checked, broken = F.col(f"c{i}"), F.col(f"v{i}")
            status = F.when(broken == 0, "passed").otherwise("failed")
        rows.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.column).alias("column"), checked.alias("checked"), broken.alias("violations"), status.alias("status")))
    return df.agg(*(made or [F.count(F.lit(1))])).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def key_candidates(columns: list[str]) -> list[tuple[str, ...]]:
    """The first MAX_KEYS of: each column named like an identifier (each column, if none is), then each pair of columns."""
    named = [c for c in columns if re.search("(_id|^id|^code)$", c.lower())]
    return list(islice(chain(zip(named or columns), combinations(columns, 2)), MAX_KEYS))


def grain(df: DataFrame, keys: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(key_columns, null_components, duplicate_groups, worst, unique_over_full_data) for every candidate key, over all rows.

    Each candidate is one hash aggregate; a hot key is combined before it is shuffled.
    """
    found = []
    for key in keys or key_candidates(df.columns):
        blanks = reduce(lambda a, b: a + b, (is_blank(df, c).cast("long") for c in key))
        groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(blanks).alias("blanks"))
        found.append(groups.agg(F.coalesce(F.sum("blanks"), F.lit(0)).alias("null_components"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("worst")).select(F.lit(",".join(key)).alias("key_columns"), "*"))
    out = reduce(DataFrame.unionByName, found)
    return out.withColumn("unique_over_full_data", (F.col("null_components") == 0) & (F.col("worst") <= 1))


def duplicate_examples(df: DataFrame, key: tuple[str, ...], top: int = 3) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1").orderBy(F.desc("occurrences"), *key).limit(top)


def chosen_grain(evidence: DataFrame) -> tuple[str, ...] | None:
    """The unique key with the fewest columns, then first by name; a run without one fails. evidence has MAX_KEYS rows at most."""
    fit = sorted((tuple(r["key_columns"].split(",")) for r in evidence.where("unique_over_full_data").collect()), key=lambda k: (len(k), k))
    return fit[0] if fit else None


def relationship(left: DataFrame, right: DataFrame, on_left: str, on_right: str) -> DataFrame:
    """One row: whether left's key is unique, right's largest fan-out, the share of right's keys unknown to left, and the
    cardinality these imply."""
    a = left.select(F.col(on_left).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n_left"))
    b = right.select(F.col(on_right).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, "k", "full").agg(F.count("n_left").alias("left_keys"), F.count("n_right").alias("right_keys"), F.max("n_left").alias("left_fanout"), F.coalesce(F.max("n_right"), F.lit(0)).alias("right_max_fanout"), F.count_if(F.col("n_left").isNull()).alias("unmatched"))
    kind = F.when(F.col("right_max_fanout") > 1, "one-to-many").when(F.col("left_keys") == F.col("right_keys"), "one-to-one").otherwise("many-to-one")
    return both.select((F.coalesce("left_fanout", F.lit(0)) <= 1).alias("left_unique"), "right_max_fanout", F.round(F.col("unmatched") / F.greatest(F.lit(1), F.col("right_keys")), 4).alias("unmatched_right_rate"), kind.alias("cardinality"))


def health(revisions: DataFrame, now) -> DataFrame:
    """(dataset, revision, freshness_hours, status) of each dataset's latest revision: over 72 hours stale, over 168 suspended."""
    latest = revisions.groupBy("dataset").agg(F.count(F.lit(1)).alias("revision_count"), F.max_by(F.struct("revision", "created_at"), "revision").alias("x"))
    hours = F.timestamp_diff("SECOND", F.col("x.created_at"), literal(now)) / 3600.0
    status = F.when(hours.isNull(), "unknown").when(hours > 168, "suspended").when(hours > 72, "stale").otherwise("fresh")
    return latest.select("dataset", "revision_count", F.col("x.revision").alias("latest_revision"), F.round(hours, 2).alias("freshness_hours"), status.alias("status"))


def latest_result(rules: DataFrame, results: DataFrame, rule: str, at: list[str]) -> DataFrame:
    """Every rule with its latest result, or nulls."""
    order = Window.partitionBy(rule).orderBy(*(F.desc(c) for c in at))
    latest = results.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return rules.join(latest, rule, "left")
