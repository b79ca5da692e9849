"""Event streams: windows with watermarks, sessions, alert states and an append-only outbox.

hourly() and sessions() serve batch and streaming alike; a stream only adds its watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 day"


def stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1, late: str = LATE, at: str = "ts") -> DataFrame:
    """New Parquet files of a folder as a stream; rows later than the watermark are dropped by the window operators."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def hourly(events: DataFrame) -> DataFrame:
    counted = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    counted = events.groupBy(F.window("ts", length, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    counted = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def alert_states(evaluations: DataFrame) -> DataFrame:
    """(rule_id, condition, fired) after each micro-batch of evaluations (rule_id, event): firing moves normal and recovered to
    pending and pending to active, resolving moves to recovered."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        condition, fired = state.get if state.exists else ("normal", 0)
        for pdf in batches:
            for event in pdf.sort_values("at")["event"]:
                if event == "resolve":
                    condition = "recovered"
                else:
                    fired += 1
                    condition = "pending" if condition in ("normal", "recovered") else "active"
        state.update((condition, fired))
        yield pd.DataFrame({"rule_id": [key[0]], "condition": [condition], "fired": [fired]})

    return evaluations.select("rule_id", "event", "at").groupBy("rule_id").applyInPandasWithState(advance, "rule_id string, condition string, fired long", "condition string, fired long", "update", GroupStateTimeout.NoTimeout)


def incremental(source: DataFrame, folder: str, checkpoint: str):
    """Appends a stream to a folder in available-now micro-batches; a batch id is written once, whatever is retried."""
    return source.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def drain(source: DataFrame, name: str, mode: str = "complete"):
    """A stream's result as an in-memory table, for tests and small dashboards."""
    q = source.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return source.sparkSession.table(name)
