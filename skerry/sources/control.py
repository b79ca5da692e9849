"""Control tables: keyed rows with validity intervals, merged by copy-on-write and published by compare-and-set.

A table is a set of key buckets. A merge reads and writes the buckets that its changes touch; the new revision's commit names the
new folders of those and the old ones of the rest, so unchanged data is never rewritten and every earlier revision stays readable. A key's
versions are its changes in time order, each valid until the next; a tombstone ends the last one. So time travel has two axes: the
revision that was current, and the time for which its rows were valid.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.sources.ingest import Rejected
from skerry.sources.publishing import DIGITS, created, newest, revisions, store

BUCKETS = 16
MARKS = ("valid_from", "valid_to", "tombstone")


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merged(history: DataFrame | None, changes: DataFrame, keys: list[str], at: str = "at", deleted: str = "deleted", place: str | None = None) -> DataFrame:
    """history with changes (keys, values, at, deleted): (keys, values, valid_from, valid_to, tombstone, repeats), a row for each change.

    A change at a key's existing time replaces what was there; of changes at one time the one with the largest place stays. A change
    may be older than versions that are there, and is put between them. A change to
    what a key has already repeats it: it is kept, as a late change may come before it, but is no version of its own."""
    values = [c for c in changes.columns if c not in (*keys, at, deleted, place)]
    new = changes.where(F.col(at).isNotNull()).select(*keys, F.struct(*values).alias("_v"), F.col(at).alias("valid_from"), F.coalesce(F.col(deleted), F.lit(False)).alias("tombstone"), F.struct(F.lit(1).alias("new"), (F.col(place) if place else F.lit(0)).cast("long").alias("place")).alias("_rank"))
    rows = new
    if history is not None:
        old = history.select(*keys, F.struct(*values).alias("_v"), "valid_from", "tombstone", F.struct(F.lit(0).alias("new"), F.lit(0).cast("long").alias("place")).alias("_rank"))
        rows = old.unionByName(new)
    once = rows.groupBy(*keys, "valid_from").agg(F.max_by(F.struct("_v", "tombstone"), "_rank").alias("_c")).select(*keys, "valid_from", "_c.*")
    by = Window.partitionBy(*keys).orderBy("valid_from")  # the versions of one key
    now = F.struct("tombstone", F.when(~F.col("tombstone"), F.col("_v")).alias("v"))
    marked = once.withColumn("repeats", F.coalesce(now.eqNullSafe(F.lag(now).over(by)), F.lit(False)))
    later = F.min(F.when(~F.col("repeats"), F.col("valid_from"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    return marked.select(*keys, "_v.*", "valid_from", later.alias("valid_to"), "tombstone", "repeats")


def upsert(changes: DataFrame, folder: str, keys: list[str], at: str = "at", deleted: str = "deleted", place: str | None = None, buckets: int = BUCKETS) -> dict:
    """Merges changes into the table and publishes the next revision, whose manifest it returns. If another writer was faster, the merge is made anew
    over what that one published."""
    spark = changes.sparkSession
    changes = changes.withColumn("bucket", bucket(keys, buckets))
    touched = sorted(r[0] for r in changes.select("bucket").distinct().collect())  # BUCKETS at most
    where, fs = store(spark, f"{folder}/_commits")
    fs.mkdirs(where)
    while True:
        number, last = newest(spark, folder)
        if last and (last["keys"] != keys or last["of"] != buckets):
            raise Rejected("the table has other keys or buckets")
        known = last["buckets"] if last else {}
        old = [known[str(b)] for b in touched if str(b) in known]
        history = spark.read.schema(last["schema"]).parquet(*old) if old else None
        path = f"{folder}/data-{uuid.uuid4().hex}"
        out = merged(history, changes.drop("bucket"), keys, at, deleted, place)
        out.withColumn("bucket", bucket(keys, buckets)).repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path)
        made = {str(b): f"{path}/bucket={b}" for b in touched if store(spark, path)[1].exists(store(spark, f"{path}/bucket={b}")[0])}
        schema = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)
        said = {"revision": number + 1, "previous": last["revision"] if last else None, "keys": keys, "of": buckets, "schema": schema, "buckets": {**known, **made}}
        if created(spark, f"{folder}/_commits/{number + 1:0{DIGITS}d}", json.dumps(said, sort_keys=True)):
            return said
        where, fs = store(spark, path)
        fs.delete(where, True)  # made over a revision that isn't the last any more


def history(spark: SparkSession, folder: str, revision: int | None = None) -> DataFrame:
    """All versions and tombstones of a revision, or of the newest."""
    found = newest(spark, folder)[1] if revision is None else next((json.loads(r["manifest"]) for r in revisions(spark, folder).where(F.col("revision") == revision).collect()), None)
    if found is None:
        raise Rejected(f"{folder} has no such revision")
    return spark.read.schema(found["schema"]).parquet(*found["buckets"].values()).where("NOT repeats").drop("repeats")


def as_of(spark: SparkSession, folder: str, when: Column | None = None, revision: int | None = None) -> DataFrame:
    """The rows valid at a time (by default the newest versions), as a revision knows them."""
    rows = history(spark, folder, revision)
    valid = F.col("valid_to").isNull() if when is None else (F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when))
    return rows.where(valid & ~F.col("tombstone")).drop(*MARKS)
