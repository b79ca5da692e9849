"""Benchmark decontamination: a prefix-filtered join of document shingles with item windows, verified word by word.

An item's windows are its runs of `window` consecutive words (a shorter item is one window). A window occurs in a document
only if each of its shingles does, so one necessary shingle a window is enough to find candidates: the rarest over the whole
corpus. Documents are joined on those prefix shingles alone. A candidate's position must leave room for the window on both
sides (the positional and length bounds), and then all words of the window are compared.

Benchmarks are small beside the corpus, so the prefix table is broadcast while its counted size is within PREFIX_ROWS;
beyond it the join shuffles shingles. Verification joins candidates back to texts by content; only texts with candidates are
compared.

Defined cases: null texts, empty texts and texts without a word have no words and no hits; items without a word have no
window; items with equal id and text count once, and one without an id counts without being named; equal documents get
equal results; empty tables give empty results; extra columns stay out. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import broadcast_if, tallied, temporary, written
from skerry.session import table

WINDOW = 10
SHINGLE = 3
PREFIX_ROWS = 500_000  # rows of about 60 bytes
RESULT_ROWS = 200_000  # broadcast rows and spans, of about 100 and 8 bytes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; an empty array where there are none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, GAP), lambda w: w != "")


def shingled(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, pos, key, parts): every run of `size` words of column w, with its place from 0, as a hash and as words. Joins go by
    the hash and compare the words of what they find, so no shingle is put together as text."""
    n = F.size("w") - (size - 1)
    parts = F.arrays_zip(*(F.slice("w", F.lit(i + 1), n).alias(f"w{i}") for i in range(size)))
    runs = rows.where(n > 0).select(*keys, F.posexplode(parts).alias("pos", "parts"))
    return runs.select(*keys, "pos", F.xxhash64(*(F.col(f"parts.w{i}") for i in range(size))).alias("key"), "parts")


def same_words(size: int) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"parts.w{i}") == F.col(f"p.w{i}") for i in range(size)))


def windows_of(items: DataFrame, window: int, size: int) -> DataFrame:
    """(w, size, n): the distinct windows of all items, and how long their shingles are."""
    w = items.select(words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    runs = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("w"))
    return runs.distinct().select("w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(size)).alias("size"))


def prefixes(windows: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(key, p, at, seen, w, n): each window with its rarest shingle over the whole corpus and that shingle's place."""
    parts = shingled(windows.where(F.col("size") == size), ["w", "n"], size).withColumnsRenamed({"pos": "at", "parts": "p"})
    parts, n = tallied(parts, f"window-shingles-{size}")
    names = parts.select("key", "p").distinct()
    met = shingled(texts, [], size).join(broadcast_if(names, n, PREFIX_ROWS), "key").where(same_words(size))
    rated = parts.join(met.groupBy("key", "p").count(), ["key", "p"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    best = rated.groupBy("w", "n").agg(F.min(F.struct("count", "at", "key", "p")).alias("x"))
    return best.select("x.key", "x.p", F.col("x.at").alias("at"), F.col("x.count").alias("seen"), "w", "n")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """(h, g, start, window): for every text (by content hashes h, g) candidates of windows and where they would begin."""
    texts = docs.select(words(F.col("text")).alias("w"), *keys_of("text"))
    windows = written(windows_of(items, window, size), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most `size` values
    found: DataFrame | None = None
    for k in sizes:
        prefix, n = tallied(prefixes(windows, texts, k).where("seen > 0"), f"prefixes-{k}")
        near = shingled(texts.withColumn("len", F.size("w")), ["h", "g", "len"], k)
        near = near.join(broadcast_if(prefix, n, PREFIX_ROWS), "key").where(same_words(k))
        near = near.where("pos >= at AND pos - at + n <= len").select("h", "g", (F.col("pos") - F.col("at")).alias("start"), F.col("w").alias("window"))
        found = near if found is None else found.union(near)
    if found is None:
        found = texts.where("false").select("h", "g", F.lit(0).alias("start"), F.col("w").alias("window"))
    return found.distinct()


def keys_of(text: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that stand for a text in shuffles."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(7), whole).alias("g")


def hit_runs(at: DataFrame) -> DataFrame:
    """(h, g, n_hit, spans) of occurrences (h, g, start, until): disjoint runs of hit words, in order, and their words."""
    order = Window.partitionBy("h", "g").orderBy("start", "until")
    before = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    at = at.select("h", "g", "start", "until", F.when(F.col("start") <= before, 0).otherwise(1).alias("new"))
    at = at.select("h", "g", "start", "until", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    runs = at.groupBy("h", "g", "run").agg(F.min("start").alias("start"), F.max("until").alias("until"))
    return runs.groupBy("h", "g").agg(F.sum(F.col("until") - F.col("start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "until"))).alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, n_words, n_hit, n_items, items_sha256, spans): one row for every row of docs.

    spans: (start, until) runs of hit words, disjoint and in order. items without an occurrence aren't counted. Only texts with a
    candidate are moved, once each; results join all rows by content and are broadcast while rows and spans are few.
    """
    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    rows = rows.select("*", *keys_of("text"))
    with temporary(docs.sparkSession):
        seen = Observation()
        results = written(verified(rows, items, window).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")), "verified", keep=True)
        size = seen.get["n"] + seen.get["spans"]
    out = rows.join(broadcast_if(results, size, RESULT_ROWS), ["h", "g"], "left")
    none = F.array().cast("array<struct<start:int,until:int>>")
    zero = F.lit(0).cast("long")
    return out.select(
        *keep,
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce("spans", none).alias("spans"),
    )


def verified(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(h, g, n_hit, spans, n_items, items_sha256) of every distinct text with a true occurrence."""
    found, n = tallied(occurrences(rows, items, window), "candidates")
    names = found.select("h", "g").distinct()
    texts = rows.select("h", "g", "text").join(broadcast_if(names, n, RESULT_ROWS), ["h", "g"], "left_semi").dropDuplicates(["h", "g"])
    at = texts.select("h", "g", words(F.col("text")).alias("w")).join(found, ["h", "g"])
    true = at.where(F.slice("w", F.col("start") + 1, F.size("window")) == F.col("window")).select("h", "g", "start", (F.col("start") + F.size("window")).alias("until"), "window")
    true = written(true, "occurrences")
    runs = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    runs = runs.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("window")).distinct()
    named = true.select("h", "g", "window").distinct().join(runs, "window").select("h", "g", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    return hit_runs(true.select("h", "g", "start", "until").distinct()).join(named, ["h", "g"], "left")


def op10_prefix_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
