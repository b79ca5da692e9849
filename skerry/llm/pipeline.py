"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one.

Toxic documents go; of equal and nearly equal lines one stays; of each group of near copies the row with the smallest id, null
last, and of these with the smallest text hash stays (of rows equal in id and text, one); documents that hold a benchmark window go; the rest is packed.
A document left without any text by line dedup stays as an empty one, so that each stage decides on its own ground only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import remove, temporary, write
from skerry.llm.copies import firsts, identified
from skerry.llm.decontaminate import contamination
from skerry.llm.lines import dedup_lines
from skerry.llm.packing import pack_documents
from skerry.llm.toxicity import THRESHOLD, score
from skerry.session import table

SIMILARITY = 0.8
NEAR_BITS = 4  # SimHash distance within which tests hold near copies against brute force; the search has no such bound
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores below the threshold stay. The score is a function of the text, so rows are filtered in place."""
    return score(docs, table(spark, sf_dir, "labels"), *COLUMNS).where(F.col("score") < THRESHOLD).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their duplicate lines, n_chars counted anew."""
    out = dedup_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those linked by shingles of five words with a Jaccard similarity of
    SIMILARITY or more. SimHash near-dedup finds most such pairs; those it misses are found by their shingles. The row that stays is named by id and
    text, so rows with a null id, or with one id and different texts, are documents of their own."""
    keep = firsts(docs, SIMILARITY).select("id", F.col("h").alias("_h"), F.col("g").alias("_g"))
    named = identified(docs.select(COLUMNS), "doc_id", "text")
    kept = named.join(keep, named.doc_id.eqNullSafe(keep.id) & (named.h == keep._h) & (named.g == keep._g), "left_semi")
    one = Window.partitionBy("doc_id", "h", "g").orderBy("text", "lang", "source", "n_chars")
    return kept.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs stay."""
    return contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS)).where("n_hit = 0").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence."""
    return pack_documents(docs, keep_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents. A stage's table and what its operators wrote go once the next stage's table is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            path = write(out, f"stage-{name}", keep=True)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)  # has read its documents: its pieces are a table of their own
    remove(spark, before)
    return packed
