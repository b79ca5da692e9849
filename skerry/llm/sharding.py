"""Sharding: a uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each input partition sends to each output block is drawn first, exactly as a uniform permutation of all rows
would give it. Every partition then deals its own rows in random order, the blocks are exchanged, and each block is permuted
again. Shards are cut into blocks of bounded size, so no task holds a whole shard, and slots follow from the block sizes.

The matrix is never built in one place: a partition walks down a binary tree over the partitions and draws, at each node, how
many rows of every block fall to the left half. Nodes have seeds of their own, so every task (and every retry) draws the same.

Defined cases: null texts count as empty; null or repeated ids and equal rows are dealt like any others (a row's place never
depends on its values); an empty table gives an empty table; extra columns stay out of the result. `Groups` of equal texts
have no bearing on this law: copies are spread like any other rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import free, written
from skerry.session import table

EXACT_BELOW = 1_000_000_000  # numpy's generator takes no larger totals


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws rows are good. Beyond numpy's range: inversion, searched outwards from the mode."""
    if good + bad < EXACT_BELOW:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - at
    up, down, p_up, p_down = mode, mode, at, at
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if (u := u - p_up) <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if (u := u - p_down) <= 0:
                return down
    return mode


def split_left(rng: np.random.Generator, blocks: np.ndarray, left: int) -> np.ndarray:
    """How many rows of every block fall to the left half, which has `left` rows."""
    out, rest = np.zeros_like(blocks), int(blocks.sum())
    for j, size in enumerate(map(int, blocks)):
        if not left:
            break
        rest -= size
        out[j] = hypergeometric(rng, size, rest, left) if size else 0
        left -= int(out[j])
    return out


def matrix_row(counts: list[int], blocks: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """Row `partition` of the communication matrix; rows sum to counts, columns to blocks."""
    low, high, node, now = 0, len(counts), 1, blocks.astype(np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])
    while high - low > 1:
        mid = (low + high) // 2
        left = split_left(np.random.default_rng([seed, node]), now, int(before[mid] - before[low]))
        if partition < mid:
            high, node, now = mid, 2 * node, left
        else:
            low, node, now = mid, 2 * node + 1, now - left
    return now


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (j < total % parts) for j in range(parts)]


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 42, rows_per_block: int = 200_000, bytes_per_block: int = 64 * 2**20, scan: bool = False) -> DataFrame:
    """docs' rows with shard (int) and slot (long, gapless from 0 in each shard); shard sizes differ by one at most.

    A block has rows_per_block rows and bytes_per_block bytes at most, on average over all rows; one task sorts one block.

    scan: docs is a plain file scan, whose partitions are the same in every job. Any other input is written first, so that
    counting and dealing see the same partitions; a partition that still differs stops the job.
    """
    spark = docs.sparkSession
    docs = docs if scan else written(docs, "to-shard")
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in docs.schema if f.dataType.simpleString() in ("string", "binary")]
    weight = reduce(Column.__add__, texts, F.lit(16).cast("long"))
    parts = docs.select(F.spark_partition_id().alias("p"), weight.alias("w")).groupBy("p").agg(F.count(F.lit(1)), F.sum("w")).collect()  # a row a partition
    found = {r[0]: r[1] for r in parts}
    counts = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
    total, weights = sum(counts), sum(r[2] for r in parts)
    cuts = max(1, -(-total // (shards * rows_per_block)), -(-weights // (shards * bytes_per_block)))
    blocks = np.array([b for s in even(total, shards) for b in even(s, cuts)], dtype=np.int64)
    known = spark.sparkContext.broadcast((counts, blocks))
    names = docs.columns
    block, mixed, shard_name, slot = (free(c, names) for c in ("_block", "_order", "shard", "slot"))  # the input's columns keep theirs

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = TaskContext.get().partitionId(), 0
        counts, blocks = known.value
        n = counts[p] if p < len(counts) else 0
        row = matrix_row(counts, blocks, p, seed) if n else np.zeros(len(blocks), dtype=np.int64)
        rng = np.random.default_rng([seed, p, 1])
        to = rng.permutation(np.repeat(np.arange(len(blocks), dtype=np.int32), row))
        for batch in batches:
            mine = to[at : at + batch.num_rows]
            if len(mine) < batch.num_rows:
                raise RuntimeError(f"partition {p} has more than the {n} rows counted")
            at += batch.num_rows
            order = rng.integers(-(2**63), 2**63, batch.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine), pa.array(order)], [*names, block, mixed])
        if at != n:
            raise RuntimeError(f"partition {p} has {at} rows, {n} were counted")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    dealt = docs.mapInArrow(deal, f"{kinds}, `{block}` int, `{mixed}` long")
    shard, k = F.floor(F.col(block) / cuts).cast("int"), F.col(block) % cuts
    size = F.lit(total // shards) + F.when(shard < total % shards, 1).otherwise(0)
    base = F.floor(size / cuts)
    offset = k * base + F.least(k.cast("long"), size - base * cuts)
    rank = F.row_number().over(Window.partitionBy(block).orderBy(mixed)) - 1
    return dealt.select(*names, shard.alias(shard_name), (offset + rank).cast("long").alias(slot))


def op6_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents, texts included, exchanged once into 24 shards; the digest columns come from the exchanged rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shuffle_into_shards(docs, shards, scan=True)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
