"""Best-fit packing: sequences filled by minimum bin slack.

Documents become token ids; only those longer than a sequence are cut, into full pieces after a first one that may be shorter.
For every sequence, a bitset dynamic programme over the lengths still available finds the fullest combination that holds the
longest of them; that combination is removed and the next sequence is filled. The state is a histogram of lengths, of at most
`capacity` rows whatever the input, and a combination is taken as often as its lengths last before it is searched anew, which
changes nothing but time: until one of its lengths is about to run out, the same search gives the same answer.

Pieces of one length are interchangeable, so pieces meet their places by their rank within their length. Ranks come from
groups salted by task and run, since a third of all pieces may have one length.

Defined cases: a null text is empty, and an empty document has one token, the end mark; equal rows are packed as rows of their
own; an empty table gives an empty table; extra columns are left out; texts of any length are read whole.

Ids are those of byte_bpe_50k.json in the library tokenizers, in which the string `<|endoftext|>` is one id wherever a text has it.
They are computed with tiktoken from byte_bpe_50k.tiktoken, the same vocabulary, at four times the speed; tests hold the two
against each other.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import broadcast_if, written
from skerry.session import table

CAPACITY = 1024
END_ID = 2
ADDED = {"<|endoftext|>": 50256}  # of the vocabulary's json, as its README has it
SALT_ROWS = 50_000  # pieces of one length and salt, about, that one task ranks
BROADCAST_ROWS = 200_000  # rows of the placement tables, of about 50 bytes; that of combinations follows capacity, not the input


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=table, special_tokens=ADDED)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, salt[, ids]) for every piece of every document; ids are little-endian unsigned
    32-bit. salt names the task and parts its pieces into runs of SALT_ROWS, so groups don't grow with the input."""
    ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made, task = encoder(ranks, pattern), 0, TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for r, text in enumerate(batch.column(1).to_pylist()):
                    ids = known.encode(text, allowed_special="all") if text else []
                    ids.append(END_ID)
                    data = np.array(ids, dtype="<u4").tobytes()
                    for k, (s, n) in enumerate(piece_bounds(len(ids), capacity)):
                        part = data[4 * s : 4 * (s + n)]
                        row.append(r)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(part)
                ids_of_rows = batch.column(0).take(pa.array(row, pa.int32()))
                columns = [ids_of_rows, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(task * 2**20 + np.arange(made, made + len(row)) // SALT_ROWS, pa.int64())]
                made += len(row)
                names = [id_col, "piece", "start", "length", "ids_crc32", "salt"]
                if keep_ids:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, salt long" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(pieces, schema)


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths, longest first, of the fullest combination that holds the longest available length.

    Bit s of a reach is set if some of the lengths seen so far sum to s. Multiples of a length are added by doubling, each
    step is kept, and the best sum is traced back through them. Longer lengths come first, so few pieces fill a sequence.
    """
    longest = max(counts)
    room = capacity - longest
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            grown = reach | (reach << (length * take)) & mask
            if grown != reach:
                steps.append((reach, length, take))
                reach = grown
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, [longest]
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            found += [length] * take
    return sorted(found, reverse=True)


def fill(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(combination, how many sequences take it) until the histogram is empty."""
    left, out = {x: n for x, n in histogram.items() if n}, []
    while left:
        found = fullest(left, capacity)
        uses = {x: found.count(x) for x in found}
        times = min(left[x] // n for x, n in uses.items())
        out.append((found, times))
        for x, n in uses.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def places(combinations: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first_rank, until_rank, first_sequence, each, offset): pieces of that length and rank r in the range go to
    sequence first_sequence + (r - first_rank) // each, as the (r - first_rank) % each-th of their length from offset on."""
    out, ranks, sequence = [], {}, 0
    for found, times in combinations:
        offset = 0
        for length in dict.fromkeys(found):
            each, low = found.count(length), ranks.get(length, 0)
            out.append((length, low, low + each * times, sequence, each, offset))
            ranks[length] = low + each * times
            offset += each * length
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces must give the same rows whenever they are read: a written table."""
    spark = pieces.sparkSession
    counts = written(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    at = places(fill(histogram, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # one row a length and salt
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = counts.count()
    target = spark.createDataFrame(at, "length long, low long, high long, first_sequence long, each long, base long")
    own = Window.partitionBy("length", "salt").orderBy(*(c for c in pieces.columns if c not in ("length", "salt", "ids")))
    ranked = pieces.withColumn("_rank", F.row_number().over(own) - 1).join(broadcast_if(starts, rows, BROADCAST_ROWS), ["length", "salt"])
    rank = F.col("before") + F.col("_rank")
    ranked = ranked.withColumn("_rank", rank).drop("before")
    spot = F.col("_rank") - F.col("low")
    packed = ranked.join(broadcast_if(target, len(at), BROADCAST_ROWS), "length").where("_rank >= low AND _rank < high")
    return packed.select(*pieces.columns, (F.col("first_sequence") + F.floor(spot / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + spot % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place; ids included unless keep_ids is false."""
    return pack(written(tokenize(docs, capacity, keep_ids=keep_ids), "pieces"), capacity)


def op7_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed. Texts are read once; what is shuffled is one short row a piece."""
    packed = pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
