"""Spelling variants: words one inserted, deleted or replaced code point apart, found by rolling hashes of deletions.

A word has a polynomial hash, sum of code point k times BASE^k modulo 2^64. From the hashes of its prefixes and suffixes the hash of
the word without one code point follows by one multiplication, so numpy makes all deletion keys of a batch of words at once, as
integers. Two words that differ by a replacement share the key of deleting that place; one that lacks a code point of the
other has, as its own key, a deletion key of the other. Keys are mixed, dealt out by their upper bits, and sorted as integers;
those met once are dropped there. For the rest the words are fetched and the deletions written out, and only equal
strings count as shared, so a collision of hashes never links two words.

Words that share a deletion are never paired with each other. A group of equal deletions at one place is a clique of replacements, and a word
that equals deletions of longer ones is near each of those: counts and best members come from windows over the group. A group has
one member for each place and letter at most, whatever the corpus. The forms that words follow at least double in count, so
chains are at most 63 long and are followed by doubling.

Defined cases: a null text has no words, a null id counts as an empty string; rows equal in everything count each; an empty table
gives an empty table; only the id and the text are read, so extra columns and their names don't matter; words of any length are
taken whole; of words equal in count the smallest in code-point order is the form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import broadcast_if, tallied, temporary, written
from skerry.session import table

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, OFTEN, TIMES = 5, 3, 2  # code points, occurrences, and how much more frequent a form has to be
DAMAGED = 97  # one in so many occurrences loses a code point, as the contract has it
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
LETTERS_A_TURN = 1 << 20  # of a batch of words; a longer word has a turn of its own
KEYS_A_TASK = 1_000_000
EDGES = 500_000  # broadcast rows of two ids and a word


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """(word, n): letter runs in lower case, one code point lost where the checksum of id and run says so, counted over all texts."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("sum"))
    word = F.when(F.col("sum") % DAMAGED == 0, without("run", F.col("sum") % F.char_length("run"))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def without(word: str, at: Column) -> Column:
    """The word without the code point at `at`, from 0."""
    at = at.cast("int")
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that makes all their bits depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, at, first) rows: for each word and place the key of the word without it; at -1 the word's own. word: its
    place in the list. first: the code point isn't the same as the one before, so no earlier place gives the same deletion."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(letters)) - starts[of]
    power = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
    power[1:] = np.uint64(BASE)
    power = np.cumprod(power)
    term = (letters + np.uint64(1)) * power[at]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])  # wraps, as all sums here
    before = sums[:-1] - sums[starts][of]
    total = sums[starts + sizes] - sums[starts]
    deleted = before + (total[of] - before - term) * np.uint64(INVERSE)
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (at[1:] == 0)
    key = np.concatenate([mixed(deleted + sizes[of].astype(np.uint64) - np.uint64(1)), mixed(total + sizes.astype(np.uint64))])
    own = np.arange(len(words))
    return key.view(np.int64), np.concatenate([of, own]), np.concatenate([at, np.full(len(words), -1)]).astype(np.int32), np.concatenate([first, np.ones(len(words), bool)])


def keyed(vocabulary: DataFrame) -> DataFrame:
    """(key, id, at, first) of the words (id, word)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column("id").to_numpy(), batch.column("word").to_pylist()
            turn = np.cumsum([len(w) for w in words]) // LETTERS_A_TURN if words else np.zeros(0, int)
            for t in np.unique(turn):
                rows = np.flatnonzero(turn == t)
                key, of, at, first = deletion_keys([words[i] for i in rows])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[rows][of]), pa.array(at), pa.array(first)], ["key", "id", "at", "first"])

    return vocabulary.select("id", "word").mapInArrow(make, "key long, id long, at int, first boolean")


def shared(keys: DataFrame, rows: int) -> DataFrame:
    """The rows whose key another row has. Keys are dealt out by their upper bits and sorted; a task holds one batch and one key's rows."""
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // KEYS_A_TASK))
    names = ["key", "id", "at", "first"]

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last key met, which the next batch may go on with
        for batch in batches:
            now = pa.table({c: batch.column(c) for c in names})
            now = pa.concat_tables([held, now]) if held is not None else now
            key = now.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            held = now.slice(last)
            yield from kept(now.slice(0, last), key[:last])
        if held is not None:
            yield from kept(held, held.column("key").to_numpy())

    def kept(rows: pa.Table, key: np.ndarray) -> list[pa.RecordBatch]:
        same = key[1:] == key[:-1]
        more = np.zeros(len(key), bool)
        more[1:] |= same
        more[:-1] |= same
        return rows.filter(pa.array(more)).combine_chunks().to_batches()

    radix = F.shiftrightunsigned("key", 33).cast("int") % parts
    return keys.repartitionById(parts, radix).sortWithinPartitions("key").mapInArrow(repeated, "key long, id long, at int, first boolean")


def nearest(vocabulary: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near and the most frequent one, as (count below zero, word, id), of those with any."""
    members = found.join(vocabulary, "id").withColumn("left", F.when(F.col("at") < 0, F.col("word")).otherwise(without("word", F.col("at"))))
    members = members.withColumn("me", F.struct((-F.col("n")).alias("less"), "word", "id")).select("key", "left", "id", "at", "first", "me")
    group = Window.partitionBy("key", "left")
    place = Window.partitionBy("key", "left", "at")
    ranked = place.orderBy("me")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longer = (F.col("at") >= 0) & F.col("first")
    members = members.select(
        "id", "at", "first", "me",
        F.count(F.lit(1)).over(place).alias("alike"), F.row_number().over(ranked).alias("rank"), F.first("me").over(whole).alias("one"), F.nth_value("me", 2).over(whole).alias("two"),
        F.max(F.when(F.col("at") < 0, F.col("me"))).over(group).alias("shorter"), F.count_if(longer).over(group).alias("n_longer"), F.min(F.when(longer, F.col("me"))).over(group).alias("longer"),
    )
    replaced = F.when(F.col("rank") == 1, F.col("two")).otherwise(F.col("one"))
    shorter = F.when(F.col("first"), F.col("shorter"))
    n = F.when(F.col("at") < 0, F.col("n_longer")).otherwise(F.col("alike") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
    best = F.when(F.col("at") < 0, F.col("longer")).otherwise(F.least(replaced, shorter))
    return members.select("id", n.alias("n"), best.alias("best")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(edges: DataFrame) -> DataFrame:
    """(id, root): the last word reached from each id by edges (id, to, root), where root is the word of `to`. Each round a word jumps to where its
    form has come, so rounds are the logarithm of the longest chain."""
    steps, n = tallied(edges, "spelling-steps")
    while n:
        ahead = broadcast_if(steps.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("last")), n, EDGES)
        seen = Observation()
        moved = steps.join(ahead, "to", "left")
        moved = moved.observe(seen, F.count("next").alias("n")).select("id", F.coalesce("next", "to").alias("to"), F.coalesce("last", "root").alias("root"))
        steps = written(moved, "spelling-steps")
        if not seen.get["n"]:
            break
    return steps.select("id", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n), each word once."""
    with temporary(words.sparkSession):
        seen = Observation()
        own = words.select("word", "n").withColumn("id", F.monotonically_increasing_id())  # fixed once it is written
        own = own.observe(seen, F.sum(F.char_length("word") + 1).alias("keys"))
        vocabulary = written(own, "spelling-words", keep=True)
        found = written(shared(keyed(vocabulary), seen.get["keys"] or 0), "spelling-shared")
        near = written(nearest(vocabulary, found), "spelling-near", keep=True)
        formed = vocabulary.join(near, "id").where(-F.col("best.less") >= times * F.col("n"))
        last = written(roots(formed.select("id", F.col("best.id").alias("to"), F.col("best.word").alias("root"))), "spelling-roots", keep=True)
    chosen = (-F.col("best.less")) >= times * F.col("n")
    out = vocabulary.join(near, "id", "left").join(last, "id", "left")
    form, count = F.when(chosen, F.col("best.word")), F.when(chosen, -F.col("best.less"))
    return out.select("word", form.alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), count.alias("form_n"))


def op12_deletion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its form and its root."""
    return variants(word_counts(table(spark, sf_dir, "documents")))
