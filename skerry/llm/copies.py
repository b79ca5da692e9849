"""Near copies: SimHash near-dedup by the generalised pigeonhole principle, verified, and made whole by the texts' shingles.

Nodes are sets of shingles; texts with equal sets (copies, other case or white space) are one node. Nodes whose SimHashes of
distinct words differ in NEAR_BITS at most are searched as in simhash.py; of those found, pairs whose shingles have a Jaccard
similarity of `similarity` or more are linked. SimHash finds such pairs with some probability only, so the groups it gives are
joined by a second search that misses none: all tokens (hashes of shingles) have one order, rarest first. Of two sets that are alike enough, each holds a common token among its first
n - ceil(similarity n) + 1, so these prefixes are indexed, and nodes that share one, with sizes and places that still allow
the similarity, are compared by the shingles of their texts, unless SimHash has put them into one group already. The order comes from counts in a sample of texts; it bears on the
number of candidates, not on what is found.

A token of more than DENSE nodes (a family of near copies) isn't expanded into pairs: its nodes are first held against a few
leaders, and then those outside the first leader's group against the others. A pair inside one group adds nothing to it.

Defined cases: null and empty texts and texts without words are one node; shorter texts than a shingle are one shingle; equal
rows share a group; ids may be null or repeated, as a row is named by its id and two hashes of its text; of a group the row
with the smallest name is the first, null ids last; an empty table gives an empty table; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import broadcast_if, components, tallied, temporary, written
from skerry.llm import simhash
from skerry.llm.simhash import SEED, shingles

SIZE = 5
NEAR_BITS, NEAR_PARTS = 4, 3
DENSE = 32
LEADERS = 4
SAMPLE, OFTEN, RANKED = 16, 4, 100_000  # one text of so many is sampled; tokens found so often in it are ranked, that many at most
NAMED = 500_000  # broadcast rows, of some 40 bytes and their overhead


def hashes(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    joined, size = b" ".join(words), min(size, len(words))
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], dtype=np.uint64).view(np.int64))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with h and g, which with the id name a row."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.withColumn("h", F.xxhash64(text)).withColumn("g", F.xxhash64(F.lit(7), text))


def ranks(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts) of the commonest tokens of a sample of docs (h, text), by token."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                found = [hashes(t.as_py(), size) for t in whole.slice(at, 1024).column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["token"])

    sample = docs.where(F.pmod("h", F.lit(SAMPLE)) == 0).select("text").mapInArrow(tokens, "token long")
    common = sample.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(RANKED)
    rows = sorted((r["token"], r["n"]) for r in common.collect())
    return np.array([t for t, _ in rows], dtype=np.int64), np.array([n for _, n in rows], dtype=np.int64)


def prefix(found: np.ndarray, known: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first tokens of a set, rarest first; equally rare ones by token."""
    if not len(found):
        return found
    tokens, counts = known
    rank = np.zeros(len(found), dtype=np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
        rank = np.where(tokens[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))][: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]


def scan(docs: DataFrame, id_col: str, size: int, similarity: float) -> DataFrame:
    """(id_col, h, g, k, n, fp, tokens) of docs (id_col, h, g, text): the node of each row, its number of shingles, its SimHash and
    its prefix."""
    known = docs.sparkSession.sparkContext.broadcast(ranks(docs, size))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys, counts, first, fps = [], [], [], []
                for text in batch.column(3):
                    found = hashes(text.as_py(), size)
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    counts.append(len(found))
                    first.append(prefix(found, known.value, similarity))
                    fps.append(simhash.fingerprint(text.as_py(), 1, True))
                k = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
                ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(counts, pa.int32()), pa.array(fps, pa.int64()), tokens], [id_col, "h", "g", "p", "q", "n", "fp", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, "h", "g", "text").mapInArrow(find, f"`{id_col}` {kind}, h long, g long, p long, q long, n int, fp long, tokens array<long>")
    return out.select(id_col, "h", "g", F.struct("p", "q").alias("k"), "n", "fp", "tokens")


def may_be_alike(similarity: float) -> Column:
    """Sizes n_a, n_b and the places of the first common token allow the similarity. Every pair that is alike passes at the
    first token it shares."""
    both = F.ceil((F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-9)
    return F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= both


def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("token", F.col("k").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "at", *more)))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, size: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are alike. A node's text is that of its first row."""
    pairs = written(pairs, "copies-pairs")
    named = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    named, rows = tallied(nodes.join(named, "k").select("k", F.col("first.id").alias("_id"), F.col("first.h").alias("_h"), F.col("first.g").alias("_g")), "copies-named")
    same = docs[id_col].eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))
    texts = docs.join(broadcast_if(named, rows, NAMED), same).select("k", F.coalesce("text", F.lit("")).alias("text"))
    texts = written(texts.dropDuplicates(["k"]), "copies-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = shingles(x, size), shingles(y, size)
                    keep.append(len(x & y) >= similarity * len(x | y))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = [texts.select(F.col("k").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compare, "a long, b long")


def near_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that join all nodes of one SimHash, and SimHashes that differ in NEAR_BITS at most. Each SimHash
    stands for the first of its nodes; what that misses is found by the shingles."""
    fps = written(nodes.groupBy("fp").agg(F.min("k").alias("k")), "copies-fps")
    found, _ = simhash.links(fps.select("fp"), NEAR_BITS, NEAR_PARTS)
    one = [fps.select(F.col("fp").alias(f"f{s}"), F.col("k").alias(s)) for s in "ab"]
    across = found.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(one[0], "fa").join(one[1], "fb").select("a", "b")
    same = nodes.select("fp", F.col("k").alias("a")).join(fps.withColumnRenamed("k", "b"), "fp").where("a <> b").select("a", "b")
    return ordered(across.union(same))


def numbered(rows: DataFrame, id_col: str) -> DataFrame:
    """(k, first, n, fp, tokens): a scan()'s nodes, each once, named by a number in place of its key, with its first row. Numbers are
    short in shuffles, which hold a row for each token of a node's prefix."""
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "h", "g")
    nodes = rows.groupBy("k").agg(F.min(name).alias("first"), *(F.first(c).alias(c) for c in ("n", "fp", "tokens")))  # equal keys, equal sets
    return written(nodes.select(F.monotonically_increasing_id().alias("k"), "first", "n", "fp", "tokens"), "copies-nodes")


def shared_tokens(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """(k, n, at, token, group, size): the prefixes' tokens that nodes of more than one group share. joined: (k, component) of nodes. Tokens are
    counted first; then those that are shared are looked up, so what is written doesn't have a row for each token of a text."""
    grouped = written(nodes.select("k", "n", "tokens").join(joined, "k", "left").select("k", "n", "tokens", F.coalesce("component", "k").alias("group")), "copies-prefixes")
    counts = grouped.select("group", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    shared, n = tallied(counts.where("lo <> hi").select("token", "size"), "copies-several")
    index = grouped.select("k", "n", F.posexplode("tokens").alias("at", "token"), "group")
    return written(index.join(broadcast_if(shared, n, NAMED), "token"), "copies-shared")


def links(nodes: DataFrame, docs: DataFrame, id_col: str, size: int, similarity: float) -> DataFrame:
    """(a, b): links that join exactly the groups of nodes reachable over pairs that are alike. nodes: numbered()."""
    near = written(alike(near_pairs(nodes), nodes, docs, id_col, size, similarity), "copies-near")
    shared = shared_tokens(nodes, components(near).select(F.col("node").alias("k"), "component"))
    sparse, dense = shared.where(f"size <= {DENSE}"), shared.where(f"size > {DENSE}")
    leaders = dense.groupBy("token").agg(*(F.min(F.struct(F.xxhash64(F.lit(r), "k").alias("o"), "k", "n", "at", "group")).alias(f"l{r}") for r in range(LEADERS)))
    leaders = written(leaders, "copies-leaders")
    led = leaders.select("token", F.explode(F.array(*(F.col(f"l{r}") for r in range(LEADERS)))).alias("l")).select("token", "l.k", "l.n", "l.at", "l.group").distinct()
    other = (F.col("group_a") != F.col("group_b")) & may_be_alike(similarity)
    pairs = side(sparse, "a", "group").join(side(sparse, "b", "group"), "token").where((F.col("a") < F.col("b")) & other).select("a", "b")
    met = side(dense, "a", "group").join(side(led, "b", "group"), "token").where(other).select("a", "b")
    sure = written(near.union(alike(ordered(pairs.union(met)), nodes, docs, id_col, size, similarity)), "copies-sure")
    # what the leaders leave apart
    group = components(sure).select(F.col("node").alias("k"), "component")
    apart = dense.select("token", "k", "n", "at").join(group, "k", "left").withColumn("group", F.coalesce("component", "k"))
    first = leaders.select("token", F.col("l0.k").alias("k")).join(group, "k", "left").select("token", F.coalesce("component", "k").alias("main"))
    apart = written(apart.join(first, "token").select("token", "k", "n", "at", "group", (F.col("group") != F.col("main")).alias("minor")), "copies-apart")
    minor = apart.where("minor")
    others = apart.join(minor.select("token").distinct(), "token", "left_semi")
    rest = side(minor, "a", "group").join(side(others, "b", "group"), "token").where(other).select("a", "b")
    return sure.union(alike(ordered(rest), nodes, docs, id_col, size, similarity))


def firsts(docs: DataFrame, similarity: float, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, h, g, members): the name of the first row of each group of near copies, and how many nodes the group has."""
    docs = identified(docs.select(id_col, F.col(text_col).alias("text")), id_col, "text")
    with temporary(docs.sparkSession):
        nodes = numbered(scan(docs, id_col, size, similarity), id_col)
        group = components(links(nodes, docs, id_col, size, similarity)).select(F.col("node").alias("k"), "component")
        joined = nodes.join(group, "k", "left").groupBy(F.coalesce("component", "k").alias("component"))
        out = joined.agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("members"))
        return written(out.select("first.id", "first.h", "first.g", "members"), "copies-firsts", keep=True)
