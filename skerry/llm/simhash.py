"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct fingerprints are the nodes; copies collapse into one before any search. Correlated bits are grouped into PARTS
partitions. If two fingerprints differ in at most `most` bits and thresholds t_i sum to most - PARTS + 1, they differ in at
most t_i bits in some partition i. Each fingerprint chooses its own thresholds (-1 leaves a partition out) by dynamic
programming on the probes they cost and on the candidates they are estimated to bring; the estimate comes from histograms of
fixed size. It then probes an index of partition values with all values within its thresholds, and candidates are verified.

A bucket of the index with over DENSE members isn't expanded into pairs. Its members and those who probe it, its crowd, are dealt
anew: two that differ in at most `most` bits agree on two of most + 2 blocks of their other bits, so they meet under the bucket and two blocks.
Where DENSE or fewer meet, they are listed. Those who meet more (a large family of near copies) are linked through the points between
them instead: every fingerprint stands at all points within ceil(most / 2) bits of it, and is near at those within floor(most / 2).
Two differ in at most `most` bits exactly if one is near where the other stands, and whoever stands at a point may be linked to one
that is near. That finds the same groups in a number of rows proportional to the members.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like any other; shorter
texts than a shingle are one shingle; equal rows share a group; a null id never names a group unless the group has no
other; empty tables give empty tables; extra columns are left out; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import broadcast_if, components, shuffled, tallied, temporary, written
from skerry.session import table

SHINGLE, SEED, BITS, MOST = 3, 42, 64, 2
PARTS = 2
DENSE = 64  # members of a bucket from which pairs aren't listed
NAMED = 500_000  # broadcast rows, of 16 bytes and their overhead
PROBE_COST = 1.0  # of a probe, in candidates
POINT_ROWS = 1_000_000  # points of a task


def fingerprint(text: str | None, size: int = SHINGLE, distinct: bool = False) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space 09-0D and 20
    words = list(dict.fromkeys(words)) if distinct else words
    if not words:
        return 0
    joined, size = b" ".join(words), min(size, len(words))
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """(id_col, fp): a narrow pass over whole texts. distinct: words are taken once, in the order they come."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                fps = [fingerprint(t.as_py(), size, distinct) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def unpack(fps: np.ndarray) -> np.ndarray:
    """Bits of 64-bit fingerprints, bit 0 first."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how many have both set: 64 x 64 sums of tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = unpack(batch.column(0).to_numpy()).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        cell = np.arange(BITS * BITS + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["cell", "n"])

    found = dict(fps.select("fp").mapInArrow(sums, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())
    cells = np.array([found.get(i, 0) for i in range(BITS * BITS + 1)], dtype=np.float64)
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def partition_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Groups of equal size; each grows from the two most correlated bits left by the bit closest to its members."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    close = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(close, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        if k == parts - 1:
            out.append(sorted(left))
            break
        group = list(max(combinations(sorted(left), 2), key=lambda x: close[x]))[: max(1, size)]
        left -= set(group)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: close[b, group].mean())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], dtype=np.int64)


def part_column(bits: list[int]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.shiftright(F.col("fp"), b).bitwiseAND(F.lit(1).cast("long")), k) for k, b in enumerate(bits)))


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    return sum(((fps >> b) & 1) << k for k, b in enumerate(bits))


def histograms(fps: DataFrame, groups: list[list[int]]) -> list[list[np.ndarray]]:
    """Per partition and byte of its value, counts of the 256 byte values: a table of fixed size, summed over all nodes."""
    bytes_of = [F.shiftright(part_column(bits), 8 * j).bitwiseAND(F.lit(255).cast("long")) for bits in groups for j in range(-(-len(bits) // 8))]
    parts = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("int").alias("v")) for k, v in enumerate(bytes_of)))
    found = {(r[0], r[1]): r[2] for r in fps.select(F.explode(parts).alias("x")).groupBy("x.k", "x.v").count().collect()}
    tables, k = [], 0
    for bits in groups:
        own = []
        for _ in range(-(-len(bits) // 8)):
            own.append(np.array([found.get((k, v), 0) for v in range(256)], dtype=np.float64))
            k += 1
        tables.append(own)
    return tables


def within(tables: list[np.ndarray], most: int) -> list[np.ndarray]:
    """For each byte of a partition: [value, e] = share of nodes whose byte differs from value in exactly e bits."""
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    return [np.stack([(apart == e) @ t / max(t.sum(), 1) for e in range(most + 1)], axis=1) for t in tables]


def estimates(values: np.ndarray, near: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """[row, t] = estimated nodes within t bits of the row's value, bytes taken as independent."""
    total = np.zeros((len(values), most + 1))
    total[:, 0] = 1
    for j, byte in enumerate(near):
        own = byte[(values >> (8 * j)) & 255]
        total = np.stack([sum(total[:, i] * own[:, e - i] for i in range(e + 1)) for e in range(most + 1)], axis=1)
    return n * np.cumsum(total, axis=1)


def allocate(costs: list[np.ndarray], most: int) -> np.ndarray:
    """[row, part] thresholds that sum to most - parts + 1 at the least cost; costs: per part [row, t], t from 0. -1 is free."""
    rows, budget = len(costs[0]), most + 1  # each threshold uses t + 1 of it
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    choice = []
    for cost in costs:
        options = np.concatenate([np.zeros((rows, 1)), cost], axis=1)  # by t + 1
        now, how = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
        for used in range(budget + 1):
            for u in range(min(used, most + 1) + 1):
                value = best[:, used - u] + options[:, u]
                better = value < now[:, used]
                now[better, used], how[better, used] = value[better], u
        best = now
        choice.append(how)
    out, used = np.zeros((rows, len(costs)), dtype=np.int8), np.full(rows, budget)
    for i in reversed(range(len(costs))):
        u = choice[i][np.arange(rows), used]
        out[:, i] = u - 1
        used = used - u
    return out


def probes(fps: DataFrame, groups: list[list[int]], most: int = MOST) -> DataFrame:
    """(part, value, fp): the values each fingerprint looks up, by its own allocation."""
    tables, n = histograms(fps, groups), 0
    n = int(tables[0][0].sum())
    near = [within(t, most) for t in tables]
    flips = [[masks(len(bits), t) for t in range(most + 1)] for bits in groups]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                rows = whole.slice(at, 2048).column(0).to_numpy()
                values = [part_values(rows, bits) for bits in groups]
                costs = [estimates(v, near[i], n, most) + PROBE_COST * np.array([len(f) for f in flips[i]]) for i, v in enumerate(values)]
                chosen = allocate(costs, most)
                for i, v in enumerate(values):
                    for t in range(most + 1):
                        mine = chosen[:, i] == t
                        if mine.any():
                            keys = v[mine][:, None] ^ flips[i][t][None, :]
                            who = np.repeat(rows[mine], keys.shape[1])
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), i, np.int32)), pa.array(keys.ravel()), pa.array(who)], ["part", "value", "fp"])

    return fps.select("fp").mapInArrow(probe, "part int, value long, fp long")


def around(fps: DataFrame, radius: int) -> DataFrame:
    """(point, fp, apart): all points within radius bits of each fingerprint."""
    flips = [m - (1 << BITS) if m >> (BITS - 1) else m for r in range(radius + 1) for m in (sum(1 << b for b in bits) for bits in combinations(range(BITS), r))]
    flip = F.explode(F.array(*(F.lit(m).cast("long") for m in flips)))
    at = fps.select("fp", flip.alias("flip"))
    return at.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp", F.bit_count("flip").alias("apart"))


def narrowed(crowd: DataFrame, groups: list[list[int]], most: int) -> tuple[DataFrame, DataFrame, int]:
    """Of a crowd (part, value, fp): (a, b) links of those who meet DENSE or fewer under a bucket and two blocks, (fp) those who meet more, and
    the number of the latter. Two of one bucket that differ in `most` bits at most are linked, or both are among the latter."""

    def keyed(i: int) -> DataFrame:
        bits = [b for b in range(BITS) if b not in groups[i]]
        ends = [len(bits) * k // (most + 2) for k in range(most + 3)]
        blocks = {f"b{k}": part_column(bits[low:high]) if high > low else F.lit(0) for k, (low, high) in enumerate(zip(ends, ends[1:]))}
        keys = F.array(*(F.xxhash64("part", "value", F.lit(k), *pair) for k, pair in enumerate(combinations(blocks, 2))))
        return crowd.where(F.col("part") == i).withColumns(blocks).select("fp", F.explode(keys).alias("key"))

    rows = reduce(DataFrame.union, map(keyed, range(len(groups))))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = written(rows.join(shuffled(sizes), "key"), "simhash-blocks")
    a, b = (rows.where(f"n <= {DENSE}").select("key", F.col("fp").alias(s)) for s in "ab")
    listed = a.join(shuffled(b), "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)).select("a", "b")
    left, n = tallied(rows.where(f"n > {DENSE}").select("fp").distinct(), "simhash-left")
    return listed, left, n


def links(fps: DataFrame, most: int = MOST, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join exactly the groups of distinct fingerprints reachable over steps of `most` bits or fewer, and
    (part, value, fp) for the buckets whose pairs the links don't list one by one."""
    n, both = statistics(fps)
    groups = partition_bits(n, both, parts)
    values = F.array(*(F.struct(F.lit(i).alias("part"), part_column(bits).alias("value")) for i, bits in enumerate(groups)))
    index = fps.select("fp", F.explode(values).alias("x")).select(F.col("x.part").alias("part"), F.col("x.value").alias("value"), F.col("fp").alias("other"))
    buckets = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("one"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("one"))) <= most
    hits = probes(fps, groups, most).join(shuffled(buckets), ["part", "value"]).where((F.col("n") > 1) | (F.col("one") != F.col("fp")) & near)
    hits, met = tallied(hits, "simhash-hits")
    single = hits.where("n = 1").select(F.col("fp").alias("a"), F.col("one").alias("b"))
    sparse = index.join(broadcast_if(hits.where(f"n > 1 AND n <= {DENSE}"), met, NAMED), ["part", "value"])
    sparse = sparse.where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    crowded = hits.where(f"n > {DENSE}").select("part", "value", "fp")
    members = index.join(broadcast_if(crowded.select("part", "value").distinct(), met, NAMED), ["part", "value"]).select("part", "value", F.col("other").alias("fp"))
    crowd = written(members.union(crowded).distinct(), "simhash-crowd")
    listed, left, n = narrowed(crowd, groups, most)
    points = sum(comb(BITS, r) for r in range(-(-most // 2) + 1))
    stands = around(left.repartition(-(-n * points // POINT_ROWS) or 1), -(-most // 2))
    closest = stands.where(F.col("apart") <= most // 2).groupBy("point").agg(F.min("fp").alias("near"))
    stars = stands.join(shuffled(closest), "point").where("fp <> near").select(F.col("fp").alias("a"), F.col("near").alias("b"))
    found = single.union(sparse).union(listed).union(stars)
    return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-links"), crowd


def shingles(text: str | None, size: int) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """pairs (a, b) whose texts (fp, text) have that Jaccard similarity of shingles of `size` words."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = shingles(x, size), shingles(y, size)
                    keep.append(len(x & y) >= similarity * len(x | y))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def verified(found: DataFrame, crowd: DataFrame, nodes: DataFrame, docs: DataFrame, most: int, size: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Those of the links whose texts are alike, and all that join the groups these leave apart inside crowded buckets. A
    fingerprint's text is that of its document with the smallest id."""

    def check(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "simhash-pairs")
        named = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(nodes, "fp").select("fp", F.col("least").alias(id_col))
        named = written(named, "simhash-named")
        texts = docs.select(id_col, text_col).join(broadcast_if(named, named.count(), NAMED), id_col)
        texts = written(texts.groupBy("fp").agg(F.min(text_col).alias("text")), "simhash-texts")
        return alike(pairs, texts, size, similarity)

    sure = written(check(found), "simhash-sure")
    group = components(sure)
    apart = crowd.join(group, F.col("fp") == F.col("node"), "left").select("part", "value", "fp", F.coalesce("component", "fp").alias("g"))
    mixed = apart.groupBy("part", "value").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("part", "value")
    apart = written(apart.join(mixed, ["part", "value"]), "simhash-apart")
    other = apart.select("part", "value", F.col("fp").alias("b"), F.col("g").alias("gb"))
    rest = apart.withColumnRenamed("fp", "a").join(other, ["part", "value"])
    rest = rest.where((F.col("a") < F.col("b")) & (F.col("g") != F.col("gb")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))
    return sure.union(check(rest.select("a", "b").distinct()))


def groups(docs: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, parts: int = PARTS, similarity: float | None = None, verify_size: int = 5, distinct: bool = False) -> DataFrame:
    """(id_col, fp, component_id) for every row of docs. With a similarity, links count only if the texts' shingles of
    verify_size words are that much alike (Jaccard); equal fingerprints always count."""
    rows = written(fingerprints(docs, id_col, text_col, size, distinct), "fingerprints")
    with temporary(docs.sparkSession):
        nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
        found, crowd = links(nodes.select("fp"), most, parts)
        if similarity is not None:
            found = verified(found, crowd, nodes, docs, most, verify_size, similarity, id_col, text_col)
        joined = components(found)
        named = nodes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
        named = written(named, "named", keep=True)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(shuffled(named.join(shuffled(least), "component").select("fp", "component_id")), "fp").select(id_col, "fp", "component_id")


def op8_generalised_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its group. Only fingerprints are shuffled, never texts."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
