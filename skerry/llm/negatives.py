"""Hard negatives: exact top windows of integer inner products, with candidates filtered by product quantisation.

Vectors are cut into parts of PART components. Codebooks of CODES centroids a part are fitted on a bounded sample (SAMPLE rows, those
with the least hashes); every row is indexed by its codes, the norms of what the centroids leave of each part, and its exact
integers. An anchor's lookup tables hold its inner products with all centroids; the sum of a row's entries is its approximate
score, and by Cauchy-Schwarz the exact one differs by the sum over parts of the anchor's norm times the residual norm at most (a
margin for rounding added). So a row whose upper bound is below the k-th best lower bound, or whose interval misses the
window, can't be in the result; all others get their exact integer score. Nothing else is left out: the result is exact.

Anchors are taken in waves of about WAVE, whose vectors are broadcast; each wave reads the index twice. The first pass gives each anchor its best rows
of the same label, the second the best rows of other labels in each positive's window. A task keeps the best rows of each anchor and
window only, and these meet in a window function.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; a shorter vector counts as if filled
with zeros; rows equal in everything are rows of their own, but one anchor; a row with an anchor's own id is neither its positive nor
its negative; a positive that rows repeat has one result for each; windows of negative scores are empty; a score beyond 64 bits counts as the
largest or smallest such number; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import shared_folder, temporary, written
from skerry.session import table

PART, CODES, ROUNDS = 2, 256, 8
SAMPLE, SAMPLED = 4096, 1 << 21  # rows and components of the sample at most
WAVE = 8192
BLOCK, CHUNK = 4096, 256  # rows and anchors that meet at once
PAIRS = 1 << 18  # exact scores at once
POSITIVES, NEGATIVES = 5, 5
SCALE, LABELS, NOISY = 256, 10, 7  # fixed by the contract
EDGE = (1 << 63) - 1


class Quantiser:
    """Codebooks of a product quantiser, fitted by rounds of assigning and averaging from the sample's first distinct parts."""

    def __init__(self, sample: np.ndarray):
        self.width = sample.shape[1]
        parts = self.cut(sample)
        self.books = []
        for m in range(parts.shape[1]):
            own = parts[:, m]
            book = np.unique(own, axis=0)
            book = book[np.linspace(0, len(book) - 1, min(CODES, len(book))).astype(int)]
            for _ in range(ROUNDS):
                code = nearest(own, book)
                n = np.bincount(code, minlength=len(book))
                for c in range(PART):
                    book[:, c] = np.where(n > 0, np.bincount(code, own[:, c], len(book)) / np.maximum(n, 1), book[:, c])
            self.books.append(book)

    def cut(self, rows: np.ndarray) -> np.ndarray:
        """rows x parts x PART, the last part filled with zeros."""
        parts = -(-self.width // PART)
        return np.pad(rows, ((0, 0), (0, parts * PART - self.width))).reshape(len(rows), parts, PART)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and residual norms, rows x parts each."""
        parts = self.cut(rows)
        codes = np.stack([nearest(parts[:, m], b) for m, b in enumerate(self.books)], 1)
        left = np.stack([parts[:, m] - b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.linalg.norm(left, axis=2)

    def tables(self, anchors: np.ndarray) -> list[np.ndarray]:
        """For each part, centroids x anchors."""
        parts = self.cut(anchors)
        return [b @ parts[:, m].T for m, b in enumerate(self.books)]

    def norms(self, rows: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.cut(rows), axis=2)


def nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * (rows @ book.T), axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integers held as doubles: by doubles where no sum can pass 2^53, else by Python's integers."""
    if not a.size:
        return np.zeros(len(a), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)]
    return np.array([max(-EDGE, min(EDGE, x)) for x in whole], np.int64)


def participants(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector): rows that take part; every NOISY-th id has the next label."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).where(whole)
    label = F.when(F.col(id_col) % NOISY == 0, (F.col(label_col) + 1) % LABELS).otherwise(F.col(label_col))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("vector"))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """A batch of vectors as integers in doubles, filled to one width."""
    rows = column.to_pylist() if pc.min(pc.list_value_length(column)).as_py() != width else None
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width) if rows is None else np.array([r + [0.0] * (width - len(r)) for r in rows]).reshape(len(rows), width)
    return np.floor(flat * float(SCALE))


def index(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(vec_id, label, codes, norms, vector): norms and integers of a row as bytes of doubles."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = integers(batch.column("vector"), quantiser.width)
                codes, norms = quantiser.encode(vectors)
                bytes_of = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), bytes_of(codes), bytes_of(norms), bytes_of(vectors)], ["vec_id", "label", "codes", "norms", "vector"])

    return rows.mapInArrow(encode, "vec_id long, label long, codes binary, norms binary, vector binary")


class Best:
    """The `most` best (score down, id up) rows met so far for each slot."""

    def __init__(self, slots: int, most: int):
        self.most, self.slots = most, slots
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.slot, self.score, self.id = (x[rank < self.most] for x in (slot, score, ids))

    def floor(self, slots: np.ndarray) -> np.ndarray:
        """The score a row has to reach to be among the best of each slot: minus infinity where there is room."""
        out = np.full(self.slots, -np.inf)
        n = np.bincount(self.slot, minlength=self.slots)
        out[self.slot[np.searchsorted(self.slot, np.flatnonzero(n >= self.most), "right") - 1]] = self.score[np.searchsorted(self.slot, np.flatnonzero(n >= self.most), "right") - 1]
        return out[slots]


def bounds(quantiser: Quantiser, tables: list[np.ndarray], anchor_norms: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the exact scores, rows x anchors, within 64 bits as the scores are."""
    near, size = np.zeros((len(codes), anchor_norms.shape[0])), np.zeros((len(codes), len(tables)))
    for m, t in enumerate(tables):
        near += t[codes[:, m]]
        size[:, m] = np.linalg.norm(quantiser.books[m], axis=1)[codes[:, m]]
    slack = (norms * (1 + 1e-9) + size * ((len(tables) + 8) * 2.0**-50)) @ anchor_norms.T  # the second term: rounding of the sums above
    slack *= 1 + 1e-9
    return np.clip(near - slack, -EDGE, EDGE), np.clip(near + slack, -EDGE, EDGE)


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each column, minus infinity if there are fewer."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], -np.inf)


def searched(quantiser: Quantiser, anchors: dict[str, np.ndarray], windows: np.ndarray | None, most: int):
    """A function for mapInArrow over the index. Without windows (slots are anchors): the best rows of the anchor's label. With windows,
    rows of (anchor, positive's score) as slots: the best rows of other labels whose score is in the slot's window."""
    owner = np.arange(len(anchors["id"])) if windows is None else windows[:, 0]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                yield batch.slice(k, BLOCK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(owner), most)
        matrix = lambda block, name, kind: np.frombuffer(b"".join(block.column(name).to_pylist()), kind).reshape(block.num_rows, -1)
        for block in blocks(batches):
            ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
            codes, norms, vectors = matrix(block, "codes", np.uint8), matrix(block, "norms", float), matrix(block, "vector", float)
            for label in np.unique(labels if windows is None else anchors["label"]):
                rows = np.flatnonzero((labels == label) == (windows is None))
                mine = np.flatnonzero(anchors["label"] == label)
                for k in range(0, len(mine) if len(rows) else 0, CHUNK):
                    some = mine[k : k + CHUNK]
                    vector = anchors["vector"][some]
                    low, high = bounds(quantiser, quantiser.tables(vector), quantiser.norms(vector), codes[rows], norms[rows])
                    own = ids[rows][:, None] == anchors["id"][some][None]
                    place = np.searchsorted(some, owner)
                    slots = np.flatnonzero((place < len(some)) & (some[np.minimum(place, len(some) - 1)] == owner))
                    turns = [slots] if windows is None else [slots[windows[slots, 2] == j] for j in np.unique(windows[slots, 2])]
                    for turn in turns:  # slots of different anchors
                        col = place[turn]
                        lo, hi, fits = low[:, col], high[:, col], ~own[:, col]
                        sure = fits
                        if windows is not None:
                            top = windows[turn, 1].astype(float)
                            bottom, margin = 0.8 * top, 1e-6 * np.abs(top)
                            fits = fits & (hi >= bottom - margin) & (lo <= top + margin)
                            sure = fits & (lo >= bottom + margin) & (hi <= top - margin)
                        least = np.maximum(kth(np.where(sure, lo, -np.inf), most), best.floor(turn))
                        r, c = np.nonzero(fits & (hi >= least))
                        for p in range(0, len(r), PAIRS):
                            row, slot = rows[r[p : p + PAIRS]], turn[c[p : p + PAIRS]]
                            score = exact(anchors["vector"][owner[slot]], vectors[row])
                            if windows is not None:
                                inside = (score <= windows[slot, 1]) & np.array([5 * int(s) >= 4 * int(t) for s, t in zip(score, windows[slot, 1], strict=True)], bool)
                                row, slot, score = row[inside], slot[inside], score[inside]
                            best.add(slot, score, ids[row])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.id)], ["slot", "score", "id"])

    return search


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """The best rows of each slot over all tasks, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)


def is_anchor(vec_id: str = "vec_id") -> Column:
    return F.col(vec_id) % 100 == 0


def hard_negatives(vectors: DataFrame, anchor: Column | None = None, wave: int = WAVE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for participants() and a condition for anchors."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    width = vectors.agg(F.max(F.size("vector"))).first()[0]
    if not width:
        vectors, width = vectors.withColumn("vector", F.array(F.lit(0.0))), 1
    sample = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").select("vector").limit(min(SAMPLE, max(1, SAMPLED // width))).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    quantiser = Quantiser(integers(sample.column("vector").combine_chunks(), width))
    out = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    with temporary(spark):
        rows = written(index(vectors, quantiser), "negatives-index")
        picked = written(rows.where(is_anchor() if anchor is None else anchor).select("vec_id", "label", "vector").distinct(), "negatives-anchors")
        waves = max(1, -(-picked.count() // wave))
        for w in range(waves):
            found = picked.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(waves)) == w).orderBy("vec_id").toArrow()
            named = {"id": found.column("vec_id").to_numpy(), "label": found.column("label").to_numpy(), "vector": np.frombuffer(b"".join(found.column("vector").to_pylist()), float).reshape(found.num_rows, width)}
            near = ranked(rows.mapInArrow(searched(quantiser, named, None, POSITIVES), "slot long, score long, id long"), POSITIVES).toArrow()
            slot, score, ids, rank = (near.column(c).to_numpy() for c in ("slot", "score", "id", "rank"))
            windows = np.stack([slot, score, rank.astype(np.int64)], 1)
            order = np.lexsort((rank, slot))
            windows, ids = windows[order], ids[order]
            hard = ranked(rows.mapInArrow(searched(quantiser, named, windows, NEGATIVES), "slot long, score long, id long"), NEGATIVES)
            names = pa.table({"slot": np.arange(len(ids)), "anchor_id": named["id"][windows[:, 0]], "positive_id": ids, "positive_score": windows[:, 1]})
            names = spark.createDataFrame(names)  # POSITIVES rows an anchor of the wave
            done = hard.join(F.broadcast(names), "slot").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            done.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def op13_residual_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors of embeddings."""
    return hard_negatives(participants(table(spark, sf_dir, "embeddings")))
