"""Toxicity: class-conditional Kneser-Ney models of the characters of words.

Models of toxic and of ordinary labelled texts give every word a log-likelihood. They discount their own counts of ORDERS
characters (short ones for what is unlike the language anywhere, long ones for ordinary syllables in an unusual row) and lean on
one shared backoff, built from continuation counts over both classes, so that rare expressions aren't judged by which class
they happened to be seen in. A text's features are, for each order, the difference of the two log-likelihoods, length-normalised
over the whole text, over its most toxic expressions, and over its suspicious words; a logistic curve turns them into a score.

Counts cover all labelled rows but the held-out ones; they stay on the cluster. Every n-gram that was seen has a log ratio, and so has
every context, whose ratio holds for n-grams that have none of their own. What reaches the driver and the tasks has a bound of its own:
the backoff has 64 ** SHORT entries at most, and each order has the ratios of at most GRAM_ROWS seen n-grams, the often seen ones, and
of contexts seen as often: the least count there is the smallest power of two that meets the bound, 1 while all of them do. The others
are looked up by joins: a word's value depends on the word alone, so each distinct word with an n-gram that isn't among the often seen
ones gets its value once, from the tables of all ratios, and the values are joined to the texts that have the word. Ratios are multiples
of 1 / UNIT, so sums are exact in any order and scores don't depend on which way a ratio was found.

Labelled rows are parted by crc32(doc_id as text) mod 4; part 2 is held out and never read. The curve's few weights are fitted
on about CALIBRATION_ROWS rows of part 3, chosen by hash, and scored by models of parts 0 and 1 alone; the models that then score all texts
count parts 0, 1 and 3. Scores depend on the text alone.

Defined cases: a null text is empty; empty texts have features of zero and so the curve's own base score; a null id has
no label and isn't held out; a document with several labels is toxic if any is; null labels don't count; if either class
has no labelled row, the score is the share of toxic rows; equal texts get equal scores; an empty table gives an empty
table; extra columns are left out; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import broadcast_if, setting, tallied, temporary, written
from skerry.session import table

SHORT, ORDERS = 4, (4, 9)
BASE = 64  # symbols
GRAM_ROWS = 1_000_000  # of an order, of 12 bytes each, sent to all tasks; the others are joined
UNIT = 4096  # log ratios are multiples of a part of this
NAMED = 500_000  # broadcast values of words, of some 40 bytes and their overhead
CALIBRATION_ROWS = 20_000
LABEL_ROWS = 2_000_000  # broadcast labels, of 12 bytes and their overhead
THRESHOLD = 0.3
CHUNK = 2_000_000  # characters handled at once
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024  # texts held at once on the way to Python, by a task and its worker
SUSPICIOUS = 2.0  # log ratio of a word from which it counts as such
RIDGE = 1e-3
FEATURES = 4  # for each order
TOP = 3  # most toxic words
NONE = -1e300  # in place of a word that a text doesn't have


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Of every code point: 0 for gaps between words, 1-26 for a-z, 27 for digits, 28-63 for other letters."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 28 + ord(x.lower()[0]) % 36
        elif x.isdigit():
            out[c] = 27
    return out


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, with one gap before and after words and none doubled, and the text of each symbol; the gap that
    ends a word belongs to its text, so what one text gets never depends on the next."""
    joined = "\n" + "".join((t or "") + "\n" for t in texts)
    s = symbol_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    sizes = np.array([len(t or "") + 1 for t in texts], dtype=np.int64)
    owner = np.append(np.int32(0), np.repeat(np.arange(len(texts), dtype=np.int32), sizes))
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep], owner[keep]


def codes(s: np.ndarray, order: int) -> np.ndarray:
    """For each symbol but the first: itself after the order - 1 before it, as far as its word goes, as one number."""
    now, alive = s[1:].astype(np.int64), np.ones(len(s) - 1, dtype=bool)
    for back in range(1, min(order, len(s))):
        before = np.zeros(len(s) - 1, dtype=np.int64)
        before[back - 1 :] = s[: len(s) - back]
        before[~alive] = 0
        now |= before << (6 * back)
        alive &= before != 0
    return now


def chunks(texts: list, size: int = CHUNK) -> Iterator[slice]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def count_grams(labelled: DataFrame) -> DataFrame:
    """(k, gram, t, o, tf, of): toxic and ordinary counts of labelled (text, toxic, fit) rows, the last two over rows with fit. Each
    task counts before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic, fit = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for part in chunks(texts):
                s, owner = symbols(texts[part])
                kind = (2 * fit[part].astype(np.int64) + (toxic[part] != 1))[owner[1:]]
                for k in ORDERS:
                    gram, at = np.unique(codes(s, k), return_inverse=True)
                    n = np.bincount(4 * at + kind, minlength=4 * len(gram)).reshape(-1, 4)
                    sums = (n[:, 0] + n[:, 2], n[:, 1] + n[:, 3], n[:, 2], n[:, 3])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram), *map(pa.array, sums)], ["k", "gram", "t", "o", "tf", "of"])

    counted = labelled.mapInArrow(count, "k int, gram long, t long, o long, tf long, of long")
    return counted.groupBy("k", "gram").agg(*(F.sum(c).alias(c) for c in ("t", "o", "tf", "of")))


def discount(ones: float, twos: float) -> float:
    return float(min(max(ones / (ones + 2 * twos), 0.1), 0.95)) if ones else 0.75


def backoff(grams: np.ndarray) -> np.ndarray:
    """[context of SHORT - 2 symbols, symbol]: the shared probability from continuation counts of distinct grams."""
    p, seen = np.full((1, BASE), 1.0 / BASE), {SHORT: np.unique(grams)}
    for k in range(SHORT - 1, 0, -1):  # continuation counts: distinct symbols before
        seen[k] = np.unique(seen[k + 1] & (BASE**k - 1))
    for k in range(1, SHORT):
        counts = np.bincount(seen[k + 1] & (BASE**k - 1), minlength=BASE**k).reshape(-1, BASE).astype(float)
        total = counts.sum(axis=1, keepdims=True)
        d = discount((counts == 1).sum(), (counts == 2).sum())
        lower = np.tile(p, (BASE if k > 1 else 1, 1))  # the context's last symbols name the shorter context
        own = np.maximum(counts - d, 0) / np.maximum(total, 1) + d * (counts > 0).sum(axis=1, keepdims=True) / np.maximum(total, 1) * lower
        p = np.where(total > 0, own, lower)
    return p


class Table:
    """Values by key: keys lie in the order of their places by hash, each at its own place or at the next free one after it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        place = self.place(keys)
        order, step = np.argsort(place, kind="stable"), np.arange(len(keys))
        at = np.maximum.accumulate(place[order] - step) + step if len(keys) else step
        self.keys, self.values = np.full(max((1 << self.bits), at[-1] + 1 if len(at) else 0) + 1, -1, np.int64), np.zeros(0, np.float32)
        self.values = np.zeros(len(self.keys), np.float32)
        self.keys[at], self.values[at] = keys[order], values[order]

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values; nan for unknown keys."""
        at = self.place(keys)
        out = np.where((found := self.keys[at]) == keys, self.values[at], np.float32(np.nan))
        left = np.flatnonzero((found != keys) & (found >= 0))
        at = at[left]
        while len(left):
            at = at + 1
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (found >= 0)
            left, at = left[more], at[more]
        return out


class Ratios:
    """Log ratios for one order: of n-grams that have one, else of their context, else none. whole: these are all n-grams and contexts seen."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], whole: bool = True):
        self.sides, self.whole = (grams, contexts), whole
        self.tables: list[Table] | None = None  # in place of the sides from the first use on

    def __getstate__(self) -> dict:
        sides = self.sides or [(t.keys[t.keys >= 0], t.values[t.keys >= 0]) for t in self.tables]
        return self.__dict__ | {"sides": sides, "tables": None}

    def found(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratios, nan where neither is known, and where n-grams have none of their own here."""
        if self.tables is None:
            self.tables, self.sides = [Table(*side) for side in self.sides], None
        out = self.tables[0].of(code)
        unseen = np.flatnonzero(np.isnan(out))
        out[unseen] = self.tables[1].of(code[unseen] >> 6)
        return out, unseen

    def of(self, code: np.ndarray) -> np.ndarray:
        return np.nan_to_num(self.found(code)[0])


def least_counts(counts: DataFrame) -> dict[int, int]:
    """For each order the least count of n-grams whose ratio is sent to tasks: the smallest power of two that leaves GRAM_ROWS or fewer."""
    steps = counts.groupBy("k", (F.char_length(F.bin(F.col("t") + F.col("o"))) - 1).alias("step")).count().collect()  # some 60 rows an order
    out = {}
    for k in ORDERS:
        rows = {r["step"]: r["count"] for r in steps if r["k"] == k}
        out[k] = next(2**m for m in range(64) if sum(n for step, n in rows.items() if step >= m) <= GRAM_ROWS)
    return out


def ratio_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Written log ratios (k, key, fit, all, often_fit, often_all) of all n-grams and of all contexts seen, over the rows with fit and over all
    rows of count_grams(), a written table; and the least count of often seen ones by order."""
    spark = counts.sparkSession
    short = counts.where(F.col("k") == SHORT).select("gram").toArrow()["gram"].to_numpy()  # 64 ** SHORT rows at most
    lower = backoff(short).reshape(-1)
    backed = F.broadcast(spark.createDataFrame(pa.table({"tail": np.arange(len(lower)), "p": lower})))  # 64 ** (SHORT - 1) rows
    classes = ("t", "o", "tf", "of")
    rare = {r["k"]: r for r in counts.groupBy("k").agg(*(F.count_if(F.col(c) == n).alias(f"{c}{n}") for c in classes for n in (1, 2))).collect()}
    context = F.shiftright("gram", 6)
    totals = counts.groupBy("k", context.alias("context")).agg(*(F.sum(c).alias(f"n_{c}") for c in classes), *(F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in classes))

    def d(c: str):
        return F.element_at(F.create_map(*(x for k, r in rare.items() for x in (F.lit(k), F.lit(discount(r[f"{c}1"], r[f"{c}2"]))))), F.col("k"))

    def weight(c: str):
        return F.when(F.col(f"n_{c}") > 0, d(c) * F.col(f"k_{c}") / F.col(f"n_{c}")).otherwise(F.lit(1.0))

    def p(c: str):
        return F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - d(c), F.lit(0.0)) / F.col(f"n_{c}")).otherwise(F.lit(0.0)) + weight(c) * F.col("p")

    seen = counts.withColumns({"context": context, "tail": F.col("gram").bitwiseAND(F.lit(BASE ** (SHORT - 1) - 1).cast("long"))}).join(totals, ["k", "context"]).join(backed, "tail")
    least = least_counts(counts)
    often = F.element_at(F.create_map(*(F.lit(x) for pair in least.items() for x in pair)), F.col("k"))

    def ratios(rows: DataFrame, key: str, fit: tuple, whole: tuple) -> DataFrame:
        known = lambda a, b, x: F.when(F.col(a) + F.col(b) > 0, F.rint((F.log(x(a)) - F.log(x(b))) * UNIT) / UNIT).cast("float")
        many = lambda a, b: F.col(a) + F.col(b) >= often
        return rows.select("k", F.col(key).alias("key"), known(*fit).alias("fit"), known(*whole).alias("all"), many(*fit[:2]).alias("often_fit"), many(*whole[:2]).alias("often_all"))

    grams = ratios(seen, "gram", ("tf", "of", p), ("t", "o", p))
    contexts = ratios(totals, "context", ("n_tf", "n_of", lambda n: weight(n[2:])), ("n_t", "n_o", lambda n: weight(n[2:])))
    return *(written(x, "toxicity-ratios", keep=True) for x in (grams, contexts)), least


def models(*tables) -> tuple[Callable[[], dict[int, Ratios]], ...]:
    """What gives the often seen ratios by order, over the rows with fit and over all rows: of ratio_tables(), or of the counts these come from."""
    grams, contexts, least = tables if len(tables) > 1 else ratio_tables(*tables)

    def side(x: DataFrame, k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
        found = x.where((F.col("k") == k) & F.col(f"often_{kind}")).select("key", kind).toArrow()  # GRAM_ROWS rows, about, at most
        return found["key"].to_numpy().copy(), found[kind].to_numpy().copy()

    return tuple((lambda kind=kind: {k: Ratios(side(grams, k, kind), side(contexts, k, kind), least[k] == 1) for k in ORDERS}) for kind in ("fit", "all"))


def word_parts(texts: list[str | None], known: dict[int, Ratios]) -> tuple[np.ndarray, pa.Array]:
    """[text, part] and the words left open, by text, as symbols: those with n-grams whose ratio may be in the tables only. Parts, over the
    other words: for each order the sum of their log ratios, what words exceed SUSPICIOUS by, and the TOP highest; last the
    numbers of symbols and of words, open ones too."""
    width = 2 + TOP
    out = np.zeros((len(texts), width * len(ORDERS) + 2))
    for i in range(len(ORDERS)):
        out[:, width * i + 2 : width * (i + 1)] = NONE
    opened, sizes, letters = np.zeros(len(texts), np.int64), [], []
    for part in chunks(texts):
        s, owner = symbols(texts[part])
        n, gaps = part.stop - part.start, np.flatnonzero(s[:-1] == 0)
        if not len(gaps):
            continue
        owners, rows = owner[gaps + 1], out[part]
        rows[:, -2], rows[:, -1] = np.bincount(owner[1:], minlength=n), np.bincount(owners, minlength=n)
        values, closed = [], np.ones(len(gaps), bool)
        for k in ORDERS:
            value, unseen = known[k].found(codes(s, k))
            if not known[k].whole:
                closed[np.searchsorted(gaps, unseen, "right") - 1] = False
            values.append(np.add.reduceat(np.nan_to_num(value, copy=False), gaps, dtype=np.float64))
        for i, all_words in enumerate(values):
            words, whose = all_words[closed], owners[closed]
            own = rows[:, width * i : width * (i + 1)]
            own[:, 0] = np.bincount(whose, weights=words, minlength=n)
            own[:, 1] = np.bincount(whose, weights=np.maximum(words - SUSPICIOUS, 0), minlength=n)
            order = np.lexsort((-words, whose))
            words, whose = words[order], whose[order]
            first = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]]) if len(whose) else np.zeros(0, np.int64)
            place = np.arange(len(whose)) - np.repeat(first, np.diff(np.r_[first, len(whose)]))
            top = place < TOP
            own[whose[top], 2 + place[top]] = words[top]
        if not closed.all():
            opened[part] = np.bincount(owners[~closed], minlength=n)
            ends = np.r_[gaps[1:], len(s) - 1]
            sizes.append((ends - gaps - 1)[~closed])
            letters.append(s[1:][np.repeat(~closed, ends - gaps) & (s[1:] != 0)])
    offsets = np.cumsum(np.r_[0, *sizes]).astype(np.int32)
    data = np.concatenate(letters) if letters else np.zeros(0, np.uint8)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return out, pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, opened]).astype(np.int32)), words)


def open_grams(words: list[bytes], known: dict[int, Ratios]) -> Iterator[tuple[np.ndarray, ...]]:
    """(word, order, n-gram, ratio of its context or nan, and for each order what the word's other n-grams sum up to, at one of its rows) for
    the n-grams of words, given as symbols, whose ratio may be in the tables only."""
    for part in chunks(words):
        s = np.frombuffer(b"\0" + b"".join(w + b"\0" for w in words[part]), np.uint8)
        gaps = np.flatnonzero(s[:-1] == 0)
        rows, others = [], []
        for k in ORDERS:
            code = codes(s, k)
            value, unseen = known[k].found(code)
            if not known[k].whole:
                at = np.searchsorted(gaps, unseen, "right") - 1
                rows.append((at, np.full(len(at), k, np.int32), code[unseen], value[unseen]))
                value[unseen] = 0
            others.append(np.add.reduceat(np.nan_to_num(value), gaps, dtype=np.float64))
        word, *rest = (np.concatenate(c) for c in zip(*rows, strict=True))
        one = np.zeros(len(word), bool)
        one[np.unique(word, return_index=True)[1]] = True
        yield word + part.start, *rest, *(np.where(one, o[word], 0.0) for o in others)


def features(more: bool) -> Column:
    """For each order: log ratio per symbol; that of the most toxic word; the mean of the TOP most toxic words; and what words exceed SUSPICIOUS
    by, per word. Of word_parts() and, if there are more, the values of open words."""
    width, out = 2 + TOP, []
    part = lambda i: F.get("_parts", F.lit(i))
    size, count = F.greatest(part(width * len(ORDERS)), F.lit(1.0)), part(width * len(ORDERS) + 1)
    for i in range(len(ORDERS)):
        total, above, top = part(width * i), part(width * i + 1), F.slice("_parts", width * i + 3, TOP)
        if more:
            total, above = (x + F.coalesce(f"_{name}{i}", F.lit(0.0)) for x, name in ((total, "total"), (above, "above")))
            top = F.slice(F.sort_array(F.concat(top, F.coalesce(f"_top{i}", F.array().cast("array<double>"))), asc=False), 1, TOP)
        tops = F.aggregate(top, F.lit(0.0), lambda a, x: a + F.when(x > NONE, x).otherwise(0.0))
        highest = F.when(count > 0, F.get(top, F.lit(0))).otherwise(0.0)
        words = F.greatest(count, F.lit(1.0))
        out += [total / size, highest, tops / F.least(words, F.lit(float(TOP))), above / words]
    return F.array(*out)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the base last) of a ridge logistic curve, by Newton's method."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = RIDGE * len(x) * np.diag([1.0] * (len(w) - 1) + [0.0]) + 1e-9 * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def curve(x: np.ndarray, known: tuple) -> np.ndarray:
    mean, scale, w = known
    return 1 / (1 + np.exp(-np.clip(np.column_stack([(x - mean) / scale, np.ones(len(x))]) @ w, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> tuple:
    """(ratios by order, curve, tables of all ratios or None if the former are all) or (None, share of toxic rows, None)."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(part != 2)
    sizes = known.groupBy("toxic").count().collect()
    classes = {r[0]: r[1] for r in sizes}
    share = classes.get(1, 0) / max(1, sum(classes.values()))
    if len(classes) < 2:
        return None, share, None
    labelled = docs.select("doc_id", "text").join(broadcast_if(known, sum(classes.values()), LABEL_ROWS), "doc_id")
    with temporary(docs.sparkSession):
        counts = written(count_grams(labelled.select("text", "toxic", (part != 3).alias("fit"))), "toxicity-counts")
        if not all(counts.agg(*(F.sum(c) for c in ("t", "o", "tf", "of"))).first()):
            return None, share, None
        *tables, least = ratio_tables(counts)
    fit, whole = models(*tables, least)
    tables = None if all(n == 1 for n in least.values()) else tables
    # a share of part 3 by hash, so no rows are sorted or gathered to choose it
    of_part = known.where(part == 3).count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, CALIBRATION_ROWS / max(1, of_part)) * 1_000_000)
    sent = docs.sparkSession.sparkContext.broadcast(fit())
    rows = measured(labelled.where(part == 3).where(draw), sent, tables, "fit", "toxic").toArrow()
    sent.destroy()
    toxic = rows["toxic"].to_numpy()
    if len(set(toxic.tolist())) < 2:
        return None, share, None
    curve = fit_curve(np.array(rows["features"].to_pylist()), toxic)
    del rows
    pa.default_memory_pool().release_unused()
    return whole(), curve, tables


def word_values(words: DataFrame, known: Broadcast, tables: list[DataFrame], kind: str) -> DataFrame:
    """(h, g, v0, v1, ...): for each order the log ratio of every distinct word (h, g, word), by the tables of all ratios."""
    names = [f"v{i}" for i in range(len(ORDERS))]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, k, gram, context, *others in open_grams(batch.column(2).to_pylist(), known.value):
                named = [c.take(pa.array(word)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*named, *map(pa.array, (k, gram)), pa.array(context, from_pandas=True), *map(pa.array, others)], ["h", "g", "k", "gram", "near", *names])

    rows = words.mapInArrow(spell, f"h long, g long, k int, gram long, near float, {', '.join(f'{v} double' for v in names)}")
    grams, contexts = (x.where(F.col(kind).isNotNull() & ~F.col(f"often_{kind}")).select("k", F.col("key").alias(key), F.col(kind).alias(value)) for x, key, value in zip(tables, ("gram", "context"), ("own", "far"), strict=True))
    sure = F.coalesce("own", "near")
    rows = rows.join(grams, ["k", "gram"], "left").select("h", "g", "k", sure.alias("value"), F.when(sure.isNull(), F.shiftright("gram", 6)).alias("context"), *names)
    rows = written(rows, "toxicity-open")
    left = rows.where("value IS NULL").join(contexts, ["k", "context"], "left").select("h", "g", "k", F.coalesce("far", F.lit(0.0)).cast("float").alias("value"), *names)
    found = rows.where("value IS NOT NULL").select(left.columns).union(left)
    return found.groupBy("h", "g").agg(*(F.sum(F.col(v) + F.when(F.col("k") == k, F.col("value").cast("double")).otherwise(0.0)).alias(v) for k, v in zip(ORDERS, names, strict=True)))


def measured(docs: DataFrame, known: Broadcast, tables: list[DataFrame] | None, kind: str, *keep: str, last: bool = False) -> DataFrame:
    """(keep, features) of docs (text, ...). known: ratios by order, of GRAM_ROWS entries a table, about, at most; tables: of all ratios, if
    known isn't all, read by the end of this call. last: what is written for the result stays after the temporary() around."""

    at_text = keep.index("text") if "text" in keep else len(keep)  # texts are sent once, kept or not

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                parts, words = word_parts(batch.column(at_text).to_pylist(), known.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(list(parts), pa.list_(pa.float64())), words], [*keep, "_parts", "_open"])
            whole = batch = None  # before the next one is read

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    sent = docs.select(*keep, *(["text"] if at_text == len(keep) else []))
    out = sent.mapInArrow(measure, f"{kinds}, _parts array<double>, _open array<binary>")
    if tables is None:
        return out.select(*keep, features(False).alias("features"))
    out = written(out.withColumn("_row", F.monotonically_increasing_id()), "toxicity-parts", keep=last)
    word = [F.xxhash64("word").alias("h"), F.xxhash64(F.lit(7), "word").alias("g")]
    words = out.select(F.explode("_open").alias("word")).distinct().select(*word, "word")
    values, n = tallied(word_values(words, known, tables, kind), "toxicity-words", keep=last)
    met = out.select("_row", F.explode("_open").alias("word")).select("_row", *word).join(broadcast_if(values, n, NAMED), ["h", "g"])
    found = []
    for i in range(len(ORDERS)):
        v = F.col(f"v{i}")
        found += [F.sum(v).alias(f"_total{i}"), F.sum(F.greatest(v - SUSPICIOUS, F.lit(0.0))).alias(f"_above{i}"), F.collect_list(v).alias(f"_top{i}")]
    return out.join(met.groupBy("_row").agg(*found), "_row", "left").select(*keep, features(True).alias("features"))


def score(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """(keep, score) for every row of docs (doc_id, text, ...). Texts are read once for counts of labelled rows and once here."""
    spark = docs.sparkSession
    with temporary(spark), setting(spark, BATCH, str(BATCH_ROWS)):
        ratio, known, tables = train(docs, labels)
        if ratio is None:
            return docs.select(*keep, F.lit(float(known)).alias("score"))
        out = measured(docs, spark.sparkContext.broadcast(ratio), tables, "all", *keep, last=True)
    mean, scale, w = known
    x = F.col("features")
    line = F.lit(float(w[-1]))
    for i in range(FEATURES * len(ORDERS)):
        line = line + (x[i] - float(mean[i])) / float(scale[i]) * float(w[i])
    value = 1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))))
    return out.select(*keep, value.alias("score"))


def op4_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score. N-gram counts are shuffled, and words with n-grams that aren't often seen."""
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
