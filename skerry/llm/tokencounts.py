"""Token counts: two tiers of lookups inside the tasks that read the texts, so that no pre-token is ever shuffled.

A text is cut at ASCII white space, which no pattern of the tokenizer crosses and nothing composes with, so the counts of its
words add up to its own. The first tier is a broadcast table of the lengths of the corpus' frequent words. They are found by a
sketch of frequent items over all texts: each task sends one summary of TRACKED items at most, summaries meet in GROUPS groups
and then in one, whatever the input. The second tier is for words that aren't in the table: a worker's caches of words and of
pre-tokens, of ROOM letters each, kept over the batches and tasks of the worker; what isn't asked for again is forgotten. A missed word of
ASCII and Latin-1 letters is cut into the tokenizer's own pre-tokens, which repeat more often than words do; those not in the cache are encoded by the
library, many at once, and so are whole words with anything else in them (a special string, another script).

Both tiers change time only: a count is always what the library gives for the whole text. A lost executor loses caches alone.

Defined cases: a null text is empty and has no tokens; an empty table gives an empty table; rows equal in everything are rows of
their own; extra columns pass through, whatever their names, but for those of the count's own name; texts of any length are read whole,
in pieces of PIECE bytes that end at white space.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.session import table

MODEL = "word_bpe_49k.json"
LIMIT = 2048
FREQUENT, LONGEST = 8192, 32  # words in the broadcast table and bytes of each, so 300 KB at most
TRACKED, GROUPS = 16384, 64  # items of a summary, groups in which summaries meet
ROOM = 4 << 20  # letters of the texts in one generation of a cache, so some 500,000 words
PIECE = 4 << 20  # bytes of text looked up at once
JOINED, END = 4096, "</w>"  # words encoded at once; how the vocabulary marks the last token of a word
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")  # letters in these ranges have one lower-case letter each and don't compose
SPECIAL = "<|"
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")  # fixed: the tokenizer's, for PLAIN in lower case


class Library:
    """How many tokens the library makes of texts. As a word's last token alone has END in its name, many words joined by blanks are encoded at once and counted apart."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for name, i in self.model.get_vocab().items() if name.endswith(END)]] = True

    def texts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def pretokens(self, words: list[str]) -> list[int]:
        """Token counts of pre-tokens of PLAIN words."""
        out = []
        for k in range(0, len(words), JOINED):
            [found] = self.model.encode_batch_fast([" ".join(words[k : k + JOINED])], add_special_tokens=False)
            at = np.flatnonzero(self.ends[np.array(found.ids, np.int64)])
            out += np.diff(at, prepend=-1).tolist()
        return out


class Kept:
    """Counts by text in two generations. When the younger one is full it becomes the older, and what was older and not asked for since is forgotten."""

    def __init__(self, room: int, always: dict | None = None):
        self.room, self.always, self.size = room, always or {}, 0
        self.young, self.old = dict(self.always), {}

    def unknown(self, asked: set) -> set:
        """Those of the asked that aren't known; the rest is in `young` until the next call."""
        if self.size > self.room:
            self.old, self.young, self.size = self.young, dict(self.always), 0
        new = asked.difference(self.young)
        again = new.intersection(self.old)
        self.add({x: self.old[x] for x in again})
        return new - again

    def add(self, counts: dict) -> None:
        self.young.update(counts)
        self.size += sum(map(len, counts))


class Lengths:
    """Token counts of texts. frequent: the broadcast table of words (bytes); other words are counted when they are first met."""

    def __init__(self, frequent: dict[bytes, int], library: Library, room: int = ROOM):
        self.library, self.words, self.pretokens = library, Kept(room, frequent), Kept(room)

    def learn(self, words: set[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = [PLAIN.fullmatch(t) is not None and SPECIAL not in t for t in texts]
        parts = [PRETOKEN.findall(t.lower()) for t, p in zip(texts, plain, strict=True) if p]
        new = list(self.pretokens.unknown(set(chain.from_iterable(parts))))
        self.pretokens.add(dict(zip(new, self.library.pretokens(new), strict=True)))
        known = self.pretokens.young.__getitem__
        cut, whole = (sum(map(known, p)) for p in parts), iter(self.library.texts([t for t, p in zip(texts, plain, strict=True) if not p]))
        self.words.add({w: next(cut if p else whole) for w, p in zip(words, plain, strict=True)})

    def count(self, texts: list[bytes]) -> list[int]:
        """For texts of some PIECE bytes together."""
        words = [t.split() for t in texts]
        new = self.words.unknown(set(chain.from_iterable(words)))
        if new:
            self.learn(new)
        known = self.words.young.__getitem__
        return [sum(map(known, w)) for w in words]

    def of(self, texts: list[bytes | None]) -> list[int]:
        """Texts of any number and length, PIECE bytes or a little more at a time."""
        out, held, size = np.zeros(len(texts), np.int64), [], 0
        for k, text in enumerate(texts):
            for piece in cut(text or b""):
                held.append((k, piece))
                size += len(piece)
                if size >= PIECE:
                    self.settle(out, held)
                    held, size = [], 0
        self.settle(out, held)
        return out.tolist()

    def settle(self, out: np.ndarray, held: list[tuple[int, bytes]]) -> None:
        np.add.at(out, [k for k, _ in held], self.count([p for _, p in held]))


def cut(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes, each but the last cut before white space."""
    at, blank = 0, re.compile(rb"[ \t\n\r\x0b\x0c]")
    while len(text) - at > size:
        found = blank.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = FREQUENT) -> list[str]:
    """The words that a sketch over all texts finds frequent, the most frequent first; `most` of them at most. Words are cut at blanks here, as this
    list decides about time only. What is shuffled is one summary for each task."""
    words = docs.select(F.explode(F.split(text_col, " ")).alias("w")).where(F.octet_length("w").between(1, LONGEST))
    summed = words.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(w, {TRACKED})").alias("s"))
    top = summed.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s")).select(F.expr(f"approx_top_k_estimate(s, {most})").alias("top"))
    return [x["item"] for row in top.collect() for x in row["top"]]  # no row if there are no words


_kept: dict[tuple, Lengths] = {}  # a worker's caches, by table


def counter(spark: SparkSession, frequent: list[str], path: str) -> Callable[[str | Column], Column]:
    """A column function: the token count of a text."""
    words = [w.encode() for w in frequent]
    told = spark.sparkContext.broadcast((b"\n".join(words), Library(path).texts(frequent)))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        joined, lengths = told.value
        key = (path, hash(joined))
        if key not in _kept:
            _kept.clear()
            _kept[key] = Lengths(dict(zip(joined.split(b"\n"), lengths, strict=False)) if lengths else {}, Library(path))
        of = _kept[key].of
        for texts in batches:
            yield pa.array(of(texts.cast(pa.binary()).to_pylist()), pa.int64())

    return count


def with_token_counts(docs: DataFrame, text_col: str = "text", name: str = "n_tokens", path: str | None = None) -> DataFrame:
    """docs, all columns, with the number of tokens of the text as column `name`."""
    words = [w for w in frequent_words(docs, text_col) if "\n" not in w]
    return docs.withColumn(name, counter(docs.sparkSession, words, path or public_tokenizers.path(MODEL))(text_col))


def op11_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its bytes, its tokens, and whether it has more than LIMIT of them."""
    counted = with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
