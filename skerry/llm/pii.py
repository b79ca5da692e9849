"""PII: information-theoretic sanitisation.

Base spans (emails, IP addresses, card and phone numbers) are found by pattern in whole texts. They and secrets (runs of SECRET
characters or more that mix letters and digits, with ENTROPY bits a character) are protected. What terms (words of three letters
or more) reveal of them is estimated from their co-occurrence in whole distinct texts over the corpus, for two kinds of entity:
each protected value, and each class of values (that a text holds, say, a secret at all), which pools the many values that occur
once. The probability of entity e in a text with term t is P(e|t) = (n(e,t) + PRIOR n(e) / N) / (n(t) + PRIOR), so pairs that are
seen rarely lean on the entity's own share; what stays uncertain of e is -log2 P(e|t) bits. In every text that holds the entity,
all occurrences of terms that leave GENERALISE bits or less are replaced by their class, those that leave REMOVE or less are
removed, and so are secrets.

Equal texts count once: a text of n copies counts 1/n for each, so counts are summed where texts are read, and only sums are
shuffled. Entities and terms that are too rare to reach GENERALISE under PRIOR are dropped before anything is counted over all texts.

Defined cases: null texts are empty; texts without a protected value have no spans; overlapping spans of different kinds are all
reported; equal texts get equal spans and count once, whatever their ids; null ids pass through; an empty table gives an
empty table; extra columns are left out (sanitise() hands them on); long digit or letter runs cost time in proportion.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import broadcast_if, free, temporary, written
from skerry.session import table

KINDS = ("email", "ip", "card", "phone", "secret", "generalised", "removed")
BASE = 4  # kinds found by the base patterns
PRIOR = 4.0  # texts
GENERALISE, REMOVE = 1.0, 0.25  # bits left uncertain
SECRET, ENTROPY = 20, 3.0
LEAST = PRIOR * 2**-GENERALISE / (1 - 2**-GENERALISE) - 1  # texts a pair needs; 1 less, as the entity's own share adds to it
TERM_ROWS = 200_000  # terms held by a task; beyond it all terms are joined instead
COPY_ROWS = 500_000  # broadcast rows, of 24 bytes and their overhead
PAIR_ROWS = 200_000
FLUSH = 200_000  # counts a task holds before it hands them on

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can't begin inside a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{%d,}" % SECRET)
WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in order; kind is a place in KINDS. Values are compared without letter case or separators."""
    out = [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end(), m[0]))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end(), digits))
        if "+" in text:
            for m in PHONE.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if 10 <= len(digits) <= 15:
                    out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def secrets(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Like base_spans(): runs that look drawn at random, outside the base spans."""
    out = []
    for m in TOKEN.finditer(text):
        x = m[0]
        if DIGIT.search(x) and any(c.isalpha() for c in x) and not any(a < m.end() and m.start() < b for a, _, b, _ in spans):
            n = Counter(x).values()
            if -sum(k / len(x) * math.log2(k / len(x)) for k in n) >= ENTROPY:
                out.append((m.start(), 4, m.end(), x))
    return out


def entities(spans: list[tuple[int, int, int, str]]) -> list[int]:
    """What a text holds: the classes of its values, named by their place in KINDS, and the values by hash."""
    return sorted({k for _, k, _, _ in spans} | {xxhash.xxh64_intdigest(f"{KINDS[k]}:{v}") - (1 << 63) for _, k, _, v in spans})


def terms(text: str) -> set[str]:
    return {w.lower() for w in WORD.findall(text)}


def occurrences(text: str, spans: list[tuple[int, int]], kinds: dict[str, int]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all words that kinds names, outside the spans."""
    found = [(*m.span(), m[0].lower()) for m in WORD.finditer(text)]
    starts, ends = [a for a, _, _ in found], [b for _, b, _ in found]
    taken = {k for a, b in spans for k in range(bisect_right(ends, a), bisect_left(starts, b))}
    return [(a, kinds[w], b) for k, (a, b, w) in enumerate(found) if w in kinds and k not in taken]


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
SPANS = "array<struct<start:int,kind:int,end:int>>"


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, text, h, g): two independent hashes stand for a text in shuffles."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g"))


def scan(rows: DataFrame, id_col: str) -> DataFrame:
    """(id_col, h, g, spans, entities, text) of keyed() rows: protected values of every whole text; texts without one aren't kept."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans, held, kept = [], [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text)
                found = sorted(found + secrets(text, found))
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b, _ in found])
                held.append(entities(found))
                kept.append(text if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(spans, pa.list_(SPAN)), pa.array(held, pa.list_(pa.int64())), pa.array(kept, pa.string())], [id_col, "h", "g", "spans", "entities", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(find, f"`{id_col}` {kind}, h long, g long, spans {SPANS}, entities array<long>, text string")


def counted(rows: DataFrame, known: frozenset | None) -> DataFrame:
    """(entity, term, n) of rows (entity, text, share): sums of shares of the texts that hold both, of known terms if given."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], float] = {}

        def full() -> pa.RecordBatch:
            keys = list(sums)
            out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([t for _, t in keys], pa.string()), pa.array(sums.values(), pa.float64())], ["entity", "term", "n"])
            sums.clear()
            return out

        for batch in sliced(batches, 256):
            for entity, text, share in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = terms(text)
                for t in own if sent.value is None else own & sent.value:
                    sums[entity, t] = sums.get((entity, t), 0.0) + share
            if len(sums) >= FLUSH:
                yield full()
        yield full()

    return rows.select("entity", "text", "share").mapInArrow(count, "entity long, term string, n double").groupBy("entity", "term").agg(F.sum("n").alias("n"))


def held_terms(df: DataFrame, most: int) -> frozenset | None:
    """df's terms, if they are few enough for a task to hold."""
    return frozenset(r[0] for r in df.collect()) if df.count() <= most else None


def disclosures(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, kind): terms that leave too little uncertain of an entity. rows: keyed(), found: their written scan()."""
    copies = written(found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "pii-copies")
    copies = broadcast_if(copies, copies.count(), COPY_ROWS)
    share = (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("share")
    total = float(round(found.join(copies, ["h", "g"], "left").agg(F.coalesce(F.sum(share), F.lit(0.0))).first()[0]))
    holders = found.where("text IS NOT NULL").join(copies, ["h", "g"], "left").select(F.explode("entities").alias("entity"), "text", share)
    sizes = holders.groupBy("entity").agg(F.sum("share").alias("n_e")).where(F.col("n_e") > LEAST - 1e-6)
    sizes = written(sizes, "pii-entities")
    pairs = counted(holders.join(broadcast_if(sizes, sizes.count(), PAIR_ROWS), "entity"), None).where(F.col("n") > LEAST - 1e-6)
    pairs = written(pairs.withColumnRenamed("n", "n_et").join(sizes, "entity"), "pii-pairs")
    names = written(pairs.select("term").distinct(), "pii-terms")
    every = counted(rows.join(copies, ["h", "g"], "left").select(F.lit(0).cast("long").alias("entity"), "text", share), held_terms(names, TERM_ROWS))
    p = (F.col("n_et") + PRIOR * F.col("n_e") / F.lit(max(total, 1.0))) / (F.col("n") + PRIOR)
    left = -F.log2(p)
    rated = pairs.join(every.select("term", "n"), "term").where((left <= GENERALISE) & (F.col("n_e") < total - 0.5))
    kind = F.when(left <= REMOVE, KINDS.index("removed")).otherwise(KINDS.index("generalised"))
    return rated.select("entity", "term", kind.cast("int").alias("kind"))


def marked(found: DataFrame, told: DataFrame) -> DataFrame:
    """(h, g, terms): spans of the told terms in each distinct text that holds their entity."""
    sent = found.sparkSession.sparkContext.broadcast(held_terms(told.select("term").distinct(), TERM_ROWS))
    texts = found.where("text IS NOT NULL").select("h", "g", "entities", "spans", "text").dropDuplicates(["h", "g"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            out = [(h, g, e, t) for h, g, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in (terms(text) if sent.value is None else terms(text) & sent.value) for e in held]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["h", "g", "entity", "term"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            out = []
            for base, text, kinds in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                best: dict[str, int] = {}
                for x in kinds:
                    best[x["term"]] = max(best.get(x["term"], 0), x["kind"])
                out.append([{"start": a, "kind": k, "end": b} for a, k, b in occurrences(text, [(s["start"], s["end"]) for s in base], best)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(SPAN))], ["h", "g", "terms"])

    met = texts.select("h", "g", "entities", "text").mapInArrow(pairs, "h long, g long, entity long, term string").join(broadcast_if(told, told.count(), PAIR_ROWS), ["entity", "term"])
    met = met.groupBy("h", "g").agg(F.collect_set(F.struct("term", "kind")).alias("kinds"))
    return texts.join(met, ["h", "g"]).select("h", "g", "spans", "text", "kinds").mapInArrow(spans, f"h long, g long, terms {SPANS}")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, h, g, base, all): arrays of (start, kind, end), in order, for every row of docs."""
    rows = keyed(docs, id_col, text_col)
    found = written(scan(rows, id_col), "pii-scan")
    with temporary(docs.sparkSession):
        terms = written(marked(found, written(disclosures(rows, found), "pii-disclosures")), "pii-marked", keep=True)
    out = found.select(id_col, "h", "g", "spans").join(broadcast_if(terms, terms.count(), PAIR_ROWS), ["h", "g"], "left")
    every = F.array_sort(F.concat(F.transform("spans", told_secret), F.coalesce("terms", F.array().cast(SPANS))))
    return out.select(id_col, "h", "g", F.filter("spans", lambda s: s.kind < BASE).alias("base"), every.alias("all"))


def told_secret(s: Column) -> Column:
    """A span as it is reported: a secret is removed."""
    kind = F.when(s.kind < BASE, s.kind).otherwise(F.lit(KINDS.index("removed")))
    return F.struct(s.start.alias("start"), kind.alias("kind"), s.end.alias("end"))


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten: spans become their kind in angle brackets, removed terms vanish."""
    spans = find_spans(docs, id_col, text_col).where(F.size("all") > 0).dropDuplicates(["h", "g"])
    h, g, all_spans = (free(c, docs.columns) for c in ("_h", "_g", "_all"))  # the input's columns keep their names
    spans = spans.select(F.col("h").alias(h), F.col("g").alias(g), F.col("all").alias(all_spans))

    @F.pandas_udf("string")
    def rewrite(texts, spans):
        def one(text, spans):
            if text is None or spans is None or not len(spans):
                return text
            out, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    out += [text[at : s["start"]], "" if KINDS[s["kind"]] == "removed" else f"<{KINDS[s['kind']].upper()}>"]
                at = max(at, s["end"])
            return "".join((*out, text[at:]))

        return texts.combine(spans, one)

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select("*", F.xxhash64(text).alias(h), F.xxhash64(F.lit(7), text).alias(g)).join(spans, [h, g], "left")
    return out.select(*(rewrite(text_col, all_spans).alias(c) if c == text_col else c for c in docs.columns))


def op2_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document. Two passes over the texts; shuffled are sums of counts, and the texts that hold a protected value."""
    out = find_spans(table(spark, sf_dir, "documents"))
    count = [F.expr(f"size(filter(base, s -> s.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE])]
    return out.select("doc_id", *count, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))
