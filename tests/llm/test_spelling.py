"""Spelling variants against brute force over whole texts."""

import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import spelling
from skerry.session import table

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_counts(docs):
    found = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    of, by = {}, {}
    for w in counts:
        by.setdefault(len(w), []).append(w)
    for w, n in counts.items():
        close = [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by.get(k, ()) if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        of[w] = (len(close), best if best and counts[best] >= 2 * n else None)
    out = set()
    for w, (n, form) in of.items():
        root = w
        while of[root][1]:
            root = of[root][1]
        out.add((w, form, root, counts[w], n, counts[form] if form else None))
    return out


def rows(df):
    return Counter((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_query_against_brute_force(spark):
    counts = plain_counts([(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()])
    want = plain_variants(counts)
    assert rows(spelling.op12_deletion_keys(spark, FOLDER)) == Counter(want)
    assert any(r[1] and r[1] != r[2] for r in want) or len(want) > 500


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abéÿ", min_size=1, max_size=9), min_size=1, max_size=20))
def test_keys_are_those_of_the_deletions(words):
    key, word, at, first = spelling.deletion_keys(words)
    left = [words[w] if a < 0 else words[w][:a] + words[w][a + 1 :] for w, a in zip(word, at, strict=True)]
    assert len(key) == sum(len(w) + 1 for w in words)
    assert len(set(zip(left, key.tolist(), strict=True))) == len(set(left)) == len(set(key.tolist()))
    once = [(w, t) for w, a, t, f in zip(word.tolist(), at, left, first, strict=True) if f and a >= 0]
    assert len(once) == len(set(once)) == len({(w, t) for w, a, t in zip(word.tolist(), at, left, strict=True) if a >= 0})


def test_chains_hubs_and_long_words(spark, monkeypatch):
    words = {"chain": 640, "chaina": 320, "chainab": 160, "chainabc": 80, "chainabcd": 40, "chainabcde": 20, "chainabcdef": 10, "aaaaa": 5, "aaaaaa": 5, "aaaaba": 12, "z" * 5000: 9, "z" * 4999: 3, "z" * 2500 + "y" + "z" * 2499: 30}
    words |= {f"hub{chr(c)}s": 3 for c in range(0xC0, 0xF7)} | {"hubs": 100, "hubxs": 100}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    want = Counter(plain_variants(words))
    assert rows(spelling.variants(df)) == want
    monkeypatch.setattr(spelling, "LETTERS_A_TURN", 7)
    monkeypatch.setattr(spelling, "EDGES", -1)
    assert rows(spelling.variants(df)) == want


def test_collisions_are_told_apart_by_strings(spark, monkeypatch):
    monkeypatch.setattr(spelling, "mixed", lambda x: x & np.uint64(3))  # nearly all keys collide
    words = plain_counts([(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").limit(12).collect()])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    vocabulary = df.withColumn("id", F.crc32("word"))
    assert len({zlib.crc32(w.encode()) for w in words}) == len(words)
    key, word, at, first = spelling.deletion_keys(list(words))
    ids = [zlib.crc32(w.encode()) for w in words]
    keys = spark.createDataFrame([(int(k), ids[w], int(a), bool(f)) for k, w, a, f in zip(key, word, at, first, strict=True)], "key long, id long, at int, first boolean")
    got = {r["id"]: (r["n_near"], r["best"]["word"]) for r in spelling.nearest(vocabulary, spelling.shared(keys, len(key))).collect()}
    close = {w: [v for v in words if near(w, v)] for w in words}
    assert got == {zlib.crc32(w.encode()): (len(v), min(v, key=lambda x: (-words[x], x))) for w, v in close.items() if v} and got


def test_odd_inputs(spark, odd, none):
    docs = odd.union(odd).union(odd)
    counts = plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == counts
    assert rows(spelling.variants(spelling.word_counts(docs))) == Counter(plain_variants(counts))
    assert spelling.variants(spelling.word_counts(none)).count() == 0
