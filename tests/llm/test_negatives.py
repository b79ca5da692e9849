"""Hard negatives against brute force in Python's integers."""

import math
from collections import Counter

import numpy as np
import pytest

from skerry.llm import negatives
from skerry.session import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    whole = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(k, tuple(math.floor(256.0 * float(np.float32(x))) for x in v), (y + 1) % 10 if k % 7 == 0 else y) for k, v, y in whole]
    out = Counter()
    for k, v, y in {r for r in whole if r[0] % 100 == 0}:
        scored = sorted((-max(-negatives.EDGE, min(negatives.EDGE, sum(a * b for a, b in zip(v, w)))), i, z) for i, w, z in whole if i != k)
        for s, i, _ in [r for r in scored if r[2] == y][:5]:
            fit = [r for r in scored if r[2] != y and 80 * -s <= 100 * -r[0] <= 100 * -s]
            out.update((k, i, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(fit[:5]))
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_query_against_brute_force(spark, folder):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, f"/root/testdata/{folder}", "embeddings").collect()]
    want = brute(rows)
    assert got(negatives.op13_residual_bounds(spark, f"/root/testdata/{folder}")) == want and want


def test_odd_rows_and_waves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(k), rng.normal(size=5).round(2).tolist(), int(y)) for k, y in zip(range(-300, 300), rng.integers(0, 3, 600), strict=True)]
    rows += [(100, [0.5] * 5, 1), (200, [1.0, 2.0], 1), (None, [1.0] * 5, 1), (301, None, 1), (302, [1.0] * 5, None), (303, [float("nan")] * 5, 1), (304, [None] * 5, 2), (305, [float("inf")] * 5, 2), (306, [], 0)]
    rows += [(400, [1.0] * 5, 1)] * 2 + [(k, [0.25] * 5, k % 3) for k in range(401, 480)]  # repeated anchors, many equal vectors
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert got(negatives.hard_negatives(negatives.participants(df))) == want and want
    for name, value in (("BLOCK", 7), ("CHUNK", 2), ("PAIRS", 3), ("SAMPLE", 4)):
        monkeypatch.setattr(negatives, name, value)
    assert got(negatives.hard_negatives(negatives.participants(df), wave=3)) == want


def test_huge_components_and_empty_tables(spark):
    rows = [(k, [3e38 if k % 2 else -3e38, float(k), 1e30], k % 3) for k in range(0, 300, 10)] + [(k, [], 1) for k in (5, 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(negatives.hard_negatives(negatives.participants(df))) == brute(rows)
    assert negatives.hard_negatives(negatives.participants(df.limit(0))).count() == 0
    assert negatives.hard_negatives(negatives.participants(spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 2)], SCHEMA))).count() == 1


def test_bounds_hold():
    rng = np.random.default_rng(1)
    rows, anchors = np.floor(rng.normal(size=(500, 7)) * 256), np.floor(rng.normal(size=(9, 7)) * 256)
    q = negatives.Quantiser(rows[:50])
    low, high = negatives.bounds(q, q.tables(anchors), q.norms(anchors), *q.encode(rows))
    true = rows @ anchors.T
    assert (low <= true).all() and (true <= high).all() and (high - low).mean() < 0.5 * np.ptp(true)
