"""Near copies against a brute-force Jaccard join."""

import random

import pytest

from skerry.llm import copies, pipeline, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_firsts(docs):
    """Smallest ids of the groups linked by shingles of five words that are SIMILARITY alike."""
    sets = [(i, simhash.shingles(t, 5)) for i, t in docs]
    group = {i: i for i, _ in sets}
    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if len(x & y) >= pipeline.SIMILARITY * len(x | y) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    return {i for i, v in group.items() if i == v}


def table_of(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA)


@pytest.mark.parametrize(("dense", "sample"), [(32, 16), (3, 1)])
def test_every_similar_pair_is_found(spark, monkeypatch, dense, sample):
    monkeypatch.setattr(copies, "DENSE", dense)
    monkeypatch.setattr(copies, "SAMPLE", sample)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    docs = []
    for _ in range(40):
        base = [*rng.choices(words, k=rng.randint(20, 90)), *passage.split(" ")]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for at in rng.sample(range(len(own)), rng.randint(0, 3)):
                own[at] = rng.choice(words)
            docs.append((len(docs), " ".join(own)))
    fps = [simhash.fingerprint(t, 1, True) for _, t in docs]
    sets = [simhash.shingles(t, 5) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert any(bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") > pipeline.NEAR_BITS for i, j in pairs)
    kept = {r["doc_id"] for r in pipeline.drop_copies(spark, table_of(spark, docs), "").collect()}
    assert kept == brute_firsts(docs)


def test_only_copies_go(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d, base = text(60), text(60), text(60), text(60), text(100)
    words = base.split(" ")
    mixed = " ".join(rng.sample(words, len(words)))
    assert simhash.fingerprint(base, 1, True) == simhash.fingerprint(mixed, 1, True)
    docs = [(None, a), (None, b), (None, c), (7, c), (5, a.replace(" ", " extra ", 1)), (5, d), (5, b), (9, base), (10, mixed), (11, base.upper()), (None, None), (12, ""), (13, d), (13, d)]
    kept = sorted(((r["doc_id"], r["text"]) for r in pipeline.drop_copies(spark, table_of(spark, docs), "").collect()), key=str)
    assert kept == sorted([(5, docs[4][1]), (5, d), (5, b), (7, c), (9, base), (10, mixed), (12, "")], key=str)


def test_unlike_texts_put_no_row_a_token_into_tables(spark, monkeypatch):
    """Tokens that one text has alone are counted, and neither written nor shuffled with their places."""
    rng = random.Random(10)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    docs += [(200 + i, t.replace(" ", " extra ", 1)) for i, t in docs[:5]]
    made, written, tallied = {}, copies.written, copies.tallied
    monkeypatch.setattr(copies, "written", lambda df, name, **more: (out := written(df, name, **more), made.update({name: out.count()}))[0])
    monkeypatch.setattr(copies, "tallied", lambda df, name: (out := tallied(df, name), made.update({name: out[1]}))[0])
    assert pipeline.drop_copies(spark, table_of(spark, docs), "").count() == 200
    assert max(made.values()) <= len(docs), made
