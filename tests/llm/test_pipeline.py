"""The corpus pipeline, stage by stage, on a small fixture and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import decontaminate, lines, packing, pipeline, simhash, toxicity
from test_ops import brute_lines

COLUMNS = pipeline.COLUMNS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic words, copies, near copies, repeated lines and a benchmark passage."""
    top = tmp_path_factory.mktemp("tables")
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["the", "on", "re", "ti", "an", "st", "ea"], k=rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, "\n".join(text(30) for _ in range(4))) for i in range(80)]
    docs += [(100 + i, f"{text(40)} zugmuk vexorb {text(20)} zugmuk") for i in range(40)]
    item = "quick brown foxes never jump over twelve lazy dogs at noon today"
    docs += [(200 + i, f"{text(20)} {item} {text(10)}") for i in range(3)]
    base = text(120)
    docs += [(300, base), (301, base), (302, base.replace(" ", "  ", 1)), (303, " ".join(["swap", *base.split(" ")[1:]]))]
    docs += [(400, None), (401, ""), (402, docs[0][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i in [*range(80), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    read = lambda df: {(r["doc_id"], r["text"]) for r in df.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "packing":
            whole = {r[0]: r[1] for r in out.groupBy("doc_id").agg(F.sum("length")).collect()}
            ids = packing.encoder(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN)
            assert whole == {r["doc_id"]: len(ids.encode(r["text"] or "", allowed_special="all")) + 1 for r in docs.collect()}
            break
        assert out.columns == COLUMNS
        before, after = read(docs), read(out)
        if name == "toxicity":
            assert {i for i, _ in before - after} == set(range(100, 140)) and len(after) == len(before) - 40
        elif name == "line_dedup":
            assert after == set(brute_lines(sorted(before, key=str)))
        elif name == "near_dedup":
            fps = {i: simhash.fingerprint(t, 1, True) for i, t in before}
            sets = {i: simhash.shingles(t, 5) for i, t in before}
            group = {i: i for i in fps}
            for a in sorted(fps):
                for b in sorted(fps):
                    near = bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1")
                    if a < b and (near == 0 or near <= pipeline.NEAR_BITS and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                        low, high = sorted((group[a], group[b]))
                        group = {k: low if v == high else v for k, v in group.items()}
            assert {i for i, _ in after} == {i for i in fps if group[i] == i}
        else:
            assert {i for i, _ in before - after} == {200, 201, 202} & {i for i, _ in before}
        docs = spark.createDataFrame(out.collect(), docs.schema)


def test_stages_take_odd_documents(spark, folder, odd, none):
    for docs in (odd.select(*COLUMNS, "k", "fp", "score"), none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() >= 0 and (name == "packing" or out.columns == COLUMNS)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert out.where("doc_id >= 100 AND doc_id < 140 OR doc_id IN (200, 201, 202)").count() == 0


def test_thresholds_are_those_documented():
    assert toxicity.THRESHOLD == 0.3 and lines.SIMILAR >= 0.8 and decontaminate.WINDOW == 10 and pipeline.SIMILARITY >= 0.8
