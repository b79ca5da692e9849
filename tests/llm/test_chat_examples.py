"""op5's result comes from its examples: a wrong expansion doesn't go unseen."""

import pytest
from pyspark.sql import functions as F

from skerry.llm import chat

FOLDER = "/root/testdata/sf0.001"
EXPAND = chat.expand


@pytest.mark.parametrize("column", ["target_start", "target_end", "example"])
def test_wrong_spans_are_refused(spark, monkeypatch, column):
    monkeypatch.setattr(chat, "expand", lambda turns: EXPAND(turns).withColumn(column, F.col(column) - 1))
    with pytest.raises(Exception, match="prefix of its conversation"):
        chat.op5_chat_prefix_targets(spark, FOLDER).collect()


def test_missing_examples_change_the_result(spark, monkeypatch):
    whole = chat.op5_chat_prefix_targets(spark, FOLDER).agg(F.sum("loss_chars")).first()[0]
    monkeypatch.setattr(chat, "expand", lambda turns: EXPAND(turns).where("example > 2"))
    assert chat.op5_chat_prefix_targets(spark, FOLDER).agg(F.sum("loss_chars")).first()[0] < whole


def test_every_example_has_its_turns_before(spark):
    rows = [(c, i, ("user", "assistant")[i % 2], f"{c}<{i}") for c in (1, 2, None) for i in range(7)]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {(r["conv_id"], r["example"]): r for r in chat.expand(turns).collect()}
    assert set(found) == {(c, n) for c in (1, 2, None) for n in (2, 4, 6)}
    for (c, n), r in found.items():
        before = "".join(f"<|turn:{('user', 'assistant')[i % 2]}|>{c}&lt;{i}<|end|>" for i in range(n - 1))
        assert r["context"] == before + "<|turn:assistant|>" and r["target"] == f"{c}&lt;{n - 1}"


def test_wrong_contexts_are_refused(spark, monkeypatch):
    monkeypatch.setattr(chat, "expand", lambda turns: EXPAND(turns).withColumn("context", F.when(F.col("example") > 2, F.translate("context", "e", "f")).otherwise(F.col("context"))))
    with pytest.raises(Exception, match="prefix of its conversation"):
        chat.op5_chat_prefix_targets(spark, FOLDER).collect()
