"""Token counts against the library over whole texts."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skerry.llm import tokencounts
from skerry.session import table

PATH = public_tokenizers.path(tokencounts.MODEL)
FOLDER = "/root/testdata/sf0.01"
LIBRARY = tokencounts.Library(PATH)
WHOLE = Tokenizer.from_file(PATH)


def whole(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False))


def test_query_against_the_library(spark):
    out = {r["doc_id"]: r for r in tokencounts.op11_two_tier_token_counts(spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}
    assert out.keys() == texts.keys() and any(r["over_limit"] for r in out.values())
    for k, text in texts.items():
        n = whole(text)
        assert (out[k]["n_bytes"], out[k]["n_tokens"], out[k]["over_limit"]) == (len((text or "").encode()), n, n > 2048)


pieces = st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|", "it's", "WE'LL", "É", "é", "́", "ß", " ", "\u0085", "\x1c", "\x1f", "²", "İ", "ΑΣ", " ", "日本", "한", " ", "\n", "\t", "x1y", "...", "'S"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(pieces, st.text(max_size=8)), max_size=12).map("".join))
def test_lengths_add_up(text):
    text = text.encode(errors="ignore").decode()
    lengths = tokencounts.Lengths({}, LIBRARY, room=3)  # caches that are emptied all the time
    n, data = whole(text), text.encode()
    assert lengths.of([data, None, data]) == lengths.of([data, b"", data]) == [n, 0, n]
    assert sum(lengths.of(list(tokencounts.cut(data, 5)))) == n


def test_table_is_frequent_words_and_changes_nothing(spark):
    docs = table(spark, FOLDER, "documents")
    words = tokencounts.frequent_words(docs)
    plain = docs.select(F.explode(F.split("text", " ")).alias("w")).where("octet_length(w) between 1 and 32").groupBy("w").count().orderBy(F.desc("count")).limit(20).collect()
    assert {r["w"] for r in plain} <= set(words) and len(words) <= tokencounts.FREQUENT
    lengths = tokencounts.Lengths({w.encode(): -1 for w in words[:1]}, LIBRARY)
    assert lengths.of([f"{words[0]} {words[1]}".encode()]) == [whole(words[1]) - 1]  # the first tier is what answers


def test_odd_inputs(spark, odd, none):
    out = tokencounts.with_token_counts(odd, name="n")
    assert out.columns == [*odd.columns, "n"]
    assert sorted((whole(r["text"]), r["n"]) for r in out.collect()) == sorted((whole(r["text"]),) * 2 for r in odd.collect())
    assert tokencounts.with_token_counts(none).count() == 0
