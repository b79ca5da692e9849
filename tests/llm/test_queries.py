"""Every query function of the subpackage: the columns and types its contract fixes, a row for each row asked for, and values that follow from the row alone."""

import hashlib
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from skerry.llm import catalog, chat, urls
from skerry.session import table

FOLDER = "/root/testdata/sf0.001"
FIXED = {  # query: (table with a row for each row of the result, or none; columns and types)
    "op1": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op2": ("documents", "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"),
    "op3": ("documents", "doc_id bigint, text string, n_removed bigint"),
    "op4": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op5": (None, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"),
    "op6": ("documents", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
    "op7": (None, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"),
    "op8": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
    "op9": ("documents", "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"),
    "op10": ("documents", "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"),
    "op11": ("documents", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"),
    "op12": (None, "word string, form string, root string, n bigint, n_near bigint, form_n bigint"),
    "op13": (None, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"),
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_columns_types_and_rows(spark, name):
    source, columns = FIXED[name.partition("_")[0]]
    out = catalog.QUERIES[name](spark, FOLDER)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in (x.split(" ")[0] for x in columns.split(", "))} == dict(x.split(" ") for x in columns.split(", "))
    rows = out.collect()
    assert rows and (source is None or len(rows) == table(spark, FOLDER, source).count())


def test_simhash_query_by_hand(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, FOLDER, "documents").collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = {}
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(low))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in catalog.op8_generalised_pigeonhole(spark, FOLDER).collect()}
    assert got == {k: (f"{fps[k]:016x}", find(k)) for k in ids}


def test_packing_query_covers_every_document(spark):
    rows = catalog.op7_minimum_bin_slack(spark, FOLDER).collect()
    ids = {r["doc_id"] for r in table(spark, FOLDER, "documents").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == ids
    at = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        start, piece = at.get(r["doc_id"], (0, 0))
        assert (r["start"], r["piece"]) == (start, piece) and 0 < r["length"] <= 1024 and (piece == 0 or r["length"] == 1024)
        at[r["doc_id"]] = (start + r["length"], piece + 1)
    full = {}
    for r in rows:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in full.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 1024


def test_line_query_keeps_first_occurrences(spark):
    out = {r["doc_id"]: r for r in catalog.op3_simhash_lines(spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}
    seen = {}
    for k in sorted(texts):
        was, kept = (texts[k] or "").split("\n"), (out[k]["text"] or "").split("\n")
        assert out[k]["n_removed"] == 0 and was == kept or len(was) - out[k]["n_removed"] == len([x for x in kept]) or not kept[0]
        assert out[k]["text_sha256"] == hashlib.sha256((out[k]["text"] or "").encode()).hexdigest()
        for line in kept:
            line = line.strip(" ").lower()
            assert not line or line not in seen, "a line that was kept before"
            seen[line] = k


def test_url_query_rules(spark):
    rows = catalog.op1_url_model_ratio(spark, FOLDER).collect()
    assert {r["verdict"] for r in rows} == {"allow", "block"}
    known = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    assert all(r["rule"] is None or r["verdict"] == known[r["rule"]] for r in rows)


def test_odd_urls_and_conversations(spark):
    clash = ("host", "path", "rule", "verdict", "score", "gram", "url_length", "_h")
    pages = spark.createDataFrame([(1, "http://a.net/x" + "y" * 30_000), (1, None), (1, None), (None, ""), (2, "http://a.net/x"), (2, "http://a.net/x"), (3, "\n://\u2028")], "page_id long, url string").select("*", *(F.lit(0).alias(c) for c in clash))
    assert urls.judge(pages).count() == 7 and urls.judge(pages.limit(0)).count() == 0
    turns = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (1, None, "user", "first"), (None, 1, None, None), (2, 5, "assistant", "<|turn:user|>" * 3000), (2, 4, "user", "")]
    made = chat.format_turns(spark.createDataFrame(rows, turns).select("*", *(F.lit(0).alias(c) for c in ("place", "segment", "start", "example"))))
    whole = {}
    for r in made.orderBy("conv_id", "place").collect():
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["segment"]
    assert set(whole) == {1, 2, None} and whole[1].index("first") < whole[1].index("a<|end|>")
    found = chat.expand(made).collect()
    assert sorted(r["target"] for r in found if r["conv_id"] == 1) == ["a", "a", "b"] and len(found) == 4
    assert chat.format_turns(spark.createDataFrame([], turns)).count() == 0 == chat.expand(chat.format_turns(spark.createDataFrame([], turns))).count()


def test_shard_query_digests(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, FOLDER, "documents").collect()}
    for r in catalog.op6_sharding(spark, FOLDER).collect():
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]))
