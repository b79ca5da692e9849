"""The training-text operators against brute force, round trips, held-out accuracy and odd inputs."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st
from oracle import connect, difference
from pyspark.sql import functions as F

from skerry.llm import catalog, chat, common, decontaminate, lines, ogg, packing, pii, sharding, simhash, toxicity, urls
from skerry.session import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_twins(spark, name):
    assert difference(catalog.QUERIES[name](spark, FOLDER), connect(FOLDER), catalog.ORACLES[name]) is None


# --- 1: URLs


def test_hosts_rules_and_verdicts(spark):
    rows = [(1, "http://WWW.example.com/en/1?x"), (2, "https://a.example.com/en/1#t"), (3, "ftp://b.net/es/"), (4, "http://b.net/es"), (5, "x.com/a"), (6, None), (7, "http://com/"), (8, "http://notcom/a"), (9, "http://c.net?x/fr/"), (9, "http://c.net?x/fr/"), (None, "a://h://p")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("s", F.lit(1)).withColumn("score", F.lit(2))
    out = {(r["page_id"]): r for r in urls.judge(df).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (out[2]["rule"], out[2]["verdict"]) == ("example.com/en/", "block")
    assert (out[3]["rule"], out[3]["verdict"], out[4]["rule"]) == ("net/es/", "block", None)
    assert (out[5]["host"], out[5]["path"], out[5]["rule"], out[5]["verdict"]) == ("", "", None, "allow")
    assert (out[6]["host"], out[6]["verdict"], out[7]["rule"], out[8]["rule"]) == ("", "allow", "com/", None)
    assert (out[9]["host"], out[9]["path"], out[None]["host"]) == ("c.net", "", "h:")
    assert urls.judge(df).count() == len(rows) and urls.judge(df.limit(0)).count() == 0


def test_url_model_against_brute_force(spark):
    data = [("aab.x/k", True, 3), ("abab.x", True, 1), ("bbc.y/q", False, 2), ("cab.y", False, 5), ("a\x04b.x\x02", True, 2), ("\x04\x04", False, 1)]
    ruled = spark.createDataFrame(data, "s string, blocked boolean, n long")
    tests = ["aab.x/k", "zzz", "abq.y", "bb", "\x04\x03b", "b\x04" * 2000]

    def prob(counts, gram):
        p = 1 / urls.ALPHABET
        for k in range(1, urls.ORDER + 1):
            g = gram[-k:]
            after = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1] and n}
            if total := sum(after.values()):
                p = (after.get(g, 0) + len(after) * p) / (total + len(after))
        return p

    models = {}
    for kind in (True, False):
        models[kind] = {k: collections.Counter() for k in range(1, urls.ORDER + 1)}
        for s, b, n in data:
            padded = "\x02" * (urls.ORDER - 1) + s + "\x03"
            for i in range(urls.ORDER, len(padded) + 1):
                for k in range(1, urls.ORDER + 1):
                    models[kind][k][padded[i - k : i]] += n * (b == kind)
    got = {r["s"]: r["score"] for r in urls.scores(spark.createDataFrame([(t,) for t in tests], "s string"), ruled).collect()}
    for s in tests:
        padded = "\x02" * (urls.ORDER - 1) + s + "\x03"
        grams = [padded[i - urls.ORDER : i] for i in range(urls.ORDER, len(padded) + 1)]
        want = sum(np.log(prob(models[True], g) / prob(models[False], g)) for g in grams) / len(grams)
        assert abs(got[s] / urls.UNIT - want) < 1e-5


# --- 2: personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) if k == 2 else 0
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(digits) <= 19 and double % 10 == 0)) or (k == 3 and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+0123456789 ()%é", max_size=60))
def test_base_spans(text):
    assert [x[:3] for x in pii.base_spans(text)] == plain_spans(text)


def test_disclosure_against_brute_force(spark):
    random.seed(4)
    fill = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(12) for j in range(12)]
    docs = [(i, " ".join(random.choice(fill) for _ in range(20))) for i in range(60)]
    docs += [(100 + i, f"{' '.join(random.choice(fill) for _ in range(9))} zorblatt mail ann@corp.org of quixote {random.choice(fill)}") for i in range(5)]
    docs += [(120 + i, f"{random.choice(fill)} passkey is {random.getrandbits(160):040x}") for i in range(40)]
    docs += [(200 + i, f"quixote {random.choice(fill)} {i}") for i in range(3)] + [(300, docs[-1][1]), (301, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], pii.KINDS[s["kind"]], s["end"]) for s in r["all"]] for r in pii.find_spans(df).collect()}
    texts = {t or "" for _, t in docs}
    spans_of = {t: sorted((found := pii.base_spans(t)) + pii.secrets(t, found)) for t in texts}
    n_t, n_e, n_et = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        n_t.update(pii.terms(t))
        n_e.update(pii.entities(spans_of[t]))
        n_et.update((e, w) for e in pii.entities(spans_of[t]) for w in pii.terms(t))
    bits = {p: -np.log2((n + pii.PRIOR * n_e[p[0]] / len(texts)) / (n_t[p[1]] + pii.PRIOR)) for p, n in n_et.items()}
    told = {p: pii.KINDS.index("removed" if x <= pii.REMOVE else "generalised") for p, x in bits.items() if x <= pii.GENERALISE}
    assert told
    for i, t in docs:
        t = t or ""
        kinds = collections.defaultdict(int)
        for e in pii.entities(spans_of[t]):
            for w in pii.terms(t):
                kinds[w] = max(kinds[w], told.get((e, w), 0))
        want = {(a, pii.KINDS[k] if k < pii.BASE else "removed", b) for a, k, b, _ in spans_of[t]}
        want |= {(a, pii.KINDS[k], b) for a, k, b in pii.occurrences(t, [(x[0], x[2]) for x in spans_of[t]], {w: k for w, k in kinds.items() if k})}
        assert set(got[i]) == want
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "ann@corp.org" not in clean[100] and "<EMAIL>" in clean[100] and clean[301] is None
    assert not re.search("[0-9a-f]{40}|passkey", clean[120]) and "quixote" in clean[200]


def test_method_acts_on_documents(spark):
    """Spans of the method's own kinds come out over documents, and only in texts that hold something protected."""
    out = catalog.QUERIES["op2_disclosure_sanitisation"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    kinds = collections.Counter(x.split(":")[0] for r in out for x in r["spans"].split(",") if x)
    assert kinds["removed"] > 0 and kinds["generalised"] > 0
    for r in out:
        base = pii.base_spans(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == i for _, k, _, _ in base) for i in range(4))
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, _ in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert bool(r["spans"]) == bool(base or pii.secrets(texts[r["doc_id"]], base))


# --- 3: lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def blocks(words):
    """The bits of the heaviest word under each block's weights."""
    out = []
    for i in range(lines.BLOCKS):
        seed = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42)
        weigh = lambda w: xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(w.encode(), 42).to_bytes(8, "little"), seed) >> (1 + min(len(w), 16) // 2)  # noqa: E731, B023
        out.append(min(map(weigh, words)))
    return out


def brute_lines(docs):
    """Kept texts, by the definition: agreeing blocks, SimHash of distinct words, edit similarity, first occurrence by id and place."""
    norm = lambda s: s.strip(" ").lower()
    found = sorted({norm(x) for _, t in docs if t is not None for x in t.split("\n")} - {""})
    fp, block = {}, {}
    for s in found:
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in dict.fromkeys(s.split(" "))]
        fp[s] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        block[s] = blocks(set(s.split(" ")))
    parent = {s: s for s in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(found):
        for b in found[:i]:
            if sum(x == y for x, y in zip(block[a], block[b], strict=True)) >= lines.AGREE and bin(fp[a] ^ fp[b]).count("1") <= lines.MOST and edit(a, b) <= int(max(len(a), len(b)) * (1 - lines.SIMILAR) + 1e-9):
                parent[root(a)] = root(b)
    first = {}
    for i, t in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is not None, d[0])):
        for n, x in enumerate(t.split("\n")):
            if norm(x):
                first.setdefault(root(norm(x)), (i, n, t))
    return [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not norm(x) or first[root(norm(x))] == (i, n, t))) for i, t in docs]


@pytest.mark.parametrize("named", [0, 500_000])
def test_lines_against_brute_force(spark, monkeypatch, named):
    monkeypatch.setattr(lines, "NAMED", named)
    random.seed(3)
    base = [" ".join("".join(random.choices("abcdefgh", k=random.randint(3, 8))) for _ in range(random.randint(12, 40))) for _ in range(12)]

    def vary(s):
        w = s.split(" ")
        for _ in range(random.randint(0, 2)):
            k = random.randrange(len(w))
            w[k : k + 1] = random.choice([[], [w[k], "zz"], ["".join(reversed(w[k]))]])
        return " ".join(w)

    docs = [(i, "\n".join(vary(random.choice(base)) if random.random() < 0.7 else random.choice(["", "  ", "Same Short line", "same short line", f"own {i}"]) for _ in range(6))) for i in range(40)]
    docs += [(90, None), (91, ""), docs[3]]
    got = sorted(((r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == sorted(brute_lines(docs), key=str)


def test_wide_lanes(spark):
    words = [f"w{i}" for i in range(101)]
    rows = spark.createDataFrame([(1, 2, 9, w) for w in words], "h long, g long, len int, w string")
    got = [lines.lanes(rows, n).collect() for n in lines.WIDTHS]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert got[0] == got[1] == got[2] and got[0][0]["fp"] % 2**64 == fp and [got[0][0][f"m{i}"] for i in range(lines.BLOCKS)] == blocks(words)


def recall(pairs):
    """(lines' blocks and SimHash within MOST bits, plain SimHash within 3 bits): shares of the pairs that each finds."""
    own = small = 0
    for a, b in pairs:
        x, y = set(a.split(" ")), set(b.split(" "))
        agree = sum(i == j for i, j in zip(blocks(x), blocks(y), strict=True)) >= lines.AGREE
        fp = [[2 * sum(xxhash.xxh64_intdigest(w.encode(), 42) >> k & 1 for w in s) > len(s) for k in range(64)] for s in (x, y)]
        apart = sum(i != j for i, j in zip(*fp, strict=True))
        own += agree and apart <= lines.MOST
        small += apart <= 3
    return own / len(pairs), small / len(pairs)


def test_similarity_is_exact_at_any_length(spark, monkeypatch):
    """Against DuckDB's distance, by the distance itself and by the walk that long lines take."""
    random.seed(9)
    rows = []
    for _ in range(120):
        w = ["".join(random.choices("abcd", k=random.randint(1, 6))) for _ in range(random.randint(1, 60))]
        v = list(w)
        for _ in range(random.randint(0, 9)):
            k = random.randrange(len(v) + 1)
            v[k : k + random.randint(0, 1)] = random.choice([[], ["x"], ["".join(random.choices("abcd", k=3))], v[k : k + 1] * 2])
        rows.append((" ".join(w), " ".join(v)))
    con = connect(FOLDER)
    want = [con.execute("SELECT levenshtein(?, ?) <= floor(greatest(length(?), length(?)) * 0.1 + 1e-9)", [a, b, a, b]).fetchone()[0] for a, b in rows]
    assert 20 < sum(want) < 100
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i long, a string, b string")
    for direct in (lines.DIRECT, 0):
        monkeypatch.setattr(lines, "DIRECT", direct)
        assert [r[1] for r in sorted(df.select("i", lines.similar("a", "b")).collect())] == want


def test_similarity_of_near_lines_costs_less_than_their_distance(spark):
    """Lines of some 1400 letters with three words changed: the walk says yes, so no distance is computed."""
    random.seed(4)
    rows = []
    for i in range(600):
        w = ["".join(random.choices("abcdefgh", k=6)) for _ in range(200)]
        v = list(w)
        for k in random.sample(range(200), 3):
            v[k] = "other"
        rows.append((i, " ".join(w), " ".join(v)))
    df = spark.createDataFrame(rows, "i long, a string, b string").repartition(4).cache()
    df.count()

    def took(condition):
        best = 1e9
        for _ in range(3):
            t = time.perf_counter()
            assert df.where(condition).count() == len(rows)
            best = min(best, time.perf_counter() - t)
        return best

    assert took(lines.similar("a", "b")) < 0.6 * took(F.call_function("levenshtein", "a", "b", F.lit(139)) >= 0)


def test_crowd_of_unlike_lines_lists_few_pairs(spark, monkeypatch):
    """Three hundred lines that share three long words and little else meet in one bucket."""
    random.seed(2)
    crowd = ["incomprehensibilities counterrevolutionary electroencephalograph " + " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(9)) for _ in range(300)]
    counted, real = [], lines.verified

    def verified(pairs, fps, nodes):
        counted.append(pairs.count())
        return real(pairs, fps, nodes)

    monkeypatch.setattr(lines, "verified", verified)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(crowd)], "doc_id long, text string")
    assert lines.dedup_lines(docs).where("text <> ''").count() == 300
    assert sum(counted) <= 10 * len(crowd)


def test_recall_of_lines(spark):
    """Lines of sf0.01 that share three words in a row and are similar, by DuckDB's own distance, against near_links."""
    con = connect("/root/testdata/sf0.01")
    con.execute("CREATE TABLE l AS SELECT DISTINCT lower(trim(x)) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> ''")
    con.execute("CREATE TABLE s AS SELECT DISTINCT line, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT line, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM (SELECT line, string_split(line, ' ') AS w FROM l))")
    con.execute("CREATE TABLE p AS SELECT DISTINCT a.line AS a, b.line AS b FROM s a JOIN s b ON a.t = b.t AND a.line < b.line AND abs(length(a.line) - length(b.line)) <= floor(greatest(length(a.line), length(b.line)) * 0.1 + 1e-9)")
    pairs = con.execute("SELECT a, b FROM p WHERE levenshtein(a, b) <= floor(greatest(length(a), length(b)) * 0.1 + 1e-9)").fetchall()
    assert len(pairs) > 100
    own, small = recall(pairs)
    assert own >= 0.95 and small < 0.5
    df = spark.createDataFrame(pairs, "line_a string, line_b string")
    assert df.where(lines.similar("line_a", "line_b")).count() == len(pairs)
    found = spark.createDataFrame([(i, x) for i, x in enumerate(sorted({x for p in pairs for x in p}))], "doc_id long, text string")
    kept = {r["text"] for r in lines.dedup_lines(found).collect()} - {""}
    group = {x: x for p in pairs for x in p}
    for a, b in pairs:
        low, high = sorted((group[a], group[b]))
        group = {k: low if v == high else v for k, v in group.items()}
    assert len(set(group.values())) <= len(kept) <= len(set(group.values())) + 0.1 * (len(group) - len(set(group.values())))


# --- 4: toxicity


def test_backoff_is_a_probability():
    s = np.random.default_rng(1).integers(0, 5, 4000).astype(np.uint8)
    grams = np.unique(toxicity.codes(np.r_[0, s, 0].astype(np.uint8), toxicity.SHORT))
    assert np.allclose(toxicity.backoff(grams).sum(axis=1), 1)


def test_models_against_brute_force(spark):
    rng = random.Random(5)
    data = [(" ".join("".join(rng.choices("abcd", k=rng.randint(2, 9))) for _ in range(30)), int(i % 3 == 0), i % 4 != 3) for i in range(24)]
    rows = spark.createDataFrame(data, "text string, toxic int, fit boolean")
    from skerry.llm.common import written

    got = [model() for model in toxicity.models(written(toxicity.count_grams(rows), "test-counts"))]
    pool, counts = collections.Counter(), {}
    for text, y, fit in data:
        s, _ = toxicity.symbols([text])
        pool.update(toxicity.codes(s, toxicity.SHORT).tolist())
        for k in toxicity.ORDERS:
            for kind in ("fit", "all") if fit else ("all",):
                counts.setdefault((kind, k, y), collections.Counter()).update(toxicity.codes(s, k).tolist())
    lower = toxicity.backoff(np.array(sorted(pool)))
    for kind, known in zip(("fit", "all"), got, strict=True):
        for k in toxicity.ORDERS:
            own = [counts[kind, k, 1], counts[kind, k, 0]]
            d = [toxicity.discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for c in own]
            some = rng.sample(sorted(set(own[0]) | set(own[1])), 40)
            for g in some + [g ^ 3 for g in some[:20]]:
                logs = []
                for c, dd in zip(own, d, strict=True):
                    after = {x: n for x, n in c.items() if x >> 6 == g >> 6}
                    total, base = sum(after.values()), lower[(g >> 6) % 4096, g & 63]
                    if not sum(c.get(g, 0) for c in own):  # only the contexts' weights matter
                        logs.append(np.log(dd * len(after) / total) if total else 0.0)
                    else:
                        logs.append(np.log(max(c.get(g, 0) - dd, 0) / total + dd * len(after) / total * base if total else base))
                assert abs(known[k].of(np.array([g]))[0] - (logs[0] - logs[1])) < 2e-2


def test_tables_are_exact():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**54, 5000))
    table = toxicity.Table(keys, (np.arange(len(keys)) % 1000).astype(np.float16))
    assert (table.of(keys) == np.arange(len(keys)) % 1000).all()
    assert np.isnan(table.of(np.setdiff1d(rng.integers(0, 2**54, 5000), keys))).all() and np.isnan(toxicity.Table(keys[:0], np.zeros(0, np.float16)).of(keys)).all()


def test_rare_grams_are_pruned_to_the_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(4, i, i % 9, 1) for i in range(100)], "k int, gram long, t long, o long")
    monkeypatch.setattr(toxicity, "ORDERS", (4,))
    for bound, least in ((100, 1), (70, 4), (30, 8), (1, 16)):
        monkeypatch.setattr(toxicity, "GRAM_ROWS", bound)
        assert toxicity.least_counts(rows)[4] == least


def test_scores_do_not_depend_on_the_bound_of_grams(spark, monkeypatch):
    """Rare n-grams and contexts that aren't sent to tasks have their own ratios by joins."""
    folder = "/root/testdata/sf0.001"
    docs, labels, got = table(spark, folder, "documents"), table(spark, folder, "labels"), []
    odd = spark.createDataFrame([(-1, None), (-2, " \n"), (-3, "qzxj" * 4000 + " Zq\u00e9\u4e2d" * 30), (-4, "a")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd).union(docs.limit(3).select(-F.col("doc_id") - 10, "text"))
    for bound in (10**9, 300, 1):
        monkeypatch.setattr(toxicity, "GRAM_ROWS", bound)
        got.append({(r["doc_id"]): r["score"] for r in toxicity.score(docs, labels, "doc_id").collect()})
    assert len(got[0]) == docs.count() and len({round(x, 9) for x in got[0].values()}) > 100
    for other in got[1:]:
        assert set(other) == set(got[0]) and max(abs(other[i] - x) for i, x in got[0].items()) < 1e-9


def test_texts_are_sent_once_in_small_batches(spark, monkeypatch):
    folder, held, real = "/root/testdata/sf0.001", [], toxicity.measured

    def measured(*args, **named):
        held.append(int(spark.conf.get(toxicity.BATCH)))
        return real(*args, **named)

    monkeypatch.setattr(toxicity, "measured", measured)
    before = spark.conf.get(toxicity.BATCH)
    out = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", "text")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_text" not in plan
    assert len(held) == 2 and max(held) <= 1024 < int(before) and spark.conf.get(toxicity.BATCH) == before


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    out = catalog.QUERIES["op4_kneser_ney_toxicity"](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / n[0, 0] < 0.02
    assert out.where("score < 0 OR score > 1").count() == 0


# --- 5: chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="&<[|;ampltvers>]/ \n", max_size=12), min_size=1, max_size=5))
def test_escapes_are_reversible(texts):
    for t in texts:
        safe = t
        for raw, code in chat.ESCAPES:
            safe = safe.replace(raw, code)
        assert not set("<[|") & set(safe)
        for raw, code in reversed(chat.ESCAPES):
            safe = safe.replace(code, raw)
        assert safe == t


def test_examples(spark):
    rows = [(1, 0, "user", "a<|end|>"), (1, 1, "assistant", "[x]"), (1, 2, "user", None), (1, 3, "assistant", "y & z"), (2, 0, "user", "alone"), (None, 0, "assistant", "n")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {(r["conv_id"], r["example"]): r for r in chat.render(turns).collect()}
    assert set(out) == {(1, 2), (1, 4), (None, 1)}
    assert out[1, 2]["context"] == "<|turn:user|>a&lt;&vert;end&vert;><|end|><|turn:assistant|>" and out[1, 2]["target"] == "&lsqb;x]"
    whole = "".join(r["segment"] for r in turns.where("conv_id = 1").orderBy("place").collect())
    for r in chat.expand(turns).where("conv_id = 1").collect():
        assert whole[r["target_start"] : r["target_end"]] == r["target"] and whole[: r["target_start"]] == out[1, r["example"]]["context"]


# --- 6: sharding


def test_matrix_margins_and_law():
    counts, blocks = [5, 0, 17, 3, 11], np.array([9, 9, 9, 9])
    m = np.array([sharding.matrix_row(counts, blocks, p, 7) for p in range(5)])
    assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == blocks).all()
    draws = [sharding.matrix_row([2, 2], np.array([2, 2]), 0, s)[0] for s in range(3000)]
    share = np.bincount(draws, minlength=3) / 3000
    assert np.allclose(share, [1 / 6, 4 / 6, 1 / 6], atol=0.03)


def test_large_hypergeometric_follows_its_mean():
    rng = np.random.default_rng(0)
    x = [sharding.hypergeometric(rng, 2_000_000_000, 6_000_000_000, 10_000) for _ in range(200)]
    assert abs(np.mean(x) - 2500) < 20 and 30 < np.std(x) < 57


def test_shards_are_exact(spark):
    df = spark.range(1003).repartition(5).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shuffle_into_shards(df, 7, rows_per_block=40).collect()
    sizes = collections.Counter(r["shard"] for r in out)
    assert set(sizes.values()) == {143, 144} and len({r["doc_id"] for r in out}) == 1003
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))


def test_query_of_shards_against_its_documents(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, FOLDER, "documents").collect()}
    out = catalog.QUERIES["op6_sharding"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs) and {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    for r in out:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
    for shard in range(24):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(docs) // 24 + (shard < len(docs) % 24)))
    small = sharding.shuffle_into_shards(table(spark, FOLDER, "documents").select("doc_id", "text"), 3, bytes_per_block=20_000, scan=True).collect()
    assert sorted(collections.Counter(r["shard"] for r in small).values()) == sorted(len(docs) // 3 + (s < len(docs) % 3) for s in range(3))
    assert all(sorted(r["slot"] for r in small if r["shard"] == s) == list(range(sum(r["shard"] == s for r in small))) for s in range(3))


# --- 7: packing


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
@example("a <|endoftext|> b<|endoftext|><|endoftext|>\n <|endoftext")
@example("  x   <|endoftext|>   y  ")
def test_ids_are_those_of_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = test_ids_are_those_of_tokenizers.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    fast = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert fast.encode(text, allowed_special="all") == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), min_size=1, max_size=8))
def test_fullest_is_fullest(counts):
    longest = max(counts)
    reach = {longest}
    for x, n in counts.items():
        for _ in range(n - (x == longest)):
            reach |= {r + x for r in reach if r + x <= 32}
    found = packing.fullest(counts, 32)
    assert sum(found) == max(reach) and all(found.count(x) <= counts[x] for x in found)
    assert sum(t * sum(c) for c, t in packing.fill(counts, 32)) == sum(x * n for x, n in counts.items())


def test_packing(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, FOLDER, "documents")
    out = packing.pack_documents(docs).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in docs.select("doc_id", "text").collect():
        ids, at = [*tk.encode(text or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["piece"] == k and r["start"] == at and r["ids"] == part and r["ids_crc32"] == zlib.crc32(part) and (k == 0 or r["length"] == 1024)
            at += r["length"]
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(seq) <= 1.02 * -(-sum(r["length"] for r in out) // 1024) + 1


# --- 8: near copies


def brute_groups(fps, most):
    fps, parent = sorted(set(fps)), {}
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= most:
                parent[root(a)] = root(b)
    out = collections.defaultdict(set)
    for f in fps:
        out[root(f)].add(f)
    return {frozenset(s) for s in out.values() if len(s) > 1}


@pytest.mark.parametrize(("most", "parts", "dense"), [(2, 2, 64), (2, 2, 2), (3, 2, 4), (4, 3, 64), (1, 2, 64)])
def test_links_join_the_right_groups(spark, monkeypatch, most, parts, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(most * 10 + parts)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in list(fps[:20]):
        for _ in range(8):
            f ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, most + 1))})
            fps.append(f)
    fps = [f - (1 << 64) if f >> 63 else f for f in {*fps, 0, 2**64 - 1}]
    found, _ = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), most, parts)
    from skerry.llm.common import components

    groups = collections.defaultdict(set)
    for r in components(found).collect():
        groups[r["component"]].add(r["node"])
    assert {frozenset(g) for g in groups.values()} == brute_groups(fps, most)


def broadcast_operators(df):
    """Names of the operators below what the joins of a query would broadcast, by the plan Spark has before it runs."""
    below = lambda node: [node.getClass().getSimpleName(), *(x for i in range(node.children().size()) for x in below(node.children().apply(i)))]

    def walk(node):
        own = below(node.right() if node.buildSide().toString() == "BuildRight" else node.left()) if node.getClass().getSimpleName().startswith("Broadcast") else []
        return own + [x for i in range(node.children().size()) for x in walk(node.children().apply(i))]

    return set(walk(df._jdf.queryExecution().sparkPlan()))


@pytest.mark.parametrize(("most", "parts"), [(2, 2), (4, 3)])
def test_rows_made_of_fingerprints_are_not_broadcast(spark, monkeypatch, most, parts):
    """Spark takes probes, index entries and points for as small as the fingerprints they are made of."""
    seen, made, tallied = {}, simhash.written, common.tallied
    monkeypatch.setattr(simhash, "written", lambda df, name, **more: (seen.update({name: broadcast_operators(df)}), made(df, name, **more))[1])
    monkeypatch.setattr(simhash, "tallied", lambda df, name, **more: (seen.update({name: broadcast_operators(df)}), tallied(df, name, **more))[1], raising=False)
    monkeypatch.setattr(simhash, "DENSE", 4)
    rng = random.Random(3)
    fps = [(rng.getrandbits(63) & ~0xFF if i % 2 else i,) for i in range(200)]
    simhash.links(spark.createDataFrame(fps, "fp long"), most, parts)
    assert {"simhash-hits", "simhash-links"} <= set(seen)
    assert not any(re.search("Generate|Arrow", x) for names in seen.values() for x in names), seen


def test_written_tables_hold_few_uncounted_broadcasts(spark):
    """A table of 800 kB by Spark's estimate is shuffled where nothing counted its rows; a counted one is broadcast."""
    a, b = (spark.range(100_000).withColumnRenamed("id", "k").withColumn(c, F.lit(1)) for c in "xy")
    context, before = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for right, broadcast in ((b, False), (common.broadcast_if(b, 100_000, 99_999), False), (common.broadcast_if(b, 100_000, 100_000), True)):
        assert common.written(a.join(right, "k"), "joined").count() == 100_000
        context.listenerBus().waitUntilEmpty()
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
        assert ("BroadcastHashJoin" in [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and "Join" in p][-1]) == broadcast
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_unlike_fingerprints_of_a_crowd_stand_at_no_points(spark, monkeypatch):
    """Points, 2081 for each fingerprint at four bits, are for those only who meet many under blocks too."""
    stood, around = [], simhash.around
    monkeypatch.setattr(simhash, "partition_bits", lambda n, both, parts: [list(range(22)), list(range(22, 43)), list(range(43, 64))])
    monkeypatch.setattr(simhash, "allocate", lambda costs, most: np.tile(np.array([0, 1, 1], np.int8), (len(costs[0]), 1)))
    monkeypatch.setattr(simhash, "around", lambda fps, radius: (stood.append(fps.count()), around(fps, radius))[1])
    rng = random.Random(4)
    unlike = [rng.getrandbits(41) << 22 for _ in range(300)]
    family = [(1 << 62) ^ (1 << 22 + i) ^ (1 << 22 + j) for i in range(20) for j in range(i)]
    fps = [*unlike, *family, unlike[0] ^ (7 << 30)]
    found, crowd = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, 3)
    from skerry.llm.common import components

    groups = collections.defaultdict(set)
    for r in components(found).collect():
        groups[r["component"]].add(r["node"])
    assert {frozenset(g) for g in groups.values()} == brute_groups(fps, 4) and crowd.select("fp").distinct().count() == len(fps)
    assert stood == [len(family)]


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(2)
    costs = [rng.random((50, 4)).cumsum(axis=1) for _ in range(3)]
    got = simhash.allocate(costs, 3)
    assert (got.sum(axis=1) == 3 - 3 + 1).all()
    price = lambda r, t: sum(0 if x < 0 else costs[i][r, x] for i, x in enumerate(t))
    every = [(a, b, c) for a in range(-1, 4) for b in range(-1, 4) for c in range(-1, 4) if a + b + c == 1]
    assert all(price(r, got[r]) == pytest.approx(min(price(r, t) for t in every)) for r in range(50))


def test_fingerprints(spark):
    for text in ("a b c d E", "one two", "", None, "\t \n", "x", "É é É"):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) & (2**64 - 1) == want


def test_verified_groups(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = [(1, base), (2, base.replace("w50 ", "q50 ")), (3, base), (4, " ".join(f"v{i}" for i in range(200))), (5, None), (6, "")]
    out = {r["doc_id"]: r["component_id"] for r in simhash.groups(spark.createDataFrame(docs, "doc_id long, text string"), most=6, size=1, parts=3, similarity=0.8).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


# --- 9: media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 90_000))
def test_ogg_round_trip(data, n):
    payload = (data * (n // max(1, len(data)) + 1))[:n] or b" "
    back, facts = ogg.decode(ogg.encode(payload))
    assert back == payload and facts["duration_ms"] == len(payload) * 1000 // ogg.RATE


def test_ogg_damage_is_seen():
    media = bytearray(ogg.encode(b"abc" * 9000))
    for at in (5, 22, 27, 60, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.decode(bytes(bad))
    with pytest.raises(ValueError):
        ogg.decode(bytes(media[:-1]))
    assert ogg.checksum(b"123456789") == 0x89A1897F


# --- 10: leaks


def test_short_and_overlapping_items(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    items = [(1, " ".join(words)), (2, "Lone"), (3, "two words"), (4, "!!"), (5, None), (1, " ".join(words)), (None, "lone")]
    docs = [(1, f"x {' '.join(words).upper()} y"), (2, "lone, lone; two  words"), (3, "nothing"), (4, None), (5, " ".join(words[:9])), (2, "lone, lone; two  words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in out)
    assert got == [(1, 15, 13, 1), (2, 4, 4, 3), (2, 4, 4, 3), (3, 1, 0, 0), (4, 0, 0, 0), (5, 9, 0, 0)]
    assert [r["spans"] for r in out if r["doc_id"] == 1][0][0][:] == (1, 14)


# --- odd inputs, for all


def test_odd_inputs(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (5, 1), (6, 1), (8, 1), (None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "brown fox jumps over")], "item_id long, text string")
    n = odd.count()
    for docs, size in ((odd, n), (none, 0)):
        assert pii.find_spans(docs).count() == size and pii.sanitise(docs).count() == size
        kept = lines.dedup_lines(docs.withColumnRenamed("k", "K"))
        assert kept.count() == size and kept.columns == [*(c.replace("k", "K") if c == "k" else c for c in docs.columns), "_gone" if size else "gone"]
        assert not size or kept.agg(F.sum(F.col("K") + F.col("gone") + F.col("h"))).first()[0] == 0
        assert toxicity.score(docs, labels, "doc_id").count() == size and toxicity.score(docs, labels.limit(0), "doc_id").count() == size
        dealt = sharding.shuffle_into_shards(docs, 3)
        assert dealt.columns == [*docs.columns, *(("_shard", "_slot") if size else ("shard", "slot"))] and dealt.count() == size
        assert not size or dealt.agg(F.sum(F.col("_block") + F.col("shard"))).first()[0] == 0
        clean = pii.sanitise(docs.withColumnsRenamed({"h": "_h", "g": "_G", "k": "_all"}))
        assert clean.count() == size and (not size or {"_h", "_G", "_all"} <= set(clean.columns))
        assert packing.pack_documents(docs).groupBy("doc_id", "piece").count().agg(F.count_if(F.col("piece") == 0)).first()[0] == len({r[0] for r in docs.select("doc_id").collect()})
        assert simhash.groups(docs).count() == size and simhash.groups(docs, most=4, size=1, parts=3, similarity=0.8).count() == size
        back = ogg.decode_media(ogg.encode_texts(docs)).collect()
        assert len(back) == size and all(len(r["payload"]) % 192 == 0 and r["payload"] for r in back)
        assert decontaminate.contamination(docs, items).count() == size and decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    back = {r["doc_id"]: bytes(r["payload"]) for r in ogg.decode_media(ogg.encode_texts(odd)).collect()}
    assert back[7].rstrip(b" ") == "</s>[INST] & <|end|> | &amp; \u2028 \U0001f600".encode() and back[4] == b" " * 192
    digest = hashlib.sha256(b"".join(back[k] for k in (1, 2))).hexdigest()
    assert digest == hashlib.sha256(back[1] * 2).hexdigest()
