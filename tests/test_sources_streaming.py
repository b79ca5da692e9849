"""Ingestion, connectors and streams."""

import csv
import http.server
import io
import json
import os
import random
import re
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skerry.session import table
from skerry.operators import monitoring
from skerry.sources import connectors, control, ingest, publishing
from skerry.sources.records import records
from skerry.streaming import events
from skerry.streaming.state import latency_ring, lease_states, with_state_store

FOLDER = "/root/testdata/sf0.001"


def test_csv_with_rejects_and_typing(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("case_id,amount,score,when\n00123,5,1.5,2026-01-01\n00124,,2,2026-01-02\nx,1,2,2026-01-01,more\n00125,7\n00126,9,3.25,2026-01-03\n".encode())
    out = ingest.parse_csv(spark, str(path))
    assert out.types == {"case_id": "string", "amount": "integer", "score": "float", "when": "string"}
    assert out.accepted.count() == 3 and out.rejected.count() == 2
    assert [tuple(r) for r in out.accepted.orderBy("case_id").collect()][:2] == [("00123", 5, 1.5, "2026-01-01"), ("00124", None, 2.0, "2026-01-02")]
    assert sorted(r["reason"] for r in out.rejected.collect()) == ["expected 4 fields, got 2", "expected 4 fields, got 5"]


def test_detection():
    assert ingest.detect_delimiter("a;b;c,d") == ";" and ingest.detect_delimiter("a") == ","
    assert ingest.detect_encoding(b"\xef\xbb\xbfa,b") == "utf-8-sig" and ingest.detect_encoding("é,b,ccc".encode()) == "utf-8"
    assert ingest.detect_encoding("مرحبا,bcd".encode("cp1256")) == "cp1256"
    assert ingest.detect_format("a.csv", b"a,b") == "csv"
    assert ingest.detect_format("a", b"PK\x03\x04") == "xlsx" and ingest.detect_format("a", b"a,b") == "csv"
    with pytest.raises(ingest.Rejected):
        ingest.detect_format("a.pdf", b"%PDF")


def test_lines_are_read_once_for_all_that_follows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x\ny"\n2,z\n3,"a",b\n')
    got = ingest.parse_csv(spark, str(tmp_path / "a.csv"))
    for df in (got.accepted, got.rejected):  # neither folds lines nor cuts records again
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan and "Relation" in plan and "a.csv" not in str(df.inputFiles())
    assert sorted(map(tuple, got.accepted.collect())) == [("1", "x\ny"), ("2", "z")]
    assert [tuple(r)[1:] for r in got.rejected.collect()] == [(4, 5, "expected 2 fields, got 3")]


def test_policies(spark):
    rows = [(2, "1", "03/04/2026", "1", "1" * 21, "007", "2026-01-02", "1.5", ""), (3, "-2", "x", "2", "5", "8", "2026-01-03T01:00", "2", "")]
    names = ["amount", "x", "account_id", "n", "padded", "day", "rate", "empty"]
    types, issues = ingest.policies(spark.createDataFrame(rows, ["_line", *names]), names)
    assert types == {"amount": "integer", "x": "string", "account_id": "string", "n": "float", "padded": "string", "day": "string", "rate": "float", "empty": "string"}
    assert issues == ["x: day and month can't be told apart"]


def test_arabic_files_and_line_numbers(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_bytes(("name,n\n" + "".join(f"مرحبا,{i}\n" + "x\n" * (i % 500 == 9) for i in range(3000))).encode("cp1256"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = ingest.parse_csv(spark, str(path))
        assert {r[0] for r in out.accepted.select("name").distinct().collect()} == {"مرحبا"} and out.accepted.count() == 3000
        assert sorted(r["line"] for r in out.rejected.collect()) == [2 + i + i // 500 + 1 for i in range(9, 3000, 500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_over_lines_against_the_csv_module(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for k in range(40):
        text = "".join(rng.choice(['"', '"', "a", "b", ",", ",", "\n", "\n", "\r\n", '""', 'é', ';']) for _ in range(rng.randrange(1, 60)))
        text = re.sub("\r(?!\n)", "", text)
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        reader, rows, line = csv.reader(io.StringIO(text, newline="")), [], 0
        for n, row in enumerate(reader, 1):
            rows.append((n, line + 1, len(row)))
            line = reader.line_num
        want[f"{k}.csv"] = rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        lines = ingest.decoded_lines(spark, str(tmp_path), "utf-8")
        assert lines.select("file", "block").distinct().count() > 60
        got = records(lines, ",", 10**6).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {}
    for r in got:
        by.setdefault(r["file"].rpartition("/")[2], []).append((r["record"], r["physical_line"], r["cells"]))
    assert {k: sorted(v) for k, v in by.items()} == want


def test_quoted_line_breaks_over_many_splits(spark, tmp_path):
    path, rng = tmp_path / "q.csv", random.Random(4)
    rows = [[str(i), "".join(rng.choice(['x"', "\n", "\r\n", ",", "yy ", "é"]) for _ in range(rng.randrange(30))), "z"] for i in range(2000)]
    out = io.StringIO(newline="")
    writer = csv.writer(out, quoting=csv.QUOTE_ALL)
    writer.writerow(["row", "te\nxt", "end"])
    for i, row in enumerate(rows):
        writer.writerow([*row, "more"] if i % 500 == 7 else row)
    path.write_bytes((out.getvalue() + "\n" + '5,"never closed,\n\n' + "x" * 40000).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = ingest.parse_csv(spark, str(path))
        assert got.types == {"row": "integer", "te\nxt": "string", "end": "string"}
        assert {r[0]: r[1] for r in got.accepted.collect()} == {int(r[0]): r[1] for i, r in enumerate(rows) if i % 500 != 7}
        bad = sorted((r["line"], r["reason"]) for r in got.rejected.collect())
        assert bad == [*((i + 2, "expected 3 fields, got 4") for i in range(7, 2000, 500)), (2002, "expected 3 fields, got 0"), (2003, "expected 3 fields, got 2")]
        assert records(ingest.decoded_lines(spark, str(path), "utf-8"), ",", 100).where("value IS NULL AND record = 2003 AND cells = 2").count() == 1  # too long to bring together
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_formula_cells(spark):
    df = spark.createDataFrame([("a,=1+1",), ("a,=cmd|' /C calc'!A0",), ("x,-5",)], "value string")
    assert [r[0] for r in ingest.formula_cells(df).collect()] == ["a,=cmd|' /C calc'!A0"]


def test_revisions_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "set")
    with pytest.raises(ingest.Rejected):
        publishing.published(spark, folder)
    publishing.publish(spark.range(5), folder, 1, ("id",))
    with pytest.raises(publishing.Conflict, match="exist"):
        publishing.publish(spark.range(5), folder, 1)
    with pytest.raises(ingest.Rejected):
        publishing.publish(spark.range(5).select((F.col("id") % 2).alias("id")), folder, 2, ("id",))
    assert publishing.publish(spark.range(9), folder, 4)["previous"] == 1
    with pytest.raises(publishing.Conflict):
        publishing.publish(spark.range(9), folder, before=1)
    assert publishing.publish(spark.range(3), folder, before=4)["revision"] == 5
    assert [publishing.published(spark, folder, r).count() for r in (None, 1, 4)] == [3, 5, 9]
    assert publishing.revisions(spark, folder).agg(ingest.next_revision(None)).first()[0] == 6


def test_writers_at_once_never_share_a_revision(spark, tmp_path):
    folder, done, seen, stop = str(tmp_path / "set"), [], [], threading.Event()
    publishing.publish(spark.range(1), folder)

    def read():
        while not stop.is_set():
            _, said = publishing.newest(spark, folder)
            seen.append((said["revision"], publishing.published(spark, folder, said["revision"]).count(), said["row_count"]))

    def write(k):
        done.append((publishing.publish(spark.range(k), folder), k))

    reader = threading.Thread(target=read)
    reader.start()
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, range(2, 18)))
    stop.set()
    reader.join()
    assert sorted(d["revision"] for d, _ in done) == list(range(2, 18)) and all(d["row_count"] == k and d["previous"] == d["revision"] - 1 for d, k in done)
    assert all(a == b for _, a, b in seen) and [r for r, _, _ in seen] == sorted(r for r, _, _ in seen) and seen
    with ThreadPoolExecutor(6) as pool:  # all want the same number
        got = list(pool.map(lambda k: _outcome(lambda: publishing.publish(spark.range(k), folder, 30)), range(1, 7)))
    assert sorted(got)[:1] == ["30"] and got.count("conflict") == 5
    assert len([n for n in os.listdir(folder) if n.startswith("data-")]) == 18  # what lost is gone
    assert not [n for n in os.listdir(f"{folder}/_commits") if n.startswith(".") and not n.endswith(".crc")]


def _outcome(f):
    try:
        return str(f()["revision"])
    except publishing.Conflict:
        return "conflict"


def test_sweep_takes_what_no_commit_names(spark, tmp_path):
    folder = str(tmp_path / "set")
    publishing.publish(spark.range(4), folder)
    spark.range(3).write.parquet(f"{folder}/data-lost")  # a writer died here
    assert publishing.sweep(spark, folder) == [] and publishing.sweep(spark, folder, age=-5) == ["data-lost"]
    assert publishing.published(spark, folder).count() == 4


def test_control_tables_by_two_times(spark, tmp_path):
    folder, rng = str(tmp_path / "control"), random.Random(6)
    batches = [[(rng.randrange(30), rng.choice("abc"), rng.randrange(50), rng.random() < 0.2, 100 * b + i) for i in range(40)] for b in range(4)]
    batches += [[(1000, "z", 5, False, 1)]]
    schema, known, states = "k int, v string, at int, deleted boolean, place long", {}, []
    before = None
    for batch in batches:
        said = control.upsert(spark.createDataFrame(batch, schema), folder, ["k"], place="place", buckets=4)
        for k, v, at, gone, place in sorted(batch, key=lambda r: r[4]):
            known.setdefault(k, {})[at] = None if gone else v
        states.append({k: dict(v) for k, v in known.items()})
        if before and len(batch) == 1:  # one key changed: the other buckets' folders are those of before
            assert sum(said["buckets"][b] != p for b, p in before["buckets"].items()) == 1
        before = said
    for revision, state in enumerate(states, 1):
        for when in (0, 17, 49):
            want = {k: v[max(t for t in v if t <= when)] for k, v in state.items() if any(t <= when for t in v)}
            got = control.as_of(spark, folder, F.lit(when), revision).collect()
            assert sorted((r["k"], r["v"]) for r in got) == sorted((k, v) for k, v in want.items() if v is not None)
        newest = {k: v[max(v)] for k, v in state.items()}
        assert sorted((r["k"], r["v"]) for r in control.as_of(spark, folder, revision=revision).collect()) == sorted((k, v) for k, v in newest.items() if v is not None)
    versions = control.history(spark, folder).orderBy("k", "valid_from").collect()
    for a, b in zip(versions, versions[1:]):
        assert a["k"] != b["k"] and a["valid_to"] is None or a["valid_to"] == b["valid_from"] and (a["v"], a["tombstone"]) != (b["v"], b["tombstone"])
    with ThreadPoolExecutor(3) as pool:  # merges at once lose nothing
        list(pool.map(lambda k: control.upsert(spark.createDataFrame([(k, "t", 60, False, 1)], schema), folder, ["k"], place="place", buckets=4), (2001, 2002, 2003)))
    assert control.as_of(spark, folder).where("v = 't'").count() == 3
    assert publishing.sweep(spark, folder, age=-5) == []


def test_ring_and_leases_as_streams(spark, tmp_path):
    with_state_store(spark)
    t0, rng = datetime(2026, 1, 1), random.Random(8)
    beats = [(f"r{k}", t0 + timedelta(seconds=s), e) for k, steps in enumerate([[(0, "start"), (200, "beat"), (390, "done")], [(0, "start")], [(10, "start"), (400, "beat")], [(500, "start"), (700, "beat"), (900, "beat")], [(5, "beat")], [(2000, "start")]]) for s, e in steps]
    beats += [("clock", t0 + timedelta(seconds=s), "tick") for s in range(0, 2200, 100)]
    beats.sort(key=lambda r: r[1])
    for i in range(0, len(beats), 6):
        spark.createDataFrame(beats[i : i + 6], "run string, at timestamp, event string").coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
    source = spark.readStream.schema("run string, at timestamp, event string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs")).withWatermark("at", "0 seconds")
    got = {(r["run"], r["state"], (r["at"] - t0).total_seconds()) for r in events.drain(lease_states(source, 300), "leases", "append").collect()}
    assert got == {("r0", "validated", 390.0), ("r1", "failed", 300.0), ("r2", "failed", 310.0), ("r3", "failed", 1200.0)}
    runs = spark.createDataFrame([("r1", t0), ("r5", t0 + timedelta(seconds=2000))], "run string, started_at timestamp_ntz").withColumn("state", F.lit("validating"))
    late = monitoring.expired_leases(runs, t0 + timedelta(seconds=2100))
    assert {r["run"] for r in late.where("state = 'failed'").collect()} == {"r1"}  # as in batch

    rows = [(rng.choice("ab"), t0 + timedelta(seconds=i), float(rng.randrange(1000))) for i in range(60)]
    for i in range(0, 60, 15):
        spark.createDataFrame(rows[i : i + 15], "key string, at timestamp, ms double").coalesce(1).write.mode("append").parquet(str(tmp_path / "ms"))
    source = spark.readStream.schema("key string, at timestamp, ms double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ms"))
    told = events.drain(latency_ring(source, 10), "ring", "update").collect()
    for key in "ab":
        kept = sorted(m for k, _, m in rows if k == key)
        last = sorted([m for k, _, m in rows if k == key][-10:])
        assert (10, last[4], last[9], last[9]) in {(r["n"], r["p50"], r["p95"], r["p99"]) for r in told if r["key"] == key} and len(kept) > 10


def test_rest_stream_takes_each_record_once(spark, tmp_path):
    held, asked = [], []

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rpartition("page=")[2])
            asked.append(page)
            body = json.dumps({"rows": held[(page - 1) * 4 : page * 4]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def run():
        rows = connectors.rest_stream(spark, f"http://127.0.0.1:{server.server_port}/x", 4, records_path="rows")
        events.incremental(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(json.loads(r["record"])["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    try:
        held += [{"id": i} for i in range(10)]
        assert run() == list(range(10))
        held += [{"id": i} for i in range(10, 43)]
        assert run() == list(range(43)) == run()  # each run is a restart from the checkpoint
        held += [{"id": 43}]
        assert run() == list(range(44))
    finally:
        server.shutdown()


def test_watermark(spark):
    df = spark.createDataFrame([(1, "b"), (9, "a"), (10, "c")], "n long, s string")
    assert tuple(df.agg(ingest.watermark("n"), ingest.watermark("s")).first()) == ("10", "c")
    assert [r["n"] for r in ingest.after(df, "n", "1").collect()] == [9, 10]


def test_rest_source(spark, tmp_path):
    path = tmp_path / "page.json"
    path.write_text(json.dumps({"data": {"rows": [{"id": 1, "name": "a", "tags": {"x": 2}}, {"id": 2, "name": "b"}]}}))
    out = connectors.rest_rows(spark, f"file://{path}", records_path="data.rows")
    assert sorted((r["id"], r["name"]) for r in out.collect()) == [(1, "a"), (2, "b")]
    assert connectors.redacted({"url": "u", "auth": {"Token": "x"}}) == {"url": "u", "auth": {"Token": "***"}}


def test_stream_equals_batch(spark, tmp_path):
    source = table(spark, FOLDER, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.stream(spark, str(tmp_path / "in"), source.schema, late="100 days")
    got = events.drain(events.hourly(stream), "hourly_out")
    want = events.hourly(source)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_alert_states_stream(spark, tmp_path):
    rows = [("r", datetime(2026, 1, 1), "fire"), ("r", datetime(2026, 1, 2), "fire"), ("q", datetime(2026, 1, 1), "fire"), ("q", datetime(2026, 1, 2), "resolve")]
    df = spark.createDataFrame(rows, "rule_id string, at timestamp, event string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = events.drain(events.alert_states(stream), "states_out", "update")
    assert {r["rule_id"]: r["condition"] for r in out.collect()} == {"r": "active", "q": "recovered"}


def test_incremental_copy(spark, tmp_path):
    source = table(spark, FOLDER, "events")
    source.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = events.incremental(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()


def test_workbooks(spark, tmp_path):
    import zipfile

    from skerry.sources.workbook import parse_xlsx

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = [["Title"], ["id", "amount", "name"], ["1", "2.5", "x"], ["2", "3.5", ""], ["3", "4", "z"], []]
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if not v.replace(".", "").isdigit() else f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    out = parse_xlsx(spark, str(tmp_path / "a.xlsx"))
    assert out.types["amount"] == "float" and [r["amount"] for r in out.accepted.orderBy("amount").collect()] == [2.5, 3.5, 4.0]
    assert out.accepted.where("name IS NULL").count() == 1
    with pytest.raises(Exception, match="no sheet"):
        parse_xlsx(spark, str(tmp_path / "a.xlsx"), "none").accepted.count()


def test_parse_file_goes_by_content(spark, tmp_path):
    (tmp_path / "plain").write_text("id,name\n1,a\n2,b\n")
    got = ingest.parse_file(spark, str(tmp_path / "plain"))
    assert sorted(r["name"] for r in got.accepted.collect()) == ["a", "b"] and got.rejected.count() == 0
    (tmp_path / "x.exe").write_bytes(b"MZ")
    with pytest.raises(ingest.Rejected):
        ingest.parse_file(spark, str(tmp_path / "x.exe"))


def test_zones_keep_paths_inside():
    assert ingest.zone_path("/s/", "revisions", "t", 3, "a/b.parquet") == "/s/revisions/t/3/a/b.parquet"
    for parts in ((), ("..", "x"), ("a/../../x",), ("a\\..\\x",), ("", "x"), ("c:x",)):
        with pytest.raises(ingest.Rejected):
            ingest.zone_path("/s", "revisions", *parts)
    with pytest.raises(ingest.Rejected):
        ingest.zone_path("/s", "elsewhere", "x")


def test_outbox(spark, tmp_path):
    folder = str(tmp_path / "data")
    for k in (1, 2):
        publishing.publish(spark.range(k), folder, k)
    ingest.emit(spark, folder, "revision.published", 2, {"again": True})
    left = ingest.undelivered(publishing.messages(spark, folder), spark.createDataFrame([("revision.published:1",)], "id string")).collect()
    assert [(r["id"], r["revision"]) for r in left] == [("revision.published:2", 2)]
