"""Media columns: Ogg containers written from and read back into payload bytes.

encode() lays a payload of 8-bit samples into two logical streams of one physical Ogg stream; decode() verifies every
page's checksum, reassembles packets from lacing values, demultiplexes the streams and derives the start of every packet from
the granule position of the page it ends on: that position less the samples of the packets from this one on. A position that
doesn't follow from the samples so far, or one on a page where no packet ends, is an error.

Defined cases: a null text is empty; an empty text is one frame of spaces; equal texts give equal bytes; rows of an empty
table give an empty table; only the named columns are read, so extra columns with any name don't matter and are left out.
A damaged or truncated file makes decode() raise ValueError.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.session import table

FRAME = 192  # samples: payloads are padded to a multiple
PACKET = 20 * FRAME  # samples in a data packet
RATE = 8000  # samples a second
STREAMS = (1, 2)  # serial numbers; packets go to them in turn
CONTINUED, FIRST, LAST = 1, 2, 4  # page flags
NO_PACKET_ENDS = -1
HEAD = struct.Struct("<4sBBqIIIB")
IDENT = struct.Struct("<8sBII")
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, most significant bit first, no inversion) by way of zlib's mirrored one."""
    crc = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(MIRROR), "big")


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets: (bytes, granule position at its end). The first one has a page of its own."""
    out: list[bytes] = []
    lacing, body, granule, open_packet = bytearray(), [], NO_PACKET_ENDS, False

    def close(last: bool) -> None:
        nonlocal lacing, body, granule
        flags = CONTINUED * begins_open | FIRST * (not out) | LAST * last
        head = HEAD.pack(b"OggS", 0, flags, granule, serial, len(out), 0, len(lacing)) + lacing
        page = head + b"".join(body)
        out.append(page[:22] + checksum(page).to_bytes(4, "little") + page[26:])
        lacing, body, granule = bytearray(), [], NO_PACKET_ENDS

    begins_open = False
    for i, (data, ends) in enumerate(packets):
        at = 0
        for value in [255] * (len(data) // 255) + [len(data) % 255]:
            if len(lacing) == 255:
                close(False)
                begins_open = open_packet
            lacing.append(value)
            body.append(data[at : at + value])
            at += value
            open_packet = value == 255
        granule = ends
        if i == 0 or i == len(packets) - 1:
            close(i == len(packets) - 1)
            begins_open = False
    return out


def encode(payload: bytes) -> bytes:
    """One Ogg stream: packets of PACKET samples go to the logical streams in turn; granules count a stream's samples."""
    packets: dict[int, list[tuple[bytes, int]]] = {s: [(IDENT.pack(b"\x7fPCM8   ", 1, RATE, PACKET), 0)] for s in STREAMS}
    done = dict.fromkeys(STREAMS, 0)
    for k, at in enumerate(range(0, len(payload), PACKET)):
        s, data = STREAMS[k % len(STREAMS)], payload[at : at + PACKET]
        done[s] += len(data)
        packets[s].append((data, done[s]))
    pages = [_pages(s, packets[s]) for s in STREAMS]
    longest = max(map(len, pages))
    return b"".join(p[i] for i in range(longest) for p in pages if i < len(p))


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload and what the container says of it."""
    streams: dict[int, dict] = {}
    at = pages = 0
    while at < len(media):
        if len(media) < at + HEAD.size:
            raise ValueError("a page is cut off")
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(media):
            raise ValueError(f"no whole page at byte {at}")
        page = media[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError(f"the checksum of the page at byte {at} is wrong")
        if bool(flags & FIRST) == (serial in streams):
            raise ValueError(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, {"next": 0, "packets": [], "open": [], "starts": [], "granule": 0, "ended": False})
        if number != s["next"] or s["ended"] or bool(flags & CONTINUED) != bool(s["open"]):
            raise ValueError(f"stream {serial} has lost a page before byte {at}")
        s["next"] += 1
        body, known = at + HEAD.size + n, len(s["packets"])
        for value in lacing:
            s["open"].append(media[body : body + value])
            body += value
            if value < 255:
                s["packets"].append(b"".join(s["open"]))
                s["open"] = []
        done = s["packets"][known:]
        if (granule == NO_PACKET_ENDS) == bool(done):
            raise ValueError(f"stream {serial}: a granule position without a packet's end, or none with one, before byte {end}")
        if done:
            sizes = [len(p) if known + i else 0 for i, p in enumerate(done)]  # the first packet names the codec and has no samples
            if granule - s["granule"] != sum(sizes):
                raise ValueError(f"stream {serial}: the granule position before byte {end} doesn't fit its packets")
            s["starts"] += [granule - left for left in list(accumulate(reversed(sizes)))[::-1]]
            s["granule"] = granule
        s["ended"] = bool(flags & LAST)
        at, pages = end, pages + 1
    if not streams or not all(s["ended"] and not s["open"] for s in streams.values()):
        raise ValueError("a stream has no end")
    order = sorted(streams)
    name, _, rate, _ = IDENT.unpack(streams[order[0]]["packets"][0])
    data = [list(zip(streams[k]["starts"], streams[k]["packets"], strict=True))[1:] for k in order]
    turns = [d[i] for i in range(max(map(len, data))) for d in data if i < len(d)]
    payload = b"".join(p for _, p in turns)
    return payload, signal(payload) | {
        "codec": name.strip(b"\x7f ").decode(),
        "pages": pages,
        "packets": len(turns),
        "starts_ms": [start * 1000 // rate for start, _ in turns],
        "end_ms": [streams[k]["granule"] * 1000 // rate for k in order],
        "duration_ms": sum(streams[k]["granule"] for k in order) * 1000 // rate,
        "peak_ms": peak_time(payload, turns) * 1000 // rate,
    }


def signal(payload: bytes) -> dict:
    """Features of 8-bit samples: the largest, the mean and the deviation from it, in thousandths, and how often samples cross it."""
    samples = np.frombuffer(payload, np.uint8)
    if not len(samples):
        return {"peak": 0, "mean": 0, "deviation": 0, "crossings": 0}
    counts = np.bincount(samples, minlength=256)
    total, squares = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    above = samples > total // len(samples)
    spread = math.isqrt((squares * len(samples) - total**2) * 10**6) // len(samples)
    return {"peak": int(np.flatnonzero(counts)[-1]), "mean": total * 1000 // len(samples), "deviation": spread, "crossings": int(np.count_nonzero(above[1:] != above[:-1]))}


def peak_time(payload: bytes, turns: list[tuple[int, bytes]]) -> int:
    """The place of the first largest sample in its own stream's time, in samples."""
    at = payload.index(max(payload)) if payload else 0
    for start, packet in turns:
        if at < len(packet):
            return start + at
        at -= len(packet)
    return 0


def feature(facts: dict) -> str:
    """The facts as text; the packets' starts by their checksum, as there is one for each PACKET samples."""
    ends, starts = "/".join(map(str, facts["end_ms"])), zlib.crc32(",".join(map(str, facts["starts_ms"])).encode())
    return f"codec={facts['codec']};streams={len(facts['end_ms'])};pages={facts['pages']};packets={facts['packets']};end_ms={ends};duration_ms={facts['duration_ms']};starts_crc32={starts};" + ";".join(
        f"{k}={facts[k]}" for k in ("peak", "peak_ms", "mean", "deviation", "crossings")
    )


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each whole text as UTF-8, padded with spaces to a positive multiple of FRAME, in Ogg."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media = [encode(t.ljust(max(1, -(-len(t) // FRAME)) * FRAME)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(write, f"`{id_col}` {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id_col, n_bytes, media, payload, feature), each file verified and read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = [decode(m) for m in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p for p, _ in found], pa.binary()), pa.array([feature(x) for _, x in found])], [id_col, "n_bytes", "media", "payload", "feature"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", media_col).mapInArrow(read, f"`{id_col}` {kind}, n_bytes long, media binary, payload binary, feature string")


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as Ogg and read back; one narrow pass, no shuffle."""
    back = decode_media(encode_texts(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
