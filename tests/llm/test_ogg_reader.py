"""Ogg files against a reader of their own, written from the format's description and sharing nothing with the operator."""

import hashlib
import struct
import zlib

import pytest

from skerry.llm import ogg
from skerry.session import table

FOLDER = "/root/testdata/sf0.001"


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def read(media, check=True):
    """{serial: [(packet, granule of the page it ends on, last of its page)]}"""
    out, part, at = {}, {}, 0
    while at < len(media):
        assert media[at : at + 4] == b"OggS" and media[at + 4] == 0
        granule, serial, number, crc = struct.unpack_from("<qIII", media, at + 6)
        table_ = media[at + 27 : at + 27 + media[at + 26]]
        end = at + 27 + len(table_) + sum(table_)
        if check:
            assert slow_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) == crc
        packets = out.setdefault(serial, [])
        body, first = at + 27 + len(table_), len(packets)
        for n in table_:
            part[serial] = part.get(serial, b"") + media[body : body + n]
            body += n
            if n < 255:
                packets.append([part.pop(serial), granule, False])
        if len(packets) > first:
            packets[-1][2] = True
        else:
            assert granule == -1
        at = end
    assert not part
    return out


def payload_of(streams):
    data = [[p for p, _, _ in streams[s][1:]] for s in sorted(streams)]
    return b"".join(d[i] for i in range(max(map(len, data))) for d in data if i < len(d))


@pytest.mark.parametrize("n", [1, 255, 3840, 3841, 65025, 200_001])
def test_another_reader_agrees(n):
    payload = bytes((i * i + 7 * i) % 251 for i in range(n))
    streams = read(ogg.encode(payload), n < 70_000)
    back, facts = ogg.decode(ogg.encode(payload))
    assert payload_of(streams) == payload == back
    for packets in streams.values():  # every page's position counts the samples of the stream's packets that end by then
        done = 0
        for i, (p, granule, last) in enumerate(packets):
            done += len(p) if i else 0
            assert not last or granule == done
    starts = []
    for i in range(max(map(len, streams.values())) - 1):
        for s in sorted(streams):
            if i + 1 < len(streams[s]):
                starts.append(sum(len(p) for p, _, _ in streams[s][1 : i + 1]) * 1000 // ogg.RATE)
    assert facts["starts_ms"] == starts and facts["peak"] == max(payload)
    mean = sum(payload) / n
    assert facts["mean"] == int(mean * 1000 + 1e-6) and abs(facts["deviation"] - 1000 * (sum((x - mean) ** 2 for x in payload) / n) ** 0.5) <= 1


def test_wrong_positions_are_seen():
    media = bytearray(ogg.encode(b"abc" * 30_000))
    at = 0
    for _ in range(3):  # the third page is one of samples
        size = 27 + media[at + 26] + sum(media[at + 27 : at + 27 + media[at + 26]])
        page, begin, at = media[at : at + size], at, at + size
    page[6:14] = (int.from_bytes(page[6:14], "little") + 1).to_bytes(8, "little")
    page[22:26] = bytes(4)
    page[22:26] = ogg.checksum(bytes(page)).to_bytes(4, "little")
    media[begin:at] = page
    with pytest.raises(ValueError, match="granule"):
        ogg.decode(bytes(media))


def test_query_against_its_documents(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    rows = ogg.op9_ogg_media(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        payload = text + b" " * (max(1, -(-len(text) // 192)) * 192 - len(text))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        media = ogg.encode(payload)
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert payload_of(read(media, False)) == payload and r["feature"].startswith("codec=PCM8;streams=2;")
