import hashlib
import io
import struct

import pytest
import zstandard

from scribemend.llm import warc
from scribemend.session import new_table_path

LONG = "<p>" + "some words here " * 20
ROWS = [(5, "http://a.b/c d\r\nX: y", LONG), (2, "http://a.b/2", LONG), (9, None, LONG + "é"), (7, "u", "short"), (8, "u", "short"),
        (1, "u", None), (3, "", ""), (None, "n", LONG), (None, "n", LONG + "other"), (2, "http://a.b/2", LONG), (2**60 + 1, "big", "x" * 300_000), (4, "w", LONG + "é")]


def page_table(llm, rows):
    return llm.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, bytes int, digest string")


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        first = min((p for p in same if p is not None), default=None)
        again = len(data) >= 100 and len(same) > 1 and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(llm):
    got = warc.archived(page_table(llm, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(ROWS)
    assert warc.archived(page_table(llm, [])).count() == 0


def test_payloads_dictionary_and_rolling(llm, monkeypatch):
    rows = [(i, f"http://h/{i}", f"<html><head><title>page {i}</title></head><body>" + f"<p>words {i * 7919 % 1000} and more</p>" * 40) for i in range(300)]
    files = warc.write_archives(page_table(llm, rows), new_table_path(llm, "warc-test"))
    read = {r["page_id"]: r for r in warc.read_archives(files, payloads=True).collect()}
    assert {i: bytes(r["payload"]).decode() for i, r in read.items()} == {i: h for i, _, h in rows}
    path = files.first()["file"].removeprefix("file:")
    with open(path, "rb") as file:
        head = file.read(8)
        size = struct.unpack("<I", head[4:])[0]
        words = file.read(size)
        assert head[:4] == warc.SKIPPABLE and zstandard.ZstdCompressionDict(words).dict_id() > 0
        assert file.read(4) == warc.FRAME


def packed(records, words=None, packed_dictionary=False):
    rules = zstandard.ZstdCompressionDict(words) if words else None
    body = b"".join(zstandard.ZstdCompressor(dict_data=rules).compress(r) for r in records)
    if words:
        held = zstandard.ZstdCompressor().compress(words) if packed_dictionary else words
        body = warc.SKIPPABLE + struct.pack("<I", len(held)) + held + body
    return body


def test_dictionary_may_be_compressed_and_raw():
    records = [warc.page_record(i, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), 7, None, False, "2020-01-01T00:00:00Z") for i in range(5)]
    words = b"WARC/1.1 Content-Type payload " * 20
    for data in (packed(records), packed(records, words), packed(records, words, True)):
        assert list(warc.read_frames(io.BytesIO(data))) == records


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_frames_over_chunks(monkeypatch, size):
    monkeypatch.setattr(warc, "CHUNK", size)
    records = [bytes([65 + i]) * (i * 50 + 1) for i in range(6)]
    assert list(warc.read_frames(io.BytesIO(packed(records, b"AAAA BBBB" * 10)))) == records


def test_damage_is_found():
    good = warc.page_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), 7, None, False, "2020-01-01T00:00:00Z")
    assert warc.page_row(good)[0] == 1
    for bad in (good[:-1], good.replace(b"payload", b"pAyload"), good.replace(b"WARC/1.1", b"WRAC/1.1"), good.replace(b"WARC-Date", b"WARC Date"),
                good.replace(b"WARC-Date: ", b"Other: "), good + b"x", b"", good.replace(b"\r\n\r\nHTTP", b"\r\nno colon\r\n\r\nHTTP")):
        with pytest.raises(ValueError):
            warc.page_row(bad)
    data = packed([good, good])
    for cut in (data[:-3], data + b"junk", b"junk" + data, warc.SKIPPABLE + struct.pack("<I", 99) + b"x"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_frames(io.BytesIO(cut)))
