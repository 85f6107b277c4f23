"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, one frame per record.

A file begins with a skippable frame (magic 0x184D2A5D, u32 size) that holds the dictionary, raw or itself one
Zstandard frame; a file without it has no dictionary.  Every record is one frame of its own.  The reader decodes frame by
frame, so memory is bounded by the largest record, and checks the version line, the headers, Content-Length, the
end of the record and the payload digest; what is wrong raises ValueError with file and record.

Of pages with the same payload of REVISIT_BYTES or more, that with the smallest page_id is a response, the others are
revisit records without the payload.  Null html is an empty payload, a null url the target urn:page:<page_id>.  Pages
with a null page_id come last among equals.  Rows that repeat a page_id and its payload get the same kind of record.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.llm.common import attach, open_input, open_output, ship_package, stored
from scribemend.session import new_table_path

# Fixed values of the formats.
SKIPPABLE, FRAME = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
LEVEL = 3
CHUNK = 1 << 20
#: The dictionary is trained on so many pages at most, those of the smallest digests among pages up to SAMPLE_CHARS.
SAMPLES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 65_536, 65_536


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample; empty if the sample is too poor to train on."""
    able = pages.filter(F.length("html").between(1, SAMPLE_CHARS)).withColumn("h", F.xxhash64("html", F.lit(11)))
    drawn = able.select("h").orderBy("h").limit(SAMPLES)  # digests first, so that no text is sorted or gathered
    rows = able.join(F.broadcast(drawn), "h", "left_semi").dropDuplicates(["h"]).select("html").limit(SAMPLES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(r["html"].encode() for r in rows)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def target(url: str | None, page_id: int | None) -> str:
    """A header value: characters that would end the line, and spaces, are percent-encoded."""
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None,
                revisit: bool, date: str) -> bytes:
    named = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {target(url, page_id)} {digest}")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{named}>"),
               ("WARC-Date", date), ("WARC-Target-URI", target(url, page_id)), ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", REVISIT), ("WARC-Truncated", "length")]
        if refers is not None:
            headers.append(("Refers-To-Page-Id", str(refers)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record(headers, http if revisit else http + payload)


def first_pages(pages: DataFrame) -> DataFrame:
    """(digest, first_id, n) of payloads that several pages share; stored.  `pages` has digest, bytes and page_id."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), F.col("page_id").alias("id")))
    groups = (pages.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest")
              .agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1"))
    return stored(groups.select("digest", F.col("first.id").alias("first_id"), "n"), "first-pages")


def payload_digest(html: Column) -> Column:
    return F.sha2(F.coalesce(html, F.lit("")).cast("binary"), 256)


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes (page_id, url, html) as archives below `folder`; returns the stored list of files (file, records).

    Only files on the list belong to the result, so what a lost or repeated task left behind is never read.
    """
    ship_package(pages.sparkSession)
    learnt = pages.sparkSession.sparkContext.broadcast(dictionary(pages))
    facts = pages.select("page_id", payload_digest(F.col("html")).alias("digest"),
                         F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    rows = attach(rows, first_pages(facts), ["digest"], "n", F.col("page_id"))
    again = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("revisit", again).withColumn("html", F.when(again, F.lit(b"")).otherwise(F.col("html")))
    rows = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("first_id", F.col("first_id").cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, done, part = learnt.value, [], TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None,
                                          write_content_size=True, write_checksum=True)
        out, file, records, size = None, "", 0, 0
        for batch in batches:
            for p, url, html, digest, n, first, revisit in zip(*(batch[c] for c in (
                    "page_id", "url", "html", "digest", "bytes", "first_id", "revisit")), strict=True):
                if out is None:
                    file, records, size = f"{folder}/{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = open_output(file)
                    if words:
                        out.write(SKIPPABLE + struct.pack("<I", len(words)) + words)
                frame = packer.compress(page_record(p and int(p), url, bytes(html), digest, int(n), first and int(first), bool(revisit), date))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((file, records))
                    out = None
        if out is not None:
            out.close()
            done.append((file, records))
        yield pd.DataFrame(done, columns=["file", "records"])

    return stored(rows.select("page_id", "url", "html", "digest", "bytes", "first_id", "revisit").mapInPandas(
        run, "file string, records long"), "archives")


def read_frames(stream) -> Iterator[bytes]:
    """The records of an opened archive."""
    head = stream.read(8)
    rules = None
    if head[:4] == SKIPPABLE:
        (size,) = struct.unpack("<I", head[4:8])
        words = stream.read(size)
        if len(words) != size:
            raise ValueError("the dictionary frame is cut off")
        if words[:4] == FRAME:
            words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
        rules, head = zstandard.ZstdCompressionDict(words), b""
    opener = zstandard.ZstdDecompressor(dict_data=rules) if rules else zstandard.ZstdDecompressor()
    held, frame, parts = head, None, []
    while True:
        if not held:
            held = stream.read(CHUNK)
            if not held:
                break
        if frame is None:
            while 0 < len(held) < 4 and (more := stream.read(CHUNK)):
                held += more
            if held[:4] != FRAME:
                raise ValueError("no Zstandard frame where a record should begin")
            frame, parts = opener.decompressobj(), []
        parts.append(frame.decompress(held))
        held = b""
        if frame.eof:
            held, frame = frame.unused_data, None
            yield b"".join(parts)
    if frame is not None:
        raise ValueError("the last frame is cut off")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of a record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        raise ValueError("no WARC version line or header end")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"no header: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    if missing := [name for name in NEEDED if name not in headers]:
        raise ValueError(f"headers missing: {missing}")
    length = headers["content-length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length}, but {len(rest) - 4} bytes in the block")
    return headers, rest[:-4]


def page_row(data: bytes) -> tuple:
    """(page_id, url, bytes, digest, kind, refers_to, payload) of a record of a page; the payload of a response is checked."""
    headers, block = parse_record(data)
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^Content-Length: *(\d+)\r?$", http + b"\r")
    if not gap or not length:
        raise ValueError("no HTTP header in the block")
    size, digest, kind = int(length[1]), headers.get("warc-payload-digest", "").removeprefix("sha256:"), headers["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload is not what its length and digest say")
    page, refers = headers.get("page-id"), headers.get("refers-to-page-id")
    return (None if page is None else int(page), headers.get("warc-target-uri"), size, digest, kind,
            None if refers is None else int(refers), payload if kind == "response" else None)


COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows of all records of the listed files (file, records), with the payload if asked for."""
    ship_package(files.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["payload"] * payloads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, records in zip(batch["file"], batch["records"], strict=True):
                rows, count, held = [], 0, 0
                with open_input(file) as stream:
                    try:
                        for data in read_frames(stream):
                            row = page_row(data)
                            rows.append(row if payloads else row[:-1])
                            count, held = count + 1, held + (len(data) if payloads else 200)
                            if held > 8 << 20:
                                yield frame_of(rows, names)
                                rows, held = [], 0
                    except (ValueError, zstandard.ZstdError) as wrong:
                        raise ValueError(f"{file}, record {count}: {wrong}") from wrong
                if count != records:
                    raise ValueError(f"{file} has {count} records, {records} were written")
                if rows:
                    yield frame_of(rows, names)

    spread = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.repartition(spread, "file").mapInPandas(run, COLUMNS + ", payload binary" * payloads)


def frame_of(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for name in ("page_id", "refers_to", "payload_bytes"):
        out[name] = out[name].astype("Int64")
    return out


def archived(pages: DataFrame) -> DataFrame:
    """Every page written and read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    return read_archives(write_archives(pages, new_table_path(pages.sparkSession, "warc")))
