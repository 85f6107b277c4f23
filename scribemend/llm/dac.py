"""Token ids in files of directly addressable codes.

Ids are cut in chunks of 8 bits, lowest first.  Level 0 holds the first chunk of every id, level k the k-th chunk of
those ids that have one; a bitmap beside each level says which ids go on, and a rank directory (ones before every
512th bit) leads to their place in the next level.  Any id, or a run of ids, is read by
following the bits: of a file only the header, the run's chunks, its blocks of the bitmap and one rank a level are read.

File: MAGIC, then little-endian u32 levels, u64 ids, u64 documents; i64 doc_id and u64 start (in this file) of every
document, where the highest bit of the second stands for a null doc_id; for each level u64 size, the chunks, the
bitmap padded to 64 bytes, and one u64 of the rank directory for every 64 bytes of bitmap.

Documents lie in ascending doc_id order over all files (null first); rows that repeat a doc_id lie together, ordered
by text.  Null and empty texts have the end id alone.  A file ends at FILE_IDS ids, so that memory stays bounded.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribemend.llm.bpe import KEPT_CHARS, cut_at_spaces
from scribemend.llm.common import open_output, open_places, ship_package, stored
from scribemend.session import new_table_path

MAGIC = b"DACIDS01"
END_ID = 2
FILE_IDS = 4_000_000
#: Documents that are read by one look into a file.
RUN_DOCS = 512
PARTS = 1_200_000
#: Parts that are encoded as lines of one text.
LINES = 64
#: A letter, a digit, a mark and a character of another script at the end of a line: the line end must be an id of its own.
PROBES = [" a", " ab1", " ab.", " \u9053\u3002", " b"]
NULL_ID = 1 << 63
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """All levels of some ids."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        counts = ONES[bits].reshape(-1, 64).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])[:-1] if len(counts) else counts
        out.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u8").tobytes())
        if not more.any():
            return struct.pack("<I", len(out)) + b"".join(out)
        rest = rest[more] >> 8


class Level:
    """One level of a file: where its chunks, its bitmap and its rank directory begin."""

    def __init__(self, read: Callable[[int, int], bytes], at: int):
        self.read = read
        self.size = struct.unpack("<Q", read(at, 8))[0]
        self.blocks = -(-self.size // 512)
        self.chunks_at = at + 8
        self.bits_at = self.chunks_at + self.size
        self.ranks_at = self.bits_at + 64 * self.blocks
        self.end = self.ranks_at + 8 * self.blocks

    def run(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Chunks and bits of the ids first to last - 1, and how many before them go on: only their blocks are read."""
        chunks = np.frombuffer(self.read(self.chunks_at + first, last - first), np.uint8)
        block, end = first >> 9, -(-last // 512)
        bits = np.unpackbits(np.frombuffer(self.read(self.bits_at + 64 * block, 64 * (end - block)), np.uint8), bitorder="little")
        before = first - (block << 9)
        rank = struct.unpack("<Q", self.read(self.ranks_at + 8 * block, 8))[0] + int(bits[:before].sum())
        return chunks, bits[before:before + last - first].astype(bool), rank


class Codes:
    """An opened file, of which only what is asked for is read: `codes[i]` is one id, `codes.slice(a, b)` a run of them."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        """`read` gives (first byte, number of bytes) of a file of `size` bytes."""
        head = read(0, 24)
        if head[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.read = read
        self.size, self.docs = struct.unpack_from("<QQ", head, 8)
        at = 24 + 16 * self.docs
        (levels,), at = struct.unpack("<I", read(at, 4)), at + 4
        self.levels = []
        for _ in range(levels):
            self.levels.append(Level(read, at))
            at = self.levels[-1].end
        if at != size:
            raise ValueError(f"{size - at} bytes too many")

    @classmethod
    def of(cls, data: bytes) -> Codes:
        return cls(lambda at, size: data[at:at + size], len(data))

    def documents(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of documents first to last - 1, and which have no id: (doc_ids, null, bounds)."""
        names = np.frombuffer(self.read(24 + 8 * first, 8 * (last - first)), "<i8")
        more = min(last + 1, self.docs)
        marked = np.frombuffer(self.read(24 + 8 * self.docs + 8 * first, 8 * (more - first)), "<u8")
        bounds = (marked & np.uint64(NULL_ID - 1)).astype(np.int64)
        return names, (marked >= NULL_ID)[:last - first], bounds if more > last else np.append(bounds, self.size)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def slice(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1: at each level the ids that go on are found by the rank of the run's beginning."""
        out = np.zeros(last - first, "<u4")
        where = np.arange(last - first)
        for k, level in enumerate(self.levels):
            if not len(where):
                break
            chunks, bits, rank = level.run(first, last)
            out[where] |= chunks.astype("<u4") << np.uint32(8 * k)
            where = where[bits]
            first, last = rank, rank + len(where)
        return out


def document_bytes(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """A whole file."""
    sizes = np.array([len(x) for x in ids], np.uint64)
    starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes, dtype=np.uint64)])[:-1] if len(sizes) else sizes
    null = np.array([d is None for d in doc_ids], bool)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    total = int(sizes.sum())
    return b"".join([MAGIC, struct.pack("<QQ", total, len(ids)), names.tobytes(),
                     np.where(null, starts | np.uint64(NULL_ID), starts).astype("<u8").tobytes(),
                     pack(np.concatenate(ids) if ids else np.zeros(0, np.uint32))])


class Vocabulary:
    """The tokenizer with a bounded table of the parts that it has already encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        alone = [self._each([text])[0] for text in ("\n", *PROBES)]
        self.line = alone[0] if len(alone[0]) == 4 and self._each(["\n".join(PROBES)])[0] == alone[0].join(alone[1:]) else None

    def _each(self, parts: list[str]) -> list[bytes]:
        found = []
        for a in range(0, len(parts), 10_000):
            found += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts[a:a + 10_000], add_special_tokens=False)]
        return found

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of each part. Parts that begin with their only space are encoded as lines of one text, cut at the ids of the line ends."""
        plain = [k for k, part in enumerate(parts) if len(part.split()) == 1 and part[0] == " " and part.isprintable()] if self.line else []
        found: list = [None] * len(parts)
        groups = [plain[a:a + LINES] for a in range(0, len(plain), LINES)]
        for some, data in zip(groups, self._each(["\n".join([parts[k] for k in some]) for some in groups]), strict=True):
            ends = np.flatnonzero(np.frombuffer(data, "<u4") == np.frombuffer(self.line, "<u4")[0])
            if len(ends) + 1 == len(some):
                cuts = (4 * ends).tolist()
                for k, start, end in zip(some, [0, *[c + 4 for c in cuts]], [*cuts, len(data)], strict=True):
                    found[k] = data[start:end]
        rest = [k for k, own in enumerate(found) if own is None]
        for k, own in zip(rest, self._each([parts[k] for k in rest]), strict=True):
            found[k] = own
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts.  The pre-tokenizer never reaches across the cuts, so parts are encoded on their own."""
        known = self.known
        if len(known) > PARTS:
            known.clear()
        cut = [cut_at_spaces(text) for text in texts]
        parts = list(chain.from_iterable(rest for _, rest in cut))
        ids = list(map(known.get, parts))
        missing = [i for i, found in enumerate(ids) if found is None]
        new = list({parts[i] for i in missing})
        fresh = dict(zip(new, self._ids([" " + part for part in new]), strict=True))
        for i in missing:
            ids[i] = fresh[parts[i]]
        known.update((part, found) for part, found in fresh.items() if len(part) <= KEPT_CHARS)
        out, at = [], 0
        for first, (_, rest) in zip(self._ids([first for first, _ in cut]), cut, strict=True):
            out.append(np.frombuffer(first + b"".join(ids[at:at + len(rest)]), "<u4"))
            at += len(rest)
        return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of (doc_id, text) below `folder`; returns the stored list of files in the order of their documents.

    Columns: partition, number, file, n_ids, n_docs.  A file belongs to the result only if it is on the list, so files
    that a lost or repeated task left behind are never read.
    """
    ship_package(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, done = vocabulary(path), TaskContext.get().partitionId(), []
        names: list = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal names, ids, size
            if ids:
                file = f"{folder}/{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.dac"
                with open_output(file) as out:
                    out.write(document_bytes(names, ids))
                done.append((part, len(done), file, size, len(ids)))
            names, ids, size = [], [], 0

        for batch in batches:
            for first in range(0, len(batch), 500):
                some = batch.iloc[first:first + 500]
                for name, null, codes in zip(some["doc_id"], some["unnamed"], words.encode(some["text"].tolist()), strict=True):
                    names.append(None if null else int(name))
                    ids.append(np.append(codes, np.uint32(end_id)))
                    size += len(codes) + 1
                    if size >= FILE_IDS:
                        flush()
        flush()
        yield pd.DataFrame(done, columns=["partition", "number", "file", "n_ids", "n_docs"])

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"),
                       F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("unnamed").desc(), "doc_id").sortWithinPartitions(F.col("unnamed").desc(), "doc_id", "text")
    return stored(dealt.mapInPandas(run, "partition int, number int, file string, n_ids long, n_docs long"), "ids-files")


def placed(files: DataFrame) -> DataFrame:
    """The list of files with `first`, the ids of all files before: summed by partition first, then within each."""
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    parts = files.groupBy("partition").agg(F.sum("n_ids").alias("n")).select("partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("partition").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("own", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(parts, "partition").withColumn(
        "first", (F.col("base") + F.col("own")).cast("long")).drop("own", "base")


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document on a list of files, from the files.

    The runs of RUN_DOCS documents of all files are dealt over the tasks; each reads its part of a file by rank.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, own in batch.groupby("file", sort=False):
                with open_places(file) as (read, size):
                    codes = Codes(read, size)
                    for at, first, n_ids, n_docs in zip(own["at"], own["first"], own["n_ids"], own["n_docs"], strict=True):
                        if (codes.size, codes.docs) != (n_ids, n_docs):
                            raise ValueError(f"{file} holds {codes.size} ids of {codes.docs} documents, {n_ids} of {n_docs} were written")
                        names, null, bounds = codes.documents(at, min(at + RUN_DOCS, n_docs))
                        ids, sizes = codes.slice(bounds[0], bounds[-1]), np.diff(bounds)
                        ends = bounds - bounds[0]
                        yield pd.DataFrame({
                            "doc_id": pd.array(np.where(null, None, names), "Int64"), "start": bounds[:-1] + first, "n_tokens": sizes,
                            "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]})

    spread = files.sparkSession.sparkContext.defaultParallelism * 4
    runs = placed(files).select("file", "first", "n_ids", "n_docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(RUN_DOCS).cast("long"))).alias("at"))
    return runs.repartition(spread, "file", "at").sortWithinPartitions("file", "at").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_written_and_read(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    return read_ids(write_ids(docs, new_table_path(docs.sparkSession, "ids"), path, end_id))
