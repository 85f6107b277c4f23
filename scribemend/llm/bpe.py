"""Byte-level BPE by monoid tree reduction, and its decoding.

The codes of a text are a monoid.  A text is halved, wherever its middle falls, down to stretches of STRETCH characters, and at
least once; the codes of two neighbours are joined by encoding a window around the boundary anew.  The window grows
until what is outside of its rims is proven to stand: a match of the split pattern never holds a space after a
character that is none, so at such a place both neighbours have been cut, and nothing on one side depends on the other.

A match of the pattern is a tree of its own, with leaves of LEAF bytes, whose windows grow by tokens: a token sequence
is the encoding of its bytes exactly if every two neighbours in it are the encoding of their own bytes, because a merge
across a boundary would also happen between the two tokens alone.  So the pairs at both rims prove that nothing outside
can change.  Matches that a worker has met before are looked up.  Decoding joins the bytes of halves up the tree.

Null texts count as empty; texts of any length are encoded whole; each row stands for itself, repeated or not.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribemend.llm.common import as_text, keyed_as, ship_package, text_slices

#: Leaves of the trees: bytes of a match, characters of a text, ids to decode.  Up to FLAT bytes are merged without a heap.
LEAF, STRETCH, RUN, FLAT = 16, 1024, 1024, 32
#: Characters on either side of a boundary in the first window.
WINDOW = 16
#: Entries of a worker's two tables, of parts of texts and of matches of the pattern, and the longest part kept.
PARTS, MATCHES, KEPT_CHARS = 600_000, 600_000, 48
# Letters and numbers that Unicode 16 added (first and last code point).
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
               (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
               (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
               (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# The characters with the property White_Space.
SPACES = r"\x09-\x0d\x20\x85\xa0  -     　"


def _ranges(kind: str, more: list[tuple[int, int]], last: int) -> str:
    """A character class of the code points up to `last` whose category begins with `kind`."""
    found, first = [], None
    for code in range(last + 2):
        inside = code <= last and unicodedata.category(chr(code))[0] == kind
        if inside and first is None:
            first = code
        elif not inside and first is not None:
            found.append((first, code - 1))
            first = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found + [pair for pair in more if pair[1] <= last])


@functools.cache
def split_pattern(pattern: str, last: int = sys.maxunicode) -> re.Pattern:
    """The split pattern with its classes spelled out, since libraries differ in their Unicode versions.

    With a small `last` the classes are short and quick; they serve texts without higher code points.
    """
    letters, numbers = _ranges("L", NEW_LETTERS, last), _ranges("N", NEW_NUMBERS, last)
    spelled = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", SPACES), pattern)
    for name, chars in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{SPACES}]"), (r"\s", f"[{SPACES}]")):
        spelled = spelled.replace(name, chars)
    return re.compile(spelled)


ALL_PAIRS = [chr(code) + " " for code in range(0x3001) if chr(code).isspace()]
ASCII_PAIRS = [pair for pair in ALL_PAIRS if pair.isascii()]


class TreeEncoder:
    """Encodes and decodes whole texts by the ranks of a vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int | None = None):
        self.ranks = ranks
        self.most_parts, self.most_matches = (PARTS, MATCHES) if kept is None else (kept, kept)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.bytes_of}
        self.split_any, self.split_latin = split_pattern(pattern).findall, split_pattern(pattern, 0xFF).findall
        self.stands = functools.lru_cache(1 << 16)(self._stands)
        self.sizes = {rank: len(token) for rank, token in self.bytes_of.items()}
        self.joins = self.windows = 0  # boundaries of texts that were joined, and those where a window was encoded anew
        self.parts: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a stretch: the pair of the lowest rank is merged first, the left one of equals."""
        if len(data) > FLAT:
            return self._merged_long(data)
        ranks, none = self.ranks.get, len(self.ranks)
        tokens = [data[i:i + 1] for i in range(len(data))]
        pairs = [ranks(data[i:i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            lowest = min(pairs)
            if lowest == none:
                break
            i = pairs.index(lowest)
            tokens[i:i + 2] = [tokens[i] + tokens[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks(tokens[i] + tokens[i + 1], none)
            if i:
                pairs[i - 1] = ranks(tokens[i - 1] + tokens[i], none)
        return [self.ranks[token] for token in tokens]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same for windows that have grown, with the pairs in a heap."""
        ranks, size = self.ranks, len(data)
        following, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = [True] * size
        waiting = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, end = heapq.heappop(waiting)
            j = following[i] if alive[i] else size
            if j >= size or following[j] != end:
                continue
            alive[j], following[i] = False, end
            if end < size:
                before[end] = i
                if (rank := ranks.get(data[i:following[end]])) is not None:
                    heapq.heappush(waiting, (rank, i, following[end]))
            if (p := before[i]) >= 0 and (rank := ranks.get(data[p:end])) is not None:
                heapq.heappush(waiting, (rank, p, end))
        return [ranks[data[i:following[i]]] for i in range(size) if alive[i]]

    def _stands(self, left: int, right: int) -> bool:
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Codes of the bytes of both: only a window around the boundary is encoded anew."""
        if not left or not right:
            return left + right
        if self.stands(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            cut, rest = max(0, len(left) - width), min(len(right), width)
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[cut:] + right[:rest])))
            if (cut == 0 or self.stands(left[cut - 1], window[0])) and (
                    rest == len(right) or self.stands(window[-1], right[rest])):
                return left[:cut] + window + right[rest:]
            width *= 2

    def tree(self, data: bytes) -> list[int]:
        """Codes of one match of the split pattern."""
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        if len(data) <= LEAF:
            return self.merged(data)
        middle = len(data) // 2
        return self.joined(self.tree(data[:middle]), self.tree(data[middle:]))

    def split(self, text: str) -> list[str]:
        return self.split_latin(text) if text.isascii() or max(text) <= "\xff" else self.split_any(text)

    def codes(self, text: str) -> bytes:
        """Codes of a part of a text as little-endian numbers."""
        return b"".join([self.matches.get(m) or self.match(m) for m in self.split(text)])

    def part(self, text: str) -> bytes:
        """Codes of a space and what follows it."""
        found = self.codes(" " + text)
        remember(self.parts, text, found, self.most_parts)
        return found

    def match(self, text: str) -> bytes:
        found = np.array(self.tree(text.encode()), "<i4").tobytes()
        remember(self.matches, text, found, self.most_matches)
        return found

    def stretch(self, text: str) -> array:
        """Codes of a leaf of a text."""
        first, rest = cut_at_spaces(text)
        known = self.parts.get
        return array("i", self.codes(first) + b"".join([known(p) or self.part(p) for p in rest]))

    def halves(self, text: str, first: int, last: int) -> array:
        """Codes of text[first:last], as if it stood alone."""
        if last - first <= STRETCH:
            return self.stretch(text[first:last])
        middle = (first + last) // 2
        return self.met(text, first, middle, last, self.halves(text, first, middle), self.halves(text, middle, last))

    def met(self, text: str, first: int, middle: int, last: int, left: array, right: array) -> array:
        """Codes of text[first:last] from those of its two parts."""
        self.joins += 1
        start, end = last_cut(text, first, middle), next_cut(text, middle, last)
        if start == end:
            return left + right
        self.windows += 1
        # codes in the window: both parts have a boundary at its rims
        cut, size, sizes = len(left), len(text[start:middle].encode()), self.sizes
        while size > 0:
            cut -= 1
            size -= sizes[left[cut]]
        rest, size = 0, len(text[middle:end].encode())
        while size > 0:
            size -= sizes[right[rest]]
            rest += 1
        if text[start] == " ":  # no match reaches across a place between the rims: it is one part
            part = text[start + 1:end]
            return left[:cut] + array("i", self.parts.get(part) or self.part(part)) + right[rest:]
        return left[:cut] + self.stretch(text[start:end]) + right[rest:]

    def encode(self, text: str) -> np.ndarray:
        middle = len(text) // 2
        if not middle:
            return np.frombuffer(self.stretch(text), "<i4")
        return np.frombuffer(self.met(text, 0, middle, len(text), self.halves(text, 0, middle), self.halves(text, middle, len(text))), "<i4")

    def decode(self, codes: np.ndarray) -> bytes:
        """Bytes of the codes, halves concatenated up the tree."""
        tokens = list(map(self.bytes_of.__getitem__, codes.tolist()))

        def up(first: int, last: int) -> bytes:
            if last - first <= RUN:
                return b"".join(tokens[first:last])
            middle = (first + last) // 2
            return up(first, middle) + up(middle, last)

        middle = len(tokens) // 2
        return up(0, middle) + up(middle, len(tokens))

    def digits(self, codes: np.ndarray) -> bytes:
        return " ".join(map(self.names.__getitem__, codes.tolist())).encode()


def remember(known: dict[str, bytes], text: str, codes: bytes, most: int) -> None:
    """Keeps what is short in a table that starts anew when it is full."""
    if len(text) <= KEPT_CHARS:
        if len(known) >= most:
            known.clear()
        known[text] = codes


def last_cut(text: str, first: int, middle: int) -> int:
    """The last place up to `middle` that no match reaches across, or `first`, looked for in growing windows."""
    width, high = WINDOW, middle + 1
    while True:
        low = max(first, middle - width)
        at = text.rfind(" ", low + 1, high)
        while at > low:
            if not text[at - 1].isspace():
                return at
            at = text.rfind(" ", low + 1, at)
        if low == first:
            return first
        width, high = width * 2, low + 1


def next_cut(text: str, middle: int, last: int) -> int:
    """The first place from `middle` on that no match reaches across, or `last`, looked for in growing windows."""
    width, low = WINDOW, middle
    while True:
        high = min(last, middle + width)
        at = text.find(" ", low, high)
        while at >= 0:
            if not text[at - 1].isspace():
                return at
            at = text.find(" ", at + 1, high)
        if high == last:
            return last
        width, low = width * 2, high


def spaces_meet(text: str) -> bool:
    """Is there a space after another white-space character?"""
    return any(pair in text for pair in (ASCII_PAIRS if text.isascii() else ALL_PAIRS))


def cut_at_spaces(text: str) -> tuple[str, list[str]]:
    """Parts that the split pattern never reaches across: cut before each space that follows a character that is none.

    The first part, and the others without the space that they begin with.
    """
    if spaces_meet(text):
        first, *rest = re.split(r"(?<=\S)(?= )", text)
        return first, [part[1:] for part in rest]
    first, *rest = text.split(" ")
    return first, rest


@functools.cache
def encoder(path: str, pattern: str, kept: int | None = None) -> TreeEncoder:
    """One per worker, read where the executor has the file; it stays with its tables as long as the worker does."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return TreeEncoder(ranks, pattern, kept)


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of (doc_id, text)."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [coder.encode(t) for t in batch["text"]]})

    return keyed_as(docs, as_text(docs).mapInPandas(run, "doc_id string, ids array<int>"))


def decoded(codes: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes) of each row of (doc_id, ids)."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"],
                                "bytes": [coder.decode(np.asarray([] if ids is None else ids, "<i4")) for ids in batch["ids"]]})

    rows = codes.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    return keyed_as(codes, rows.mapInPandas(run, "doc_id string, bytes binary"))


def round_trips(batches: Iterator[pa.RecordBatch], path: str, pattern: str, kept: int | None = None) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of batches of (doc_id, text), a slice of the texts at a time."""
    coder = encoder(path, pattern, kept)
    for batch in batches:
        for some in text_slices(batch, "text"):
            sizes, ids_sha256, decoded_sha256 = [], [], []
            for text in some.column("text").to_pylist():
                ids = coder.encode(text)
                sizes.append(len(ids))
                ids_sha256.append(hashlib.sha256(coder.digits(ids)).hexdigest())
                decoded_sha256.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_sha256, pa.string()), pa.array(decoded_sha256, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, kept: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and decoded from its ids, in one pass.

    `kept` bounds each of a worker's two tables (else PARTS and MATCHES, about 160 MB); it never changes a result.
    """
    ship_package(docs.sparkSession)
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return round_trips(batches, path, pattern, kept)

    return keyed_as(docs, as_text(docs).mapInArrow(
        run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))
