import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scribemend.llm import bpe

CODER = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r'sa1!　\xa0\x1c\x85é²日")), max_size=60))
def test_like_the_library(text):
    assert CODER.encode(text).tolist() == KNOWN.encode_ordinary(text)
    assert CODER.decode(CODER.encode(text)) == text.encode()


@pytest.mark.parametrize("unit", ["a", "ab", "the", "et", "日本", " ", "1", "\n ", "!?"])
@pytest.mark.parametrize("times", [33, 500, 6000])
def test_long_matches(unit, times):
    text = unit * times
    assert CODER.encode(text).tolist() == KNOWN.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text("etaoin hrs", min_size=1, max_size=300), st.integers(0, 300))
def test_any_cut_joins(text, cut):
    """The monoid: codes of two halves give the codes of the whole, wherever the cut is."""
    data = text.replace(" ", "x").encode()
    a, b = data[:cut], data[cut:]
    assert CODER.joined(CODER.merged(a) if a else [], CODER.merged(b) if b else []) == CODER.merged(data)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r'sa1!　\xa0\x1c\x85é²日")), max_size=60))
def test_texts_join_at_every_place(text):
    """The monoid of texts: wherever a text is cut, the codes of both parts give those of the whole."""
    want = KNOWN.encode_ordinary(text)
    for cut in range(len(text) + 1):
        assert CODER.met(text, 0, cut, len(text), CODER.stretch(text[:cut]), CODER.stretch(text[cut:])).tolist() == want


@pytest.mark.parametrize("leaf", [1, 2, 5])
def test_small_leaves(monkeypatch, leaf):
    for name in ("LEAF", "STRETCH", "RUN"):
        monkeypatch.setattr(bpe, name, leaf)
    own = bpe.TreeEncoder(CODER.ranks, public_tokenizers.PATTERN)
    for text in ("It's  the\n\n 1st 日本語 test, isn't it?  " * 20, "antidisestablishmentarianism" * 9, "", "x", " "):
        assert own.encode(text).tolist() == KNOWN.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_every_given_text_is_joined(llm):
    """How often the method decides: each text is joined at one place or more, and most places need a window."""
    texts = [r["text"] or "" for r in llm.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own = bpe.TreeEncoder(CODER.ranks, public_tokenizers.PATTERN)
    for text in texts:
        before = own.joins
        assert own.encode(text).tolist() == KNOWN.encode_ordinary(text)
        assert own.joins - before >= max(min(1, len(text) // 2), len(text) // bpe.STRETCH - 1)
    assert own.windows > own.joins // 2 > 1000


def test_tables_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "PARTS", 3)
    monkeypatch.setattr(bpe, "MATCHES", 3)
    own = bpe.TreeEncoder(CODER.ranks, public_tokenizers.PATTERN)
    text = "one two three four five six seven one two"
    assert own.encode(text).tolist() == KNOWN.encode_ordinary(text)
    assert len(own.parts) <= 3


def test_a_worker_of_the_pipeline_holds_little(monkeypatch):
    """Its tables have a bound of their own, kept over tasks, and a batch is read in slices."""
    import corpus_pipeline

    passed = {}
    monkeypatch.setattr(bpe, "round_trip", lambda docs, **more: passed.update(more))
    corpus_pipeline.bpe_stage.__wrapped__(None, None, "")
    kept = passed["kept"]
    assert kept <= 100_000
    words = iter(range(10**9))
    batches = [pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(60)]), pa.array([" ".join(f"z{next(words):x}" for _ in range(1000)) for _ in range(60)])], ["doc_id", "text"])
               for _ in range(2)]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = bpe.encoder(path, public_tokenizers.PATTERN, kept)
    tracemalloc.start()
    try:
        out = [row for batch in bpe.round_trips(iter(batches), path, public_tokenizers.PATTERN, kept) for row in batch.to_pylist()]
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(out) == 120 and out[-1]["n_tokens"] == len(KNOWN.encode_ordinary(batches[1].column("text")[59].as_py()))
    assert 1000 < len(coder.parts) <= kept and len(coder.matches) <= kept
    assert held < 40_000_000
    sizes = [batch.num_rows for batch in bpe.round_trips([pa.RecordBatch.from_arrays([pa.array(["1"] * 5), pa.array(["a b " * 100_000] * 5)], ["doc_id", "text"])], path, public_tokenizers.PATTERN, kept)]
    assert sum(sizes) == 5 and max(sizes) < 5


def test_rows(documents):
    rows = [(1, "Hello  world"), (2, ""), (3, None), (None, "x"), (1, "Hello  world"), (2**60 + 1, "é" * 70000)]
    got = sorted(map(tuple, bpe.round_trip(documents(rows)).collect()), key=str)
    want = []
    for name, text in rows:
        ids = KNOWN.encode_ordinary(text or "")
        want.append((name, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_and_decode_tables(documents):
    codes = bpe.encoded(documents([(1, "a b"), (2, None)]))
    assert {r["doc_id"]: r["ids"] for r in codes.collect()} == {1: KNOWN.encode_ordinary("a b"), 2: []}
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decoded(codes).collect()} == {1: b"a b", 2: b""}
    assert bpe.round_trip(documents([])).count() == 0


def test_ids_are_little_endian():
    assert CODER.encode("hello").dtype == np.dtype("<i4")
