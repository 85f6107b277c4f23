import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scribemend.llm import dac
from scribemend.session import new_table_path

KNOWN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
KNOWN.encode_special_tokens = True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40), max_size=30), st.data())
def test_random_access(docs, data):
    codes = dac.Codes.of(dac.document_bytes(list(range(len(docs))), [np.array(d, np.uint32) for d in docs]))
    flat = [x for d in docs for x in d]
    assert codes.size == len(flat) and codes.documents(0, len(docs))[2].tolist() == [sum(map(len, docs[:i])) for i in range(len(docs) + 1)]
    assert [codes[i] for i in range(len(flat))] == flat
    a = data.draw(st.integers(0, len(flat)))
    b = data.draw(st.integers(a, len(flat)))
    assert codes.slice(a, b).tolist() == flat[a:b]


def test_long_levels():
    ids = np.random.default_rng(1).integers(0, 70000, 30000).astype(np.uint32)
    codes = dac.Codes.of(dac.document_bytes([5], [ids]))
    for i in (0, 1, 511, 512, 513, 29999):
        assert codes[i] == ids[i]
    assert (codes.slice(1000, 25000) == ids[1000:25000]).all()
    with pytest.raises(IndexError):
        codes[30000]


def test_damaged_files():
    data = dac.document_bytes([1], [np.array([1, 2], np.uint32)])
    with pytest.raises(ValueError):
        dac.Codes.of(b"x" * 40)
    with pytest.raises(ValueError):
        dac.Codes.of(data + b"1")


def test_written_and_read(documents, monkeypatch):
    rows = [(7, "Hello world"), (3, None), (5, ""), (3, "again  and\nagain"), (None, "no id"), (2**60 + 1, "ü" * 9000 + " <|endoftext|>")]
    got = {}
    for r in dac.ids_written_and_read(documents(rows)).collect():
        got[(r["doc_id"], r["start"])] = (r["n_tokens"], r["ids_crc32"])
    start, want = 0, {}
    for name, text in sorted(((n, t or "") for n, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*KNOWN.encode(text, add_special_tokens=False).ids, 2]
        want[(name, start)] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_files_are_rolled(documents, llm, monkeypatch):
    monkeypatch.setattr(dac, "FILE_IDS", 5)
    files = dac.write_ids(documents([(i, "one two three four") for i in range(20)]), new_table_path(llm, "rolled"))
    assert files.count() >= 1
    assert dac.read_ids(files).count() == 20
    assert dac.ids_written_and_read(documents([])).count() == 0


def test_queries_read_by_rank(documents, monkeypatch):
    """A directory whose ranks are wrong breaks the result: runs begin inside of files."""
    monkeypatch.setattr(dac, "RUN_DOCS", 3)
    docs = documents([(i, f"thing{i} " * (i * 40) + "über") for i in range(20)])
    right = sorted(map(tuple, dac.ids_written_and_read(docs).collect()))
    assert len(right) == 20 and [r[1] for r in right] == [sum(x[2] for x in right[:i]) for i in range(20)]
    data = dac.document_bytes([1, 2], [np.arange(3000, dtype=np.uint32), np.arange(3000, dtype=np.uint32)])
    codes = dac.Codes.of(data)
    assert codes.slice(3000, 6000).tolist() == list(range(3000))
    at = codes.levels[0].ranks_at
    broken = dac.Codes.of(data[:at] + bytes(8 * codes.levels[0].blocks) + data[at + 8 * codes.levels[0].blocks:])
    assert broken.slice(3000, 6000).tolist() != list(range(3000))


def test_ranks_matter_on_given_documents(llm, monkeypatch):
    """How often the directories decide: each run but the first one finds its second chunks by a rank."""
    ranks = []
    run = dac.Level.run
    monkeypatch.setattr(dac.Level, "run", lambda self, a, b: (out := run(self, a, b), ranks.append(out[2]))[0])
    texts = [r["text"] or "" for r in llm.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids = [np.array(KNOWN.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
    codes = dac.Codes.of(dac.document_bytes(list(range(len(ids))), ids))
    for at in range(0, len(ids), 100):
        bounds = codes.documents(at, min(at + 100, len(ids)))[2]
        assert codes.slice(bounds[0], bounds[-1]).tolist() == [int(x) for d in ids[at:at + 100] for x in d]
    assert sum(r > 0 for r in ranks) == len(range(0, len(ids), 100)) - 1 > 0


def test_new_words_are_encoded_as_lines_of_a_text():
    """The same ids as each part alone, by far fewer texts; parts that a line end might change go alone."""
    words = dac.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [f" w{k}x{end}" for k in range(300) for end in ("", ".", "'s", "9", "\u00e9", "\u9053\u3002")] + [" ", "", " a\nb", " \u00a0", " c\u2028", "first", " <|endoftext|>", " \ue000", "  "]
    given, each = [], words._each
    words._each = lambda some: given.extend(some) or each(some)
    assert words._ids(parts) == each(parts)
    assert words.line and len(given) < len(parts) / 10
    words.line = None
    assert words._ids(parts) == each(parts)
