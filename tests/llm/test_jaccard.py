import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scribemend.llm import jaccard

LOWER = jaccard.LOWER


def shingles(text, n):
    words = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def classes(rows, n, similarity):
    """Components by comparing all pairs."""
    sets = [(name, shingles(text, n)) for name, text in rows]
    above = {name: name for name, _ in sets if name is not None}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and Fraction(len(x & y), len(x | y)) >= similarity:
                low, high = sorted((root(a), root(b)))
                above[high] = low
    return sorted(((name, len(s), None if name is None else root(name)) for name, s in sets), key=str)


def corpus(seed, n):
    """Near copies of copies, shared passages, short texts and copies."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(40)]
    base = [[r.choice(words) for _ in range(r.randint(1, 60))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        text = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            text[r.randrange(len(text))] = r.choice(words)
        if r.random() < 0.3:
            text = text + passage
        rows.append((i * 3 + 1, r.choice([" ", "\n"]).join(text)))
    base[0] = [r.choice(words) for _ in range(90)]
    for i in range(n // 3):  # one large group of near copies
        text = list(base[0])
        for _ in range(r.randint(0, 3)):
            text[r.randrange(len(text))] = f"n{r.randrange(1000)}"
        rows.append((5000 + i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("n", "similarity"), [(4, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_brute_force(documents, n, similarity):
    rows = [*corpus(n, 160), (2, None), (5, ""), (8, "  \n"), (11, "One two"), (14, "one TWO"), (17, "one"), (None, "one two"), (None, None),
            (20, "é " * 3), (23, "É " * 3), (26, "x " * 5000), (29, "x " * 4000), (11, "one two three four five six"), (32, "one two three four five six")]
    got = sorted((tuple(r) for r in jaccard.linked(documents(rows), n, similarity).collect()), key=str)
    assert got == classes(rows, n, similarity)


def test_one_of_each(documents):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "other words are these here"), (None, "a b c d e f g h"), (4, None)]
    docs = documents(rows)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 2, 4, None]
    assert jaccard.linked(documents([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 25), min_size=1), st.sets(st.integers(0, 25), min_size=1), st.integers(1, 4), st.permutations(range(26)))
def test_prefixes_share_enough(x, y, k, order):
    """The lemma: similar sets share k shingles in the prefixes that the two sizes need."""
    similarity = Fraction(4, 5)
    both = len(x & y)
    if Fraction(both, len(x | y)) < similarity:
        return
    overlap = -(-similarity.numerator * (len(x) + len(y)) // (similarity.numerator + similarity.denominator))
    k = min(k, overlap)
    heads = [set(sorted(s, key=order.index)[:len(s) - overlap + k]) for s in (x, y)]
    assert len(heads[0] & heads[1]) >= k
    assert all(len(s) - overlap + k <= jaccard.prefix_length(len(s), k, similarity) for s in (x, y))


def test_components(llm):
    links = [(1, 2), (2, 3), (9, 8), (3, 4), (8, 7), (20, 4), (30, 31)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in jaccard.components(llm.createDataFrame(links, "a long, b long")).collect()}
    want = {**dict.fromkeys([1, 2, 3, 4, 20], 1), **dict.fromkeys([7, 8, 9], 7), 30: 30, 31: 30, **{100 + i: 100 for i in range(31)}}
    assert got == want


def test_the_cheapest_k_is_chosen():
    counts = np.ones(44, np.float32)
    assert jaccard.choose_matches(counts, 200, Fraction(4, 5)) == 1
    counts[40] = 1e5  # one long list in every prefix: few partners are in another list, too
    assert jaccard.choose_matches(counts, 200, Fraction(4, 5)) == 2
    counts[41:] = 1e9  # but a longer prefix would read a huge list
    assert jaccard.choose_matches(counts, 200, Fraction(4, 5)) == 1


def test_a_doc_id_of_several_texts(documents):
    def words(name, at=None):
        return " ".join("changed" if i == at else f"{name}{i}" for i in range(60))
    rows = [(1, words("a")), (5, words("a")), (5, words("b")), (9, words("b", 59)), (7, words("c")), (7, None), (3, words("c", 59)),
            (7, words("d")), (20, words("d")), (21, words("e")), (None, words("a"))]
    docs = documents(rows)
    got = sorted((tuple(r) for r in jaccard.linked(docs).collect()), key=str)
    assert got == classes(rows, 4, Fraction(85, 100))
    assert {(d, c) for d, _, c in got if d in (1, 5, 9)} == {(1, 1), (5, 1), (9, 1)}
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[5], rows[6], rows[7], rows[9], rows[10]], key=str)


def sentence_texts(n, seed=5):
    """Texts of seven of fourteen sentences: they share much and are rarely linked."""
    r = random.Random(seed)
    sentences = [[f"s{i}x{j}" for j in range(9)] for i in range(14)]
    return [(i, " ".join(w for s in r.sample(sentences, 7) for w in s)) for i in range(n)]


def test_cells_and_dealt_hubs_give_the_same_classes(documents, monkeypatch):
    from scribemend.llm import common

    rows = [*corpus(7, 120), *[(9000 + i, text) for i, text in sentence_texts(80)]]
    monkeypatch.setattr(jaccard, "CELL", 7)
    monkeypatch.setattr(common, "DEALT", 5)
    got = sorted((tuple(r) for r in jaccard.linked(documents(rows), 4, Fraction(85, 100)).collect()), key=str)
    assert got == classes(rows, 4, Fraction(85, 100))


@pytest.mark.parametrize("cell", [3, 4096])
def test_every_link(documents, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    n, similarity = 4, Fraction(85, 100)
    rows = [*corpus(9, 100), (2, None), (5, ""), (11, "One two"), (14, "one TWO"), (None, "one two")]
    pairs, members = jaccard.all_links(documents(rows), n, similarity)
    node = {r["doc_id"]: r["node"] for r in members.collect()}
    sets = {name: shingles(text, n) for name, text in rows if name is not None and shingles(text, n)}
    assert set(node) == set(sets)
    linked = {(a, b) for a in sets for b in sets if a != b and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= similarity}
    assert {tuple(r) for r in pairs.collect()} == {(node[a], node[b]) for a, b in linked if node[a] < node[b]}
    counts = {r["doc_id"]: r["n_links"] for r in jaccard.link_counts(documents(rows), n, similarity).collect()}
    assert counts == {a: sum(x == a for x, _ in linked) for a in sets}


def test_links_of_a_doc_id_of_several_texts(documents):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (9, "q r s t u v"), (9, "q r s t u v"), (11, "a b c d e f")]
    found = sorted((r["doc_id"], r["n_links"]) for r in jaccard.link_counts(documents(rows)).collect())
    assert [n for _, n in found] == [1, 2, 2, 2, 1] and [d for d, _ in found] == [5, 5, 9, 9, 11]
    assert jaccard.link_counts(documents([])).count() == 0


def test_batches_are_read_in_slices():
    """Texts become Python's strings about a slice at a time, in order and whole."""
    import pyarrow as pa

    from scribemend.llm.common import text_slices

    texts = [b"x" * (k * 37 % 900) for k in range(400)] + [None, b"", b"y" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["doc_id", "text"])
    slices = list(text_slices(batch, "text", 4096))
    assert [t for some in slices for t in some.column("text").to_pylist()] == texts
    assert len(slices) > 20 and max(sum(len(t or b"") for t in some.column("text").to_pylist()) for some in slices[:-1]) <= 2 * 4096
    assert list(text_slices(batch.slice(0, 0), "text")) == []
