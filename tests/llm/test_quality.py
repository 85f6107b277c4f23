import math
import random
import zlib

import numpy as np
import pytest

from scribemend.llm import quality


def make(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(600)]
    docs, good = [], {}
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(8, 200))]
        good[i] = int(r.random() > 0.2)
        if not good[i]:
            text = r.choice([lambda t: [w + "###" for w in t], lambda t: [w.upper() + "!!" for w in t], lambda t: " | ".join(t).split(),
                             lambda t: [w for w in t[:5] for _ in range(30)]])(text)
        docs.append((i, " ".join(text)))
    return docs, good


@pytest.fixture(scope="module")
def case(documents, llm):
    docs, good = make(1500)
    known = [(i, q, 0) for i, q in good.items() if i % 2] + [(None, 0, 0), (1, None, 0), (99999, 0, 0)]
    extra = [(3000, None), (3001, ""), (None, "plain words only here"), (3002, docs[0][1] + " and more" * 60000), (3003, docs[0][1]), (3003, docs[0][1])]
    return documents(docs + extra), llm.createDataFrame(known, "doc_id long, quality int, toxic int"), docs, good


def test_held_out_accuracy(case):
    docs, labels, _, good = case
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 1506
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1500]
    assert sum(r["predicted"] == good[r["doc_id"]] for r in held) / len(held) > 0.97
    same = {r["score"] for r in rows if r["doc_id"] == 3003}
    assert len(same) == 1
    empty = {r["score"] for r in rows if r["doc_id"] in (3000, 3001)}
    assert len(empty) == 1 and 0.6 < empty.pop() < 0.95  # the share of label 1


def test_terms():
    found = quality.terms_of("ab ab AB\nab")
    pair = lambda a, b: quality.CLASSES * a + b
    want = {pair(0, 1): 3, pair(1, 28): 2, pair(28, 0): 1, pair(28, 26): 1, pair(26, 26): 1, pair(26, 29): 1, pair(29, 0): 1}
    for place, n in want.items():
        scale = quality.LETTERS if place == pair(0, 1) else 1.0
        assert found[place] == pytest.approx(scale * math.sqrt(n / 10))
    base = quality.CLASSES**2
    assert sorted(np.flatnonzero(found)) == sorted([*want, base + 4, base + quality.STEPS + 7, base + 2 * quality.STEPS + 2, len(found) - 1])
    assert found[-1] == pytest.approx(math.sqrt(1 / 4))
    assert not quality.terms_of(None).any() and not quality.terms_of(" \n").any()


def test_votes_like_a_loop(case):
    """Frequencies, cosines and votes against plain loops over the same latent base."""
    docs, labels, texts, _ = case
    model = quality.train(docs, labels, labelled=60, dimensions=12, nearest=5)
    assert model.vectors.shape == (60, 12) and set(model.labels) == {0.0, 1.0}
    having, n = quality.document_frequencies(docs)
    given = [r["text"] for r in docs.select("text").collect()]
    assert n == sum(bool((t or "").split()) for t in given)
    assert having.tolist() == sum((quality.terms_of(t) > 0).astype(int) for t in given).tolist()
    for (_, text), score in zip(texts[:80], model.scores([t for _, t in texts[:80]]), strict=True):
        terms = quality.terms_of(text)
        own = [sum(float(terms[i]) * model.base[i, k] for i in np.flatnonzero(terms)) for k in range(12)]
        size = math.sqrt(sum(x * x for x in own))
        cosines = [round(sum(a * b for a, b in zip(own, v, strict=True)) / size, 9) for v in model.vectors.tolist()]
        least = sorted(cosines)[-5]
        votes = [(c, y) for c, y in zip(cosines, model.labels, strict=True) if c >= least and c > 0]
        assert score == pytest.approx(sum(c * y for c, y in votes) / sum(c for c, _ in votes), abs=1e-6)


def test_latent_space_spans_the_singular_vectors():
    rows = np.random.default_rng(2).standard_normal((50, 30)).astype(np.float32) * np.linspace(3, 0.1, 30, dtype=np.float32)
    base = quality.latent_space(rows, np.ones(30), 4)
    want = np.linalg.svd(rows)[2][:4]
    assert np.linalg.norm(want @ base, axis=0) == pytest.approx(np.ones(4), abs=0.02)


def test_no_labels(documents, llm):
    none = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r)[2:] for r in quality.scored(documents([(1, "x"), (2, None)]), none).collect()] == [(0.5, 1)] * 2
    assert quality.scored(documents([]), none).count() == 0
    blank = documents([(i, None) for i in range(30)])
    assert {r["score"] for r in quality.scored(blank, llm.createDataFrame([(i, 0, 0) for i in range(30)], none.schema)).collect()} == {0.0}
