import numpy as np
import pytest
from pyspark.sql import functions as F

from scribemend.llm import neighbours


def brute(ids, vectors, query, k):
    scores = (vectors * vectors[query]).sum(axis=1)
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[query]]
    return [(int(ids[j]), scores[j]) for j in order[:k]]


@pytest.fixture
def table(llm):
    def make(rows):
        return llm.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, rank string, score double")
    return make


def test_recall_over_several_blocks(table, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 3000)
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 32))
    vectors = (centres[r.integers(0, 40, 7000)] + 0.8 * r.standard_normal((7000, 32))).astype(np.float32)
    vectors *= r.uniform(0.5, 2.0, 7000).astype(np.float32)[:, None]  # norms differ: inner products, not angles
    ids = np.arange(7000)
    rows = neighbours.nearest(table([(int(i), v.tolist()) for i, v in zip(ids, vectors)]), F.col("vec_id") % 100 == 0).collect()
    got = {}
    for row in rows:
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    wide, hits = vectors.astype(np.float64), 0
    for q in range(0, 7000, 100):
        want = brute(ids, wide, q, 20)
        own = sorted(got[q])
        assert [x[0] for x in own] == list(range(1, 21))
        assert [-x[2] for x in own] == sorted(-x[2] for x in own)
        for _, v, s in own:
            assert s == pytest.approx(wide[q] @ wide[v], abs=1e-9)
        hits += len({x[1] for x in own} & {v for v, _ in want})
    assert hits / (70 * 20) >= 0.9


def test_ties_copies_and_unusable_vectors(table):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.5, 0.5]), (120, [0.0, 0.0]), (140, None), (160, [nan, 1.0]), (180, [inf, 1.0]),
                                                  (200, [None, 1.0]), (None, [1.0, 1.0]), (220, [1.0, 2.0, 3.0]), (20, [1.0, 0.0])]
    out = neighbours.nearest(table(rows), F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 100}
    assert got[20] == [(i, 1.0) for i in range(21) if i != 20]
    assert got[100] == [(i, 0.5) for i in range(20)]


def test_few_and_none(table):
    out = neighbours.nearest(table([(20, [1.0, 2.0]), (1, [1.0, 1.0])]), F.col("vec_id") % 20 == 0)
    assert [tuple(r) for r in out.collect()] == [(20, 1, 1, 3.0)]
    assert neighbours.nearest(table([]), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(table([(1, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_windows_grow_until_they_cover_all():
    vectors = np.random.default_rng(1).standard_normal((3000, 8))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    index = neighbours.Arrays(vectors, 1)
    far = np.full((2, 8), 100.0)  # no window of the first size holds anything
    assert all(len(found) >= 20 for found in index.candidates(far, 20))


def test_collisions_are_counted_on_either_side():
    vectors = np.random.default_rng(2).standard_normal((500, 4))
    index = neighbours.Arrays(vectors, 1)
    own = vectors[:3] @ index.directions
    marks = vectors @ index.directions
    for half in (0.1, 1.0, 5.0):
        low, high = index.windows(own, half)
        for j in range(3):
            want = (np.abs(marks - own[j]) <= half).sum(axis=1)
            assert (np.abs(index.collisions(low[j], high[j]) - want) <= 1).all()


def recall(table, vectors, step):
    rows = neighbours.nearest(table([(i, v.tolist()) for i, v in enumerate(vectors)]), F.col("vec_id") % step == 0).collect()
    got, wide, hits = {}, vectors.astype(np.float64), 0
    for row in rows:
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    for q in range(0, len(vectors), step):
        hits += len(got[q] & {v for v, _ in brute(np.arange(len(vectors)), wide, q, 20)})
    return hits / (20 * len(range(0, len(vectors), step)))


@pytest.mark.parametrize("longer", [1, 2, 3, 5, 10])
def test_recall_beside_a_few_long_vectors(table, longer):
    vectors = np.random.default_rng(7).standard_normal((6000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[[17, 4001]] *= longer
    assert recall(table, vectors.astype(np.float32), 100) >= 0.9


def test_norms_are_ranged_from_the_longest_down():
    assert neighbours.norm_ranges([(0, 8000), (9, 5), (7, 100), (-1, 7000), (-2, 1500)], 20) == [
        ([9, 7], 105), ([0, -1], 15000), ([-2], 1500)]
    assert neighbours.norm_ranges([], 20) == []


@pytest.mark.parametrize(("rows", "long"), [(500, 64), (2000, 64), (2000, 768)])
def test_small_blocks_and_long_vectors_use_the_index(rows, long):
    vectors = np.random.default_rng(8).standard_normal((rows, long))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    lifted = np.column_stack([vectors, np.zeros(rows)])
    found = list(neighbours.Arrays(lifted, 5).candidates(lifted[:20], 21))
    assert any(len(own) < rows for own in found)
    hits = 0
    for j, own in enumerate(found):
        best = np.argsort(-(vectors @ vectors[j]))[:21]
        hits += np.isin(best, own).sum()
    assert hits / (21 * 20) >= 0.9
