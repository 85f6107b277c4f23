import collections
import re

import pytest

from scribemend.llm import mixing


def poured(sizes, weights, share, most):
    """Targets by pouring out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if target[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        full |= over


ROWS = [(i, "w " * (i % 37 + 1), "abcdefg"[i % 7 if i % 3 else 0]) for i in range(700)] + [
    (701, None, "a"), (702, "", None), (703, "one two", None), (None, "three four five", "b"), (900, "twice here", "a"), (900, "twice here", "a"), (704, "", "empty")]


@pytest.fixture(scope="module")
def mixed(documents):
    return mixing.mix(mixing.measured(documents(ROWS))).collect()


def test_targets_and_sums(mixed):
    size = collections.Counter()
    for _, text, source in ROWS:
        size[source] += len((text or "").split())
    target = poured(size, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    source_of = {n: s for n, _, s in ROWS}
    taken = collections.Counter()
    for r in mixed:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(mixed) == len(ROWS)
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6


def test_whole_epochs_come_first(mixed):
    for r in mixed:
        if r["source_size"]:
            assert r["taken"] >= int(r["target"] / r["source_size"]) * r["size"]


def test_reruns_agree(mixed, documents):
    again = mixing.mix(mixing.measured(documents(ROWS[::-1]).repartition(7))).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_better_documents_are_taken_first(llm):
    sizes = llm.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, 'a', 'b') as source", "10L as size", "if(id % 4 < 2, 8.0D, 1.0D) as weight")
    rows = mixing.mix(sizes, weights=(1.0,), share=0.5, most=1.0).collect()
    good = sum(r["taken"] for r in rows if r["doc_id"] % 4 < 2)
    assert good > 0.7 * sum(r["taken"] for r in rows)


def test_copies_of_documents(documents):
    docs = documents(ROWS)
    decisions = mixing.mix(mixing.measured(docs))
    out = mixing.mixed(docs, decisions)
    assert out.columns == docs.columns
    times = collections.Counter(r["doc_id"] for r in out.collect())
    for r in decisions.collect():
        if r["size"] and r["doc_id"] not in (900, None):
            assert times[r["doc_id"]] in (r["taken"] // r["size"], -(-r["taken"] // r["size"]))


def test_words_are_counted_without_a_list(documents):
    """A list of the words of a text is forty times its size and more, and fills the memory of an executor."""
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "\r\na\x0bb\x0c", "one  two\tthree", "\xa0", "a\xa0b", "a\u2003b c", "\x1c \x1f", "\x00 x", "日本 語 🙂 é", "x" * 5000 + " y" * 3000, "$1 \\ x"]
    docs = documents(list(enumerate(texts)))
    sizes = mixing.measured(docs)
    got = {r["doc_id"]: r["size"] for r in sizes.collect()}
    assert got == {i: len(re.findall("[^\\x20\\x09-\\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert "extract_all" not in sizes._jdf.queryExecution().optimizedPlan().toString()


def test_empty(documents):
    assert mixing.mix(mixing.measured(documents([]))).count() == 0
    assert mixing.mix(mixing.measured(documents([(1, None), (2, " ")]))).agg({"taken": "sum"}).first()[0] == 0
