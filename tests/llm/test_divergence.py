import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scribemend.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, item string, value int"


def brute(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups.add((lang, source))
        counts[lang, source].update(TERM.findall(lower))
        docs[lang].update(set(TERM.findall(lower)))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        others = sorted(g for g in groups if g[0] == lang)
        total = sum((counts[g] for g in others), Counter())

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        p = shares(counts[lang, source])
        pairs = []
        for other in others:
            if other[1] != source:
                q = shares(counts[other])
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other[1].encode()))
        q = shares(total)
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        out += [(lang, source, "pair", x.decode(), -v, k) for k, (v, x) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", x.decode(), -v, k) for k, (v, x) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def made(n, seed=3):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeXÉß日" for b in ["", "o", "Xx", "é", "日本"]]
    rows = [(i, " ".join(r.choice(words[:r.randint(2, 45)]) + r.choice(["", ".", "7", "_"]) for _ in range(r.randint(0, 30))),
             r.choice(["en", "de", "de", None]), r.choice(["s1", "s2", "s2", "s3", "S", "é", None])) for i in range(n)]
    rows += [(n, None, "en", "s9"), (n, "", "fr", "s1"), (n + 1, "once only", "fr", "s2"), (None, "a a a", "en", "s1"), *rows[:5]]
    return [*rows, (n + 2, "a Xo " * 20000, "en", "s1")]


def got(llm, rows, **how):
    given = llm.createDataFrame([(*r, None, 1) for r in rows], DOCS)
    out = divergence.audit(given, **how)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("block_bits", "tile"), [(2, 2), (12, 64)])
def test_like_brute_force(llm, block_bits, tile):
    rows = made(120)
    assert got(llm, rows, block_bits=block_bits, tile=tile) == brute(rows)


def test_few_ranks_and_kept_terms(llm):
    rows = made(60, seed=8)
    assert got(llm, rows, top=3, least_docs=5) == brute(rows, 5, 3)


def test_empty_tables(llm):
    assert got(llm, []) == []
    assert got(llm, [(1, None, None, None)]) == []
    assert got(llm, [(1, "x", "l", "a"), (2, None, "l", "b")]) == [("l", "a", "pair", "b", 0, 1), ("l", "b", "pair", "a", 0, 1)]


def test_runs_of_equal_counts_are_met_once(llm):
    """Thousands of terms of equal counts are a few runs in each column, and f is worked out once for each."""
    rows = [(i, " ".join(f"w{chr(0x4E00 + 7 * i)}{chr(0x4E00 + k)}" for k in range(1500)), "x", source)
            for i, source in enumerate(["a", "b", "a"]) for _ in range(3)]
    counts = divergence.stored(divergence.term_counts(llm.createDataFrame([(*r, None, 1) for r in rows], DOCS)), "counts")
    places = [r["place"] for r in divergence.ordered_vocabulary(counts).filter("total = 3").orderBy("place").collect()]
    assert len(places) == 4500
    assert got(llm, rows) == brute(rows)
    column = divergence._column(10, 90, 5, np.array([20, 40]), np.array([20, 10]), np.array([7, 9]))
    assert [x.tolist() for x in column] == [[10, 20, 40, 50], [5, 7, 9, 5]]
    other = divergence._column(10, 90, 4, np.array([10, 95]), np.array([15, 5]), np.array([6, 8]))
    assert [x.tolist() for x in other] == [[10, 25, 95], [6, 4, 8]]
    want = sum((p - q) ** 2 // q for p, q in zip([5] * 10 + [7] * 20 + [9] * 10 + [5] * 50, [6] * 15 + [4] * 70 + [8] * 5, strict=True))
    assert divergence.pair_sums({"a": column, "b": other}, [("a", "b")], 100)[0] == ("a", "b", want)
