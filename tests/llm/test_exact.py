import hashlib

from scribemend.llm import exact

BLANKS = " \t\n\x0b\x0c\r"


def norm(text):
    return "".join(c for c in text or "" if c not in BLANKS)


ROWS = [(1, "a b"), (2, "ab"), (3, "a\x0bb "), (4, "AB"), (5, None), (6, ""), (7, " \n"), (8, "long " * 30000), (9, "long" * 30000),
        (10, "x" * 70), (11, "x" * 64 + "yyyyyy"), (12, "a b"), (12, "a b"), (None, "z z"), (13, "zz"), (14, "ab"), (15, "nb\xa0sp"), (16, "nbsp"),
        (17, "only once"), (18, "a b  "), (19, "a  b ")]


def test_brute_force(documents):
    got = sorted((tuple(r) for r in exact.exact_copies(documents(ROWS)).drop("n_chars").collect()), key=str)
    want = []
    for name, text in ROWS:
        group = [(-len(t or ""), n is None, n or 0, n) for n, t in ROWS if norm(t) == norm(text)]
        best = min(group)
        want.append((name, best[3], len(group), (name, -len(text or "")) == (best[3], best[0]),
                     hashlib.sha256(norm(text).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_dropping_keeps_one_of_each_and_all_columns(documents):
    rows = [*ROWS, (20, "twin of itself"), (20, "twin of itself"), (None, "no id"), (None, "no id")]
    docs = documents(rows)
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    kept = [norm(r["text"]) for r in out.collect()]
    assert sorted(kept) == sorted({norm(t) for _, t in rows})
    assert exact.drop_copies(documents([])).count() == 0
    assert exact.exact_copies(documents([])).count() == 0


def test_hot_group(llm):
    docs = llm.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text", "null as source")
    rows = exact.exact_copies(docs)
    assert rows.filter("group_size = 1000 AND keep_id = 0").count() == 1000
    assert rows.filter("kept").count() == 2001
