import random
import zlib

import pytest

from scribemend.llm import toxicity


def make(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(3, 9))) for _ in range(800)]
    bad = ["grimble", "snorkfa", "snorkfe", "snorkfi", "vexlor"]
    docs, toxic = [], {}
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(3, 120))]
        toxic[i] = int(r.random() < 0.12)
        for _ in range(r.randint(1, 4) * toxic[i]):
            text.insert(r.randrange(len(text)), r.choice(bad).upper() if r.random() < 0.2 else r.choice(bad))
        docs.append((i, " ".join(text)))
    return docs, toxic


@pytest.fixture(scope="module")
def case(documents, llm):
    docs, toxic = make(2500)
    known = [(i, 1, t) for i, t in toxic.items() if i % 2] + [(None, 1, 1), (1, 0, None), (99999, 1, 0)]
    extra = [(3000, None), (3001, ""), (None, "clean words only"), (3002, "a " * 50000), (3003, docs[0][1]), (3003, docs[0][1])]
    return documents(docs + extra), llm.createDataFrame(known, "doc_id long, quality int, toxic int"), toxic


def test_held_out_accuracy(case):
    docs, labels, toxic = case
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == 2506
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] in (3000, 3001, 3002, None):
            assert r["predicted"] == 0
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 2500]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) / len(held) > 0.97
    assert sum(r["predicted"] for r in held if toxic[r["doc_id"]]) / sum(toxic[r["doc_id"]] for r in held) > 0.9


def test_stage_keeps_clean_documents_and_columns(case):
    docs, labels, toxic = case
    out = toxicity.without_toxic(docs, labels)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    clean = [i for i in toxic if not toxic[i]]
    assert sum(i in kept for i in clean) / len(clean) > 0.99
    assert {3000, 3001, 3002, None} <= kept


def test_no_examples(documents, llm):
    none = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.scored(documents([(1, "x"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert toxicity.scored(documents([]), none).count() == 0
    assert toxicity.scored(documents([(1, "x")]), llm.createDataFrame([(3, 1, 1)], none.schema)).count() == 1


def test_labels_of_the_held_out_fold_change_nothing(documents, llm):
    docs, toxic = make(400)
    table = documents(docs)
    given = [(i, 1, t) for i, t in toxic.items()]
    turned = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in toxic.items()]
    schema = "doc_id long, quality int, toxic int"
    one, two = (toxicity.train(table, llm.createDataFrame(rows, schema)).weights for rows in (given, turned))
    assert one == two


def test_risk_is_kept_from_going_below_zero():
    """Unlabelled texts without any positive: the corrected part would go negative; weights stay finite, scores in order."""
    rows, names = toxicity.feature_rows(["bad"] * 20 + ["good"] * 200)
    weights = toxicity.fit(rows[:20], rows[20:], names, 0.3)
    model = toxicity.Model(weights)
    bad, good = model.scores(["bad", "good"], {})
    assert bad > 0.5 > good
