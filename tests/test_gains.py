import math
import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scribemend.operators import collocations as C
from scribemend.operators import gains as G
from scribemend.operators import ngrams as N
from scribemend.operators.tokens import with_tokens
from scribemend.session import made_paths, new_table_path
from scribemend.sources import models as M

ODD = ["a", "b", "c", "d", None, "", "x\u001fy", "\u001e", "\u001e3", "é"]


def texts(rng, count, words):
    return [[rng.choice(words) for _ in range(rng.randint(0, 12))] for _ in range(count)]


def brute_force(said, tokens, n):
    counts = Counter(tuple(t[i:i + k]) for t in said for k in range(1, n + 1) for i in range(len(t) - k + 1))
    v, total = sum(len(g) == 1 for g in counts), sum(map(len, said))
    score = 0.0
    for i, token in enumerate(tokens):
        one = (counts[(token,)] + 1) / (total + v)
        pair, triple = tuple(tokens[max(i - 1, 0):i + 1]), tuple(tokens[max(i - 2, 0):i + 1])
        p = one
        if n > 1 and i > 0 and (counts[pair] or (n == 2 and i > 1)):
            p = (counts[pair] + 1) / (counts[pair[:1]] + v)
        if n > 2 and i > 1 and counts[triple]:
            p = (counts[triple] + 1) / (counts[triple[:2]] + v)
        score += math.log(p)
    return score


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("limit", [0, 400, 1 << 20])
def test_scores_equal_brute_force_whatever_travels(spark, n, limit):
    rng = random.Random(n)
    said = texts(rng, 40, ODD)
    asked = [*texts(rng, 30, [*ODD, "new", "other"]), [], ["new"], ["a"]]
    model = N.train(spark.createDataFrame([(t,) for t in said], "tokens array<string>"), n)
    df = spark.createDataFrame([*enumerate(asked)], "id int, tokens array<string>")
    got = {r.id: (r.n_tokens, r.log_prob) for r in N.score_tokens(df, model, n, limit=limit).collect()}
    assert got.keys() == set(range(len(asked)))
    for k, tokens in enumerate(asked):
        assert got[k][0] == len(tokens) and got[k][1] == pytest.approx(brute_force(said, tokens, n), abs=1e-9)


def test_windows_that_no_gram_equals_stay_with_their_text(spark):
    """Scoring with triples stores and sends next to nothing for texts that the model does not know."""
    words = ["".join(random.Random(k).choices("abcdefgh", k=7)) for k in range(6000)]
    df = spark.createDataFrame([(k, words[k * 1500:(k + 1) * 1500]) for k in range(4)], "id int, tokens array<string>")
    model = N.train(spark.createDataFrame([(["one", "two", "three", "two"],)], "tokens array<string>"), 3)
    before = set(made_paths(spark))
    got = N.score_tokens(df, model, 3, limit=0).collect()
    assert [r.log_prob for r in got] == [pytest.approx(1500 * math.log(1 / 7))] * 4
    held = [f for path in set(made_paths(spark)) - before for f in Path(path.removeprefix("file:")).rglob("*.parquet")]
    assert sum(f.stat().st_size for f in held) < 20_000


def test_windows_travel_once_with_their_number(spark):
    table = N.gram_gains(N.train(spark.createDataFrame([(["a", "b", "a", "b"],)], "tokens array<string>"), 2), 2, 2, 4)
    path = new_table_path(spark, "gains")
    table.write.parquet(path)
    shared, others = G.shared_gains(spark.read.parquet(path), 0)
    assert others.count() == 4
    sizes, known, travel = G.text_gains(pa.array([G.JOINT.join("zaababz"), None, "a"]), 2, shared.value)
    assert sizes.tolist() == [7, 0, 1] and known.tolist() == [0, 0, 0]
    rows = {(t, g.replace(G.JOINT, ""), o, p) for level in travel for t, g, o, p in zip(*[x.tolist() for x in level], strict=True)}
    assert rows >= {(0, "a", 1, 3), (0, "b", 0, 2), (2, "a", 1, 0), (0, "ab", 0, 2), (0, "ba", 0, 1)}
    assert not any("z" in g for _, g, _, _ in rows)


def test_a_model_is_counted_once(spark, tmp_path):
    """Contexts and totals come from the saved grams: the texts are read by one write."""
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(["a", "b", "a"],), (["b", "a"],)], "tokens array<string>")
    model = M.train_model(df.mapInArrow(counting, "tokens array<string>"), 2, str(tmp_path / "m"))
    assert seen.value == 2
    plain = N.train(df, 2)
    for name in M.TABLES:
        assert sorted(map(str, getattr(model, name).collect())) == sorted(map(str, getattr(plain, name).collect()))


def test_local_scores_equal_brute_force(spark):
    rng = random.Random(8)
    said = texts(rng, 30, "abcdef")
    asked = [[], *texts(rng, 12, "abcdefgh"), ["h"]]
    model = N.train(spark.createDataFrame([(t,) for t in said], "tokens array<string>"), 2)
    df = spark.createDataFrame([*enumerate(asked)], "id int, tokens array<string>")
    got = {(r.id, r.term): r.log_prob for r in C.local_scores(df, spark.createDataFrame([("a",), ("h",)], "term string"), model, 2).collect()}
    assert got.keys() == {(k, t) for k in range(len(asked)) for t in "ah"}
    for (k, term), score in got.items():
        at = asked[k].index(term) if term in asked[k] else None
        near = asked[k] if at is None else asked[k][max(at - 3, 0):at + 4]
        assert score == pytest.approx(brute_force(said, near, 2), abs=1e-9)


def test_scoring_sends_no_text_by_its_id(spark):
    """No shuffle but that of the model's gains and the windows that travel: the tokens stay where they are."""
    df = with_tokens(spark.createDataFrame([(1, "a b c")], "id int, text string"))
    model = N.train(spark.createDataFrame([(["a", "b"],)], "tokens array<string>"), 2)
    plan = N.score_tokens(df, model, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "MapInArrow" in plan
    assert N.score_tokens(df, model, 2).select(F.round("log_prob", 6)).first()[0] == pytest.approx(
        round(brute_force([["a", "b"]], ["a", "b", "c"], 2), 6))
