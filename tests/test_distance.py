import random

import pytest
from pyspark.sql import functions as F

from scribemend.functions import text as T


def edited(rng, a, letters, edits):
    b = list(a)
    for _ in range(edits):
        at, kind = rng.randint(0, len(b)), rng.random()
        if kind < 0.35:
            b.insert(at, rng.choice(letters))
        elif b:
            at = min(at, len(b) - 1)
            b[at:at + 1] = [] if kind < 0.7 else [rng.choice(letters)]
    return "".join(b)


def test_distances_by_diagonals_equal_those_by_bits():
    rng = random.Random(4)
    for k in range(3000):
        letters = rng.choice(["ab", "abcdefgh é", "日本語道岔a", "😀é日a"])
        a = "".join(rng.choices(letters, k=rng.randint(0, 120)))
        b = edited(rng, a, letters, rng.randint(0, 14))
        right = T.bit_distance(a, b)
        assert T.text_distance(a, b) == T.text_distance(b, a) == right
        assert T.near_distance(a, b, right) == right and (not right or T.near_distance(a, b, right - 1) is None)


def test_long_texts_with_few_edits_need_no_columns_of_bits(monkeypatch):
    monkeypatch.setattr(T, "bit_distance", lambda a, b: pytest.fail("every column was worked out"))
    a = "".join(random.Random(5).choices("abcdefghij ", k=40_000))
    b = a[:100] + "xx" + a[103:20_000] + "y" + a[20_000:-7] + a[-6:]
    assert T.text_distance(a, b) == 5 and T.text_distance(b, a) == 5


def test_edit_distance_of_columns(spark):
    a = "the station and the der " * 9
    rows = [(1, a, a.replace("the", "teh")), (2, a, "x" * 100), (3, a, None), (4, "", a), (5, "ab", "ba"), (6, a, a), (7, None, None)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r.id: r.d for r in df.select("id", T.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {1: 36, 2: T.bit_distance(a, "x" * 100), 3: None, 4: len(a), 5: 2, 6: 0, 7: None}


def test_modes_are_compared_by_exact_rates_of_long_texts(spark):
    from scribemend.operators import evaluate as E

    right = "der station and que " * 40
    df = spark.createDataFrame([(1, right, right.replace("and", "adn"), right[:-3])], "id int, correct string, raw string, layer1 string")
    rated = E.with_error_rates(df, "correct", {"raw": "raw", "layer1": "layer1"})
    long = rated.select("id", F.explode(F.array(*[F.struct(F.lit(x).alias("mode"), F.col(f"{x}_cer").alias("cer")) for x in ("raw", "layer1")])).alias("x"))
    row = E.mode_comparison(long.select("id", "x.mode", "x.cer"), ["raw", "layer1"]).first()
    assert (row.raw, row.layer1) == (80 / len(right), 3 / len(right))
    assert T.near_distance(right, right[:-3], 3) == 3
