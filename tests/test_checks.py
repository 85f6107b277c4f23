import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribemend.functions.entities import entities
from scribemend.functions.text import character_error_rate, edit_distance
from scribemend.operators import evaluate as E
from scribemend.operators import failures as X
from scribemend.operators import guard as G
from scribemend.operators import metrics as M


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_entities_with_values_and_offsets(spark):
    text = "G1023次经18号道岔进3道，K134+800限速60km/h，10:30"
    found = _one(spark, entities(F.lit(text)).alias("e")).e
    assert [(e.type, e.value) for e in found] == [("train", "1023"), ("switch", "18"), ("track", "3"), ("kilometer", "134800"),
                                                  ("speed", "60"), ("time", "10:30")]
    assert all(text[e.start:e.end] == e.text for e in found)


def test_guard(spark):
    row = _one(spark, G.guard(F.lit("18号道岔好了"), F.lit("16号道岔好了")).alias("a"), G.guard(F.lit("准备好了请注意"), F.lit("好")).alias("b"),
               G.guard(F.lit("3道好了"), F.lit("3道好了")).alias("c"))
    assert not row.a.passed and "18" in row.a.reason and not row.b.passed and row.c.passed


def test_clean_output(spark):
    row = _one(spark, G.clean_output(F.lit(" ```text\n好的\n``` ")).alias("a"), G.clean_output(F.lit("「好的」")).alias("b"),
               G.clean_output(F.lit("```好的")).alias("c"), G.clean_output(F.lit('"a"b"')).alias("d"))
    assert (row.a, row.b, row.c, row.d) == ("好的", "好的", "好的", 'a"b')


def test_merge_keeps_the_text_without_a_usable_answer(spark):
    base = spark.createDataFrame([(1, "3道好了"), (2, "3道好了"), (3, "3道好了"), (4, "abcdefg")], "id int, text string")
    refined = spark.createDataFrame([(1, "3道好了。"), (2, "4道好了"), (3, None), (4, "abcdefg abcdefg")], "id int, refined string")
    got = {r.id: (r.final, r.guard_passed) for r in G.merge_refined(base, refined).collect()}
    assert got == {1: ("3道好了。", True), 2: ("3道好了", False), 3: ("3道好了", False), 4: ("abcdefg", False)}


def test_failure_class_and_layer(spark):
    c = lambda a, b, e: X.failure_class(F.lit(a), F.lit(b), F.lit(e))
    row = _one(spark, c("3道好了", "4道好了", "3道好了").alias("a"), c("x", "x", "y").alias("b"), c("x", "z", "y").alias("c"), c("x", "y", "y").alias("d"))
    assert list(row) == [X.NUMBER_ALTERED, X.MISSED, X.OVER_CORRECTED, X.OTHER]
    def layer(*texts):
        return X.responsible_layer(F.lit("道差开通"), F.lit("道岔开通"), F.array(*[F.lit(t).cast("string") for t in texts]))
    row = _one(spark, layer("道差开通", "道岔开通", "道岔关", None).alias("a"), layer("道差开通", "道差开通", None, None).alias("b"),
               layer("道岔开通", None, None, None).alias("c"))
    assert list(row) == ["layer3", "layer4", "unknown"]


def test_error_rate_is_exact_far_apart(spark):
    rng = np.random.default_rng(1)
    rows = [("".join(rng.choice(list("ab道"), n)), "".join(rng.choice(list("ab道"), m))) for n, m in ((0, 0), (5, 0), (60, 90), (300, 200), (2, 2))]
    df = spark.createDataFrame(rows + [("道差", "道岔")], "a string, b string")
    for r in df.select("a", "b", edit_distance(F.col("a"), F.col("b")).alias("d"), character_error_rate(F.col("a"), F.col("b")).alias("c")).collect():
        row = list(range(len(r.b) + 1))
        for i, x in enumerate(r.a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(r.b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert r.d == row[-1]
        assert r.c == (row[-1] / max(len(r.a), len(r.b)) if r.a or r.b else 0)


def test_error_rates_of_very_long_texts(spark):
    """No time that goes with the square of a length: the matrix of this pair has 10 billion places."""
    right = "so the man said it to a lot of us " * 3200
    df = spark.createDataFrame([(right, right.replace("the", "teh"), right.replace("the", "teh"), ""), ("", "ab", "ab", "")],
                               "right string, raw string, one string, two string")
    start = time.monotonic()
    rated = E.with_error_rates(df, "right", {"raw": "raw", "one": "one", "two": "two"}).orderBy(F.desc("raw")).collect()
    assert time.monotonic() - start < 60
    assert [r.raw_cer for r in rated] == [r.one_cer for r in rated] == [1.0 if r.right == "" else 6400 / len(right) for r in rated]
    assert [r.two_cer for r in rated] == [0.0 if r.right == "" else 1.0 for r in rated]


def test_layer_is_kept_when_nothing_is_expected(spark):
    blame = X.responsible_layer(F.lit("abc"), F.lit(""), F.array(*[F.lit(t) for t in ("abc", "abcd", "", "")]))
    assert _one(spark, blame.alias("a"))[0] == "layer2"


def test_exact_percentiles_with_a_hot_series(spark):
    df = spark.range(0, 6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("s"),
                                     (F.pmod(F.xxhash64("id"), F.lit(997)) / 3).alias("v"))
    small = spark.createDataFrame([("one", 5.0)] + [("four", float(x)) for x in (1, 2, 3, 4)], "s string, v double")
    df = df.unionByName(small)
    got = {r.s: (r.p50, r.p95, r.p99) for r in M.exact_percentiles(df, "s", "v").collect()}
    values = {}
    for r in df.collect():
        values.setdefault(r.s, []).append(r.v)
    assert abs(got["four"][1] - 3.85) < 1e-9
    for s, v in values.items():
        assert np.allclose(got[s], np.percentile(v, [50, 95, 99]))


def test_latest_samples_across_salts(spark):
    df = spark.range(0, 500).select("id", F.lit("s").alias("s"), (F.col("id") * 7 % 500).alias("at"))
    got = {r.id for r in M.latest_samples(df, ["s"], [F.desc("at"), F.desc("id")], "id", 40).collect()}
    assert got == {k for k in range(500) if k * 7 % 500 >= 460}


def test_one_failing_prompt_loses_only_itself(spark):
    from scribemend.plans.prompts import refine_prompts

    def model(prompts):
        if any("7" in p for p in prompts):
            raise RuntimeError("no sevens")
        return [p.upper() for p in prompts]

    prompts = spark.createDataFrame([(k, f"p{k % 30}") for k in range(60)], "id int, prompt string")
    got = {r.id: (r.refined, r.error) for r in refine_prompts(prompts, model).collect()}
    assert got == {k: (None, "RuntimeError: no sevens") if "7" in f"p{k % 30}" else (f"P{k % 30}", None) for k in range(60)}


def test_rule_tables_of_any_size(spark):
    """5000 scene terms, collocation rules and syllable confusions: more than the old bounds."""
    from scribemend.operators import candidates as K
    from scribemend.operators import collocations as C
    from scribemend.operators import retrieval as R

    df = spark.createDataFrame([(1, "t17 x t4999 y"), (2, "none")], "id int, text string")
    scenes = spark.createDataFrame([(f"s{k % 2}", k % 2, k, f"t{k}") for k in range(5000)], "scene string, scene_no int, term_no int, term string")
    got, by_joins = ({(r.id, r.scene): r.matched for r in R.match_scenes(df, scenes, limit=k).collect()} for k in (R.INDEX_BYTES, 0))
    assert got == by_joins
    held = [f"t{k}" for k in range(5000) if f"t{k}" in "t17 x t4999 y"]
    assert {k: sorted(v) for k, v in got.items()} == {(1, f"s{p}"): sorted(t for t in held if int(t[1:]) % 2 == p) for p in (0, 1)}
    rules = spark.createDataFrame([(f"t{k}", "before", f"b{k}") for k in range(5000)], "term string, side string, word string")
    tokens = spark.createDataFrame([(1, ["b4000", "t4000", "t4001"])], "id int, tokens array<string>")
    assert {r.term: r.score for r in C.score_terms(tokens, rules).collect()} == {"t4000": 0.5, "t4001": 0.0}
    confusion = spark.createDataFrame([("whole", f"a{k}", f"b{k}") for k in range(5000)], "level string, src string, dst string")
    row = spark.createDataFrame([("a4321",)], "s string").select(K.confused_syllables(confusion, ("whole",))(F.col("s")).alias("v")).first()
    assert row.v == ["b4321"]


def test_every_reading_of_a_term_counts(spark):
    from scribemend.operators.candidates import fuzzy_pairs
    words = spark.createDataFrame([("w", ["a", "b", "c"])], "word string, syls array<string>")
    for rows in ([("t", ["a", "b", "x"]), ("t", ["q", "r", "s"])], [("t", ["q", "r", "s"]), ("t", ["a", "b", "x"])]):
        found = fuzzy_pairs(words, spark.createDataFrame(rows, "term string, syls array<string>")).collect()
        assert [(r.word, r.term, round(r.similarity, 2)) for r in found] == [("w", "t", 0.67)]


def test_refinement_goes_on_where_it_ended(spark):
    from scribemend.plans.prompts import resume_prompts
    from scribemend.session import new_table_path

    def failing(asked):
        if any("bad" in prompt for prompt in asked):
            raise ValueError("no answer")
        return [f"first {prompt}" for prompt in asked]

    path = new_table_path(spark, "answers")
    rows = [(1, "a"), (2, "bad"), (3, "a"), (4, None), *[(10 + i, "often") for i in range(50)]]
    prompts = spark.createDataFrame(rows, "id int, prompt string")
    got = {r.id: (r.refined, r.error) for r in resume_prompts(prompts, failing, path).collect()}
    assert got == {1: ("first a", None), 2: (None, "ValueError: no answer"), 3: ("first a", None), 4: (None, None),
                   **{10 + i: ("first often", None) for i in range(50)}}
    more = prompts.unionByName(spark.createDataFrame([(5, "new")], "id int, prompt string"))
    again = {r.id: (r.refined, r.error) for r in resume_prompts(more, lambda asked: [f"second {p}" for p in asked], path).collect()}
    assert again == {**got, 2: ("second bad", None), 5: ("second new", None)}
    assert resume_prompts(prompts.limit(0), failing, path).count() == 0


def test_runs_travel_only_for_ids_of_several_rows(spark):
    """Rows of one id share their counts, null ids as well; a row alone is decided without a shuffle of its runs."""
    from scribemend.operators import guard as G

    rows = [(1, "abcdefgh", "abcdefgh abcdefgh"), (2, "abcdefgh", "abcdefgh and more"), (3, "short", "short and longer"),
            (4, "abcde", "xyz xyz xyz"), (4, "xyz", "abcde abcde abcde"), (5, "aaaaa", "aaaaaaaaa"), (6, "a", None), (7, None, "abcdefg"),
            (None, "klmno", "no such run"), (None, "q", "klmno klmno")]
    df = spark.createDataFrame(rows, "id int, before string, after string")
    assert sorted(r.id or 0 for r in G.repeat_injections(df, "before", "after").collect()) == [0, 1, 4, 5]
    alone = df.filter("id < 4 or id = 5")
    plan = G.repeat_injections(alone, "before", "after")._jdf.queryExecution().optimizedPlan().toString()
    assert "_repeats" in plan


def test_grams_of_any_tokens_travel_as_strings(spark):
    from scribemend.operators import ngrams as N

    tokens = [["a", "b c", "\u001f", "\u001e", "\u001e0", "\u001e1\u001f", "", "\u001e2", "é", "a"], [None, "a"], [], ["a", None]]
    df = spark.createDataFrame([(t,) for t in tokens], "tokens array<string>")
    found = {(r.n, tuple(r.gram)): r.cnt for r in N.train(df, 3).grams.collect()}
    want: dict = {}
    for t in tokens:
        for n in (1, 2, 3):
            for k in range(len(t) - n + 1):
                want[n, tuple(t[k:k + n])] = want.get((n, tuple(t[k:k + n])), 0) + 1
    assert found == want
    plan = N.train(df, 3).grams._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_gram" in plan


def test_a_stream_meets_a_lexicon_over_the_bound(spark, tmp_path):
    from scribemend.operators import aliases as A
    from scribemend.streaming import transcripts as Y

    rows = [(1, "teh end."), (1, "adn teh"), (None, "teh"), (2, None), (2, None)]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/in")
    lexicon = spark.createDataFrame([("teh", "the", 1), ("adn", "and", 2)], "alias string, canonical string, lex_order long")
    stream = spark.readStream.schema("doc_id int, text string").parquet(f"{tmp_path}/in")
    for limit, name in ((A.INDEX_BYTES, "index"), (0, "joins")):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(Y, "resolve_aliases", lambda df, lex, key, col: A.resolve_aliases(df, lex, key, col, limit=limit))  # noqa: B023
            Y.correct_batches(stream, lexicon, f"{tmp_path}/{name}", f"{tmp_path}/{name}-mark").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/{name}").collect()
        assert sorted((r.doc_id or 0, r.corrected or "", len(r.changes)) for r in got) == [
            (0, "the", 1), (1, "and the", 2), (1, "the end.", 1), (2, "", 0), (2, "", 0)]


def test_mining_cuts_each_text_into_tokens_once(spark):
    from scribemend.operators import retrieval as R

    rows = [(1, "teh cat adn dog", "the cat and dog"), (2, "same text", "same text"), (3, "teh cow", "the cow"), (4, "", "x"), (5, None, "y"), (6, "a b", "c d")]
    mined = R.mine_error_patterns(spark.createDataFrame(rows, "id int, asr string, correct string"))
    assert sorted(map(tuple, mined.collect())) == [
        ("adn", "and", 1, "teh cat adn dog"), ("adn", "the", 1, "teh cat adn dog"),
        ("teh", "and", 1, "teh cat adn dog"), ("teh", "the", 2, "teh cat adn dog")]
    assert mined._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2
