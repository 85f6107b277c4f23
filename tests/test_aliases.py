import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scribemend.operators import aliases as A
from scribemend.operators import lookup as L
from scribemend.operators import rewrites as R
from scribemend.plans import correct as P

LEXICON = [("道差", "道岔", 1), ("新号机", "信号机", 2), ("差", "岔", 3), ("ab", "X", 4), ("abc", "Y", 5), ("b", "Z", 6),
           ("bca", "W", 7), ("aa", "a2", 8), ("same", "same", 9), ("", "empty", 10)]


def brute(text):
    """Longest alias first, lexicon order, position; one character only as a word of its own."""
    taken, kept = set(), []
    for alias, canonical, order in sorted(LEXICON, key=lambda x: (-len(x[0]), x[2])):
        if not alias or alias == canonical:
            continue
        for m in range(len(text) - len(alias) + 1):
            span = set(range(m, m + len(alias)))
            if text[m:m + len(alias)] != alias or span & taken:
                continue
            beside = text[m - 1:m] + text[m + len(alias):m + len(alias) + 1]
            if len(alias) == 1 and re.search(r"\w", beside):
                continue
            taken |= span
            kept.append((m, alias, canonical))
    kept.sort()
    out, at = "", 0
    for m, alias, canonical in kept:
        out, at = out + text[at:m] + canonical, m + len(alias)
    return out + text[at:], kept


def _texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc 道差新号机，\n") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return texts + ["道差", "差，", "b b b", "ab", "b", "aaa"]


def test_greedy_equals_brute_force_on_both_paths(spark):
    lexicon = spark.createDataFrame(LEXICON, "alias string, canonical string, lex_order long")
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for force in (False, True):
        rows = {r.id: r.resolved for r in A.resolve_aliases(df, lexicon, limit=0 if force else A.INDEX_BYTES).collect()}
        for k, text in enumerate(texts):
            want, spans = brute(text)
            assert rows[k].text == want, (force, text)
            assert [(s.pos, s.alias, s.canonical) for s in rows[k].spans] == spans
            ends = [0] + [s.pos + len(s.alias) for s in rows[k].spans]
            assert all(s.pos >= e for s, e in zip(rows[k].spans, ends))


def test_all_occurrences_overlap(spark):
    lexicon = spark.createDataFrame(LEXICON, "alias string, canonical string, lex_order long")
    df = spark.createDataFrame([(1, "aaaabca")], "id int, text string")
    for limit in (0, A.INDEX_BYTES):
        found = sorted((r.alias, r.pos) for r in A.alias_occurrences(df, lexicon, limit=limit).collect())
        assert found == [("aa", 0), ("aa", 1), ("aa", 2), ("ab", 3), ("abc", 3), ("b", 4), ("bca", 4)]


def test_confusion_first_occurrence_only(spark):
    table = spark.createDataFrame([("道差", "道岔", 1)], "wrong string, correct string, lex_order long")
    df = spark.createDataFrame([(1, "道差道差"), (2, "无")], "id int, text string")
    rows = {r.id: r for r in R.replace_confusions(df, table).collect()}
    assert rows[1].replaced == "道岔道差" and len(rows[1].hits) == 1
    assert rows[2].replaced == "无" and not rows[2].hits


def sequential(text, rules):
    """One rule after the other, longest word first: its first occurrence."""
    used = []
    for wrong, right, _ in sorted(rules, key=lambda r: (-len(r[0]), r[2], r[0])):
        if wrong in text:
            text = text.replace(wrong, right, 1)
            used.append((wrong, right))
    return text, used


def test_confusions_equal_the_sequential_fold_on_both_paths(spark):
    """Replacements that make later rules possible, break others up, grow and vanish."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    rules = [(w, rng.choice(["", "a", "cb", "abcabc", "b" * len(w), w]), k % 3) for k, w in enumerate(words)]
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "ddd"]
    table = spark.createDataFrame(rules, "wrong string, correct string, lex_order long")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for limit in (A.INDEX_BYTES, 0):
        rows = {r.id: r for r in R.replace_confusions(df, table, limit=limit).collect()}
        assert len(rows) == len(texts)
        for k, text in enumerate(texts):
            want = sequential(text, rules) if text is not None else (None, [])
            assert (rows[k].replaced, [tuple(h) for h in rows[k].hits]) == want, (limit, text)


def test_fifty_thousand_confusions_leave_the_plan_small(spark):
    rows = [(f"w{k:05d}x", f"c{k:05d}", k) for k in range(50_000)]
    table = spark.createDataFrame(rows, "wrong string, correct string, lex_order long")
    df = spark.createDataFrame([(1, "w00001x w04400x w00001x w49999x")], "id int, text string")
    out = R.replace_confusions(df, table)
    assert out.first().replaced == "c00001 c04400 w00001x c49999"
    assert len(out._jdf.queryExecution().toString()) < 20_000


def test_phrases_and_tolerant_patterns(spark):
    phrases = spark.createDataFrame([(1, "某(点)", r"X\1"), (2, "松引，", "")], "rule_no long, pattern string, replacement string")
    df = spark.createDataFrame([(1, "某点，松引，好")], "id int, text string")
    assert R.replace_phrases(df, R.phrase_rules(phrases)).first().replaced == "X点，好"
    terms = spark.createDataFrame([("道岔", ["道差", "道差子"], [r"\d+号道岔", "无"], 1)],
                                  "canonical string, aliases array<string>, patterns array<string>, lex_order long")
    df = spark.createDataFrame([(1, "18号道差和道差"), (2, "3号道岔")], "id int, text string")
    rows = {r.id: r for r in R.replace_by_patterns(df, R.tolerant_rules(terms)).collect()}
    assert rows[1].replaced == "18号道岔和道差" and rows[1].pattern_changes[0].before == "18号道差"
    assert rows[2].replaced == "3号道岔" and not rows[2].pattern_changes


def test_lexicon_over_the_bound_of_an_index(spark):
    rows = [(f"k{n:05d}", f"c{n}", n) for n in range(6000)] + [("k0", "short", 7000), ("z", "one", 7001)]
    lexicon = spark.createDataFrame(rows, "alias string, canonical string, lex_order long")
    df = spark.createDataFrame([(1, "k00007 k05999k0 z kz"), (2, "none"), (3, None), (4, "")], "id int, text string")
    assert A.resolver(lexicon, 1000) is None
    for limit in (1000, A.INDEX_BYTES):
        got = {r.id: r.resolved.text for r in A.resolve_aliases(df, lexicon, limit=limit).collect()}
        assert got == {1: "c7 c5999short one kz", 2: "none", 3: None, 4: ""}
        assert A.alias_occurrences(df, lexicon, limit=limit).filter("alias = 'k0'").count() == 3
    with pytest.raises(ValueError, match="too large"):
        P.stateless_aliases(P.Resources(aliases=lexicon.crossJoin(spark.range(1).select(F.repeat(F.lit("x"), 5000).alias("w"))).select(
            F.concat("alias", "w").alias("alias"), "canonical", "lex_order")))


def test_ties_negative_orders_private_characters_and_thousands_of_aliases(spark):
    """5000 aliases with few different orders, private characters: both paths equal the greedy rule."""
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 11))) for _ in range(6000)})[:5000]
    lexicon = [(w, w.upper(), len(w) % 3 - 1) for w in names] + [("x", "framed", -5), ("q", "Q", -1)]
    texts = ["".join(rng.choice("abcdefgh q") for _ in range(120)) for _ in range(30)] + ["a x b ", "q q", ""]
    table = spark.createDataFrame(lexicon, "alias string, canonical string, lex_order long")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    first = sorted(lexicon, key=lambda a: (-len(a[0]), a[2], a[0]))

    def greedy(text):
        taken, kept = [False] * len(text), []
        for alias, canonical, _ in first:
            at = text.find(alias)
            while at >= 0:
                alone = len(alias) > 1 or not re.search(r"\w", text[at - 1:at] + text[at + 1:at + 2])
                if alone and not any(taken[at:at + len(alias)]):
                    taken[at:at + len(alias)] = [True] * len(alias)
                    kept.append((at, alias))
                    at = text.find(alias, at + len(alias))
                else:
                    at = text.find(alias, at + 1)
        return sorted(kept)

    by_join = {r.id: r.resolved for r in A.resolve_aliases(df, table, limit=0).collect()}
    in_row = {r.id: r.r for r in df.withColumn("r", A.resolver(table)(F.col("text"))).collect()}
    for k, text in enumerate(texts):
        assert [(s.pos, s.alias) for s in by_join[k].spans] == [(s.pos, s.alias) for s in in_row[k].spans] == greedy(text)
        assert by_join[k].text == in_row[k].text


def test_long_batches_are_read_in_slices():
    texts = pa.array(["ab" * 300_000, None, "the", "", *["thin and " * 1000] * 500])
    sizes = []

    def work(some):
        sizes.append(sum(len(t or "") for t in some.to_pylist()))
        return A._resolved(some.to_pylist(), [lexicon] * len(some))

    lexicon = (A.StringIndex(["thin", "and"]), ["sin", "und"], [1, 2])
    got = L.by_slices(work, texts)
    assert len(sizes) > 4 and max(sizes) < 2 * L.SLICE_BYTES
    assert got.equals(A._resolved(texts.to_pylist(), [lexicon] * len(texts)))
    assert L.by_slices(work, texts.slice(0, 0)).equals(A._resolved([], []))


def test_only_windows_that_can_be_strings_leave_a_text(spark):
    """Strings shorter, as long as and longer than a key, over the seams of slices; texts without any send no rows."""
    rng = random.Random(6)
    long = "".join(rng.choice("xyzé😀") for _ in range(3 * L.SLICE_BYTES // 2))
    at = L.SLICE_BYTES - 10  # over the first seam
    strings = ["q", "ab", "b" * L.KEY, "c" * (L.KEY + 1), "c" * (L.KEY + 40), long[at:at + 20], long[at:at + 60], long[at:at + 60] + "!"]
    texts = ["ab " + "b" * 30, "c" * 50, long, "none of them " * 1000, None, "", "c" * 100 + "qq"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(s, len(s)) for s in [*strings, ""]], "string string, n int")
    found = L.held_pairs(df, L.keyed_strings(table), "id", F.array("text"))
    want = {(k, s, len(s)) for k, t in enumerate(texts) if t for s in strings if s in t}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    windows = spark.read.parquet(next(p for p in reversed(L.stored.__globals__["made_paths"](spark)) if "/windows-" in p))
    assert windows.filter("id = 3").isEmpty() and windows.count() <= 3 * len(want)


def test_rules_over_the_bound_meet_pieces_without_their_texts(spark):
    """A text with many replacements: what travels goes with its rules, not with pieces times rules."""
    rules = [(f"w{k:03d}.", f"w{k:03d}!", 0) for k in range(300)] + [("w001! w002!", "both", 0)]
    text = " ".join(f"w{k:03d}." for k in range(300))
    table = spark.createDataFrame(rules, "wrong string, correct string, lex_order long")
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id int, text string")
    rows = {r.id: r for r in R.replace_confusions(df, table, limit=0).collect()}
    assert rows[1].replaced == sequential(text, rules)[0] and len(rows[1].hits) == len(sequential(text, rules)[1])
    assert (rows[2].replaced, rows[3].replaced) == ("none", None)


def test_frequent_rules_over_the_bound_stay_where_the_texts_are(spark):
    """Of a table over the bound, the frequent rules become an index and only pairs with the others travel."""
    rng = random.Random(8)
    often = [(f"o{k:02d}", rng.choice(["", "r007", "R", "o01", f"o{k:02d}!"]), k % 3) for k in range(40)]
    seldom = [(f"r{k:03d}", rng.choice(["o05", "x", f"r{k:03d} o39", "o1"]), k % 2) for k in range(300)]
    rules = often + seldom + [("R R", "both", 1), ("x" * (L.KEY + 9), "long", 0)]
    texts = [" ".join(rng.choice(often)[0] for _ in range(30)) + f" {seldom[k][0]}" for k in range(50)] + [None, "", "none", "x" * 60, "o05"]
    table = spark.createDataFrame(rules, "wrong string, correct string, lex_order long")
    df = spark.createDataFrame([*enumerate(texts), (None, "o05 r001")], "id int, text string")
    before = set(L.stored.__globals__["made_paths"](spark))
    rows = {r.id: r for r in R.replace_confusions(df, table, limit=4000).collect()}
    for k, text in enumerate(texts):
        want = sequential(text, rules) if text is not None else (None, [])
        assert (rows[k].replaced, [tuple(h) for h in rows[k].hits]) == want, text
    assert rows[None].replaced == "o05 r001"
    made = [p for p in L.stored.__globals__["made_paths"](spark) if p not in before]
    assert spark.read.parquet(next(p for p in made if "/held-rules-" in p)).count() < 100  # 50 texts hold some 20 frequent ones each


def test_frequent_aliases_over_the_bound_stay_where_the_texts_are(spark):
    """Spans are those of the index for any part of a lexicon that is one; entries are of the others only."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {f"ba{k:03d}" for k in range(200)})
    lexicon = spark.createDataFrame([(w, w.upper() + "!", (k % 4) or None) for k, w in enumerate(words)], "alias string, canonical string, lex_order long")
    texts = ["".join(rng.choice("aabb ") for _ in range(80)) + f"ba{k:03d}" * (k % 2) for k in range(60)] + [None, "", "zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: (r.resolved, r.n) for r in A.resolve_aliases(df, lexicon).withColumn("n", F.size("resolved.spans")).collect()}
    places = sorted(map(tuple, A.alias_occurrences(df, lexicon).collect()), key=str)
    for limit in (0, 1000, 4500):
        assert {r.id: (r.resolved, r.n) for r in A.resolve_aliases(df, lexicon, limit=limit).withColumn("n", F.size("resolved.spans")).collect()} == want
        assert sorted(map(tuple, A.alias_occurrences(df, lexicon, limit=limit).collect()), key=str) == places
    joined, shared = A._with_entries(df, A._rules(lexicon), "id", "text", 4500)
    assert shared is not None and joined.agg(F.sum(F.size("_entries"))).first()[0] < 60
