import json

import pytest
from pyspark.sql import functions as F

from scribemend.functions.phonetic import latin_syllables
from scribemend.operators import lexicon as L
from scribemend.operators.retrieval import mine_error_patterns
from scribemend.plans import correct as P
from scribemend.plans import jobs as J
from scribemend.sources import corpus as S
from scribemend.sources import lexicons as X
from scribemend.sources import stores as T


def _write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_lexicon_files(spark, tmp_path):
    aliases = X.read_aliases(spark, _write(tmp_path / "a.json", {"道差": "道岔", "新号机": "信号机"})).collect()
    assert [(r.alias, r.canonical, r.lex_order) for r in aliases] == [("道差", "道岔", 0), ("新号机", "信号机", 1)]
    confusion = X.read_confusion(spark, _write(tmp_path / "c.json", {"_note": "x", "消极": "销记"})).collect()
    assert [(r.wrong, r.correct) for r in confusion] == [("消极", "销记")]
    terms = X.read_terms(spark, _write(tmp_path / "t.json", {"terms": [{"canonical": "道岔", "aliases": ["道差"], "patterns": [r"\d+号道岔"]}, {"canonical": "尖轨"}]}))
    assert [(r.canonical, r.alias) for r in X.term_aliases(terms).orderBy("canonical").collect()] == [("尖轨", None), ("道岔", "道差")]
    assert X.read_terms(spark, _write(tmp_path / "bad.json", "{broken")).count() == 0
    phrases = X.read_phrases(spark, _write(tmp_path / "p.json", [{"_note": "x"}, {"pattern": "某温", "replacement": "X分"}])).collect()
    assert [(r.pattern, r.replacement) for r in phrases] == [("某温", "X分")]
    syllables = X.read_syllable_confusion(spark, _write(tmp_path / "s.json", {"whole": {"si": ["shi", "shi", "si"]}, "initial": {"zh": ["z"]}}))
    assert {tuple(r) for r in syllables.collect()} == {("whole", "si", "shi"), ("initial", "zh", "z")}


def test_hotwords_and_lines(spark, tmp_path):
    rows = X.read_hotwords(spark, _write(tmp_path / "h.json", ["道岔", {"word": "尖轨", "category": "轨"}, {"word": "密贴", "enabled": False}])).collect()
    assert [(r.word, r.category, r.enabled) for r in rows] == [("道岔", None, True), ("尖轨", "轨", True), ("密贴", None, False)]
    assert [r.word for r in X.read_word_list(spark, _write(tmp_path / "w.csv", "甲, 乙,,丙\n"), ",").collect()] == ["甲", "乙", "丙"]
    lines = spark.createDataFrame([(0, "# a -> b"), (1, "甲 -> 乙"), (2, "丙|丁"), (3, "甲->戊"), (4, "无"), (5, " "), (6, "x|y -> z")], "line_no int, line string")
    assert {(r.alias, r.canonical) for r in X.parse_alias_lines(lines).collect()} == {("甲", "戊"), ("丙", "丁"), ("x|y", "z")}
    lines = spark.createDataFrame([("道岔", "c"), ('["甲","乙"]', "c"), ("[坏", "c"), ("", "c")], "line string, category string")
    assert [r.word for r in X.parse_hotword_lines(lines).collect()] == ["道岔", "甲", "乙", "[坏"]


def test_pairs_and_versions(spark, tmp_path):
    good = json.dumps({"asr": "a", "correct": "b", "error_types": ["phonetic"]})
    assert S.read_error_pairs(spark, _write(tmp_path / "e.jsonl", f"{good}\n\n{{broken\n{good}\n")).count() == 2
    docs = spark.createDataFrame([("调度.txt",), ("调度_机车.txt",), ("folder/调度.json",)], "name string")
    assert [r.category for r in X.pick_version(docs, "调度").collect()] == ["default", "default"]
    assert [r.category for r in X.pick_version(docs, None).collect()] == ["调度", "调度_机车", "调度"]
    store = T.LexiconStore(spark, str(tmp_path / "store"))
    segments = spark.createDataFrame([("v1.txt", 1, "丙|丁"), ("v1.txt", 0, "甲 -> 乙"), ("v2.txt", 0, "甲 -> 己")], "doc string, pos int, content string")
    J.sync_aliases(store, segments, "v1")
    J.sync_aliases(store, segments, "v2", activate=False)
    assert {(r.alias, r.canonical) for r in store.active().collect()} == {("甲", "乙"), ("丙", "丁")}
    store.activate("v2")
    assert [r.canonical for r in store.active().collect()] == ["己"]
    assert [r.version for r in store.pointers().collect()] == ["v1", "v2"]
    with pytest.raises(ValueError):
        store.activate("v3")


def test_lexicon_upkeep(spark):
    old = L.with_id(spark.createDataFrame([("甲", None, None), ("乙", "x", False)], "word string, category string, enabled boolean"))
    grown, rejected = L.insert_words(old, spark.createDataFrame([("甲", None, True), ("乙", None, True)], "word string, category string, enabled boolean"))
    assert grown.count() == 3 and [r.word for r in rejected.collect()] == ["甲"]
    assert [r.word for r in L.list_words(grown).collect()] == ["乙", "甲"]


def test_prompts_refine_and_fallback(spark):
    corrected = P.correct(spark.createDataFrame([(1, "请检查道差和道岔无表示"), (2, "好")], "id int, text string"), P.Resources(), ())
    confusion = spark.createDataFrame([("请检查道差和道岔无表示", "道岔", 1)], "wrong string, correct string, lex_order long")
    pairs = spark.createDataFrame([(1, "a bb", "a cc"), (2, "a bb", "a cc")], "id int, asr string, correct string")
    scenes = spark.createDataFrame([("道岔故障", 1, "道岔无表示", 1), ("道岔故障", 1, "抢修", 2)], "scene string, scene_no int, term string, term_no int")
    terms = spark.createDataFrame([("tere", ["te", "re"])], "term string, syls array<string>")
    mined = mine_error_patterns(pairs)
    assert [tuple(r) for r in mined.collect()] == [("bb", "cc", 2, "a bb")]
    prompts = J.build_prompts(corrected, confusion, mined, scenes, terms, latin_syllables)
    rows = prompts.collect()
    assert [r.id for r in rows] == [1]
    assert "- 术语映射：请检查道差和道岔无表示 → 道岔" in rows[0].prompt and "“道岔故障”场景，标准术语包括：道岔无表示、抢修" in rows[0].prompt
    fixed = J.refine(corrected, prompts, lambda batch: ["```\n请检查道岔和道岔无表示\n```" for _ in batch])
    assert {r.id: r.final for r in fixed.collect()} == {1: "请检查道岔和道岔无表示", 2: "好"}

    def broken(batch):
        raise RuntimeError("no model")

    assert {r.id: r.final for r in J.refine(corrected, prompts, broken).collect()} == {1: "请检查道差和道岔无表示", 2: "好"}


def test_failures_to_pending_and_approved_aliases(spark):
    rows = [(1, "a teh b", "a teh b", "a the b", {"layer1": "a teh b"}), (2, "x", "y", "y", {"layer1": "y"})]
    failures = J.collect_failures(spark.createDataFrame(rows, "id int, original string, corrected string, expected string, layer_outputs map<string,string>"))
    assert [(r.id, r.failure_type, r.layer_responsible) for r in failures.collect()] == [(1, "漏纠", "layer4")]
    known = spark.createDataFrame([("adn", "and", 1)], "alias string, canonical string, lex_order long")
    pending = J.pending_aliases(failures, known)
    assert [(r.alias, r.canonical, r.approved) for r in pending.collect()] == [("teh", "the", "no")]
    assert J.approve_aliases(known, pending.withColumn("approved", F.lit("yes"))).count() == 2


def test_each_distinct_text_is_corrected_once_with_the_same_result(spark):
    aliases = spark.createDataFrame([("道差", "道岔", 1)], "alias string, canonical string, lex_order long")
    res = P.Resources(aliases=aliases)
    df = spark.range(300).select("id", F.when(F.col("id") < 200, "3号道差").otherwise(F.concat(F.lit("道差"), F.col("id").cast("string"))).alias("text"))
    once = {r.id: r.corrected for r in P.correct_distinct(df, res, (2,)).collect()}
    assert once == {r.id: r.corrected for r in P.correct(df, res, (2,)).collect()} and len(once) == 300


def test_golden_text_through_all_layers(spark):
    aliases = spark.createDataFrame([("新号机", "信号机", 1)], "alias string, canonical string, lex_order long")
    confusion = spark.createDataFrame([("道差", "道岔", 1)], "wrong string, correct string, lex_order long")
    terms = spark.createDataFrame([("信号", ["新号"], [r"新号|信号好了"], 1)], "canonical string, aliases array<string>, patterns array<string>, lex_order long")
    phrases = spark.createDataFrame([(1, "松引，", "")], "rule_no long, pattern string, replacement string")
    res = P.Resources(aliases=aliases, confusion=confusion, terms=terms, phrases=phrases)
    df = spark.createDataFrame([(1, "十八号道差开通反位，信号好了"), (2, "松引，新号机好了。")], "id int, text string")
    rows = {r.id: r for r in P.correct(df, res).collect()}
    assert rows[1].corrected == "18号道岔开通反位，信号好了。" and rows[1].layers_applied == ["preprocess", "context"]
    assert rows[1].layer_outputs["layer2"] == "18号道差开通反位，信号好了。"
    assert rows[2].corrected == "信号机好了。" and rows[2].layers_applied == ["dictionary", "context"]
    assert {r.id: r.corrected for r in P.correct(df, res, ()).collect()} == {1: "十八号道差开通反位，信号好了", 2: "松引，新号机好了。"}


def test_model_is_published_only_if_better(spark, tmp_path):
    good = spark.createDataFrame([(k, ["a", "b"] * 5) for k in range(5)], "id int, tokens array<string>")
    bad = spark.createDataFrame([(k, ["c", "d", "a", "e"]) for k in range(5)], "id int, tokens array<string>")
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    new, old, path = J.publish_model(spark, good, good, first, None)
    assert old is None and path == first
    assert J.publish_model(spark, bad, good, second, first)[2] == first


def test_report_and_failure_log(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-0{1 + k % 9} 10:00:00", "漏纠", "layer2") for k in range(30)],
                                 "id int, ts string, failure_type string, layer_responsible string").withColumn("ts", F.col("ts").cast("timestamp"))
    T.append_failures(rows, str(tmp_path / "log"))
    recent = T.recent_failures(spark, str(tmp_path / "log"), F.lit("2024-01-09").cast("date"), 2)
    assert recent.count() == 6 and "PartitionFilters: [isnotnull(dt" in recent._jdf.queryExecution().toString()
    T.write_report(recent, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/samples")).count() == 6
