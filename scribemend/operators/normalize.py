"""Normalisation of spoken numbers, times, units and punctuation.

A rule is a name and a function Column -> Column; rules run in order, and every rule
that alters a text leaves a change record with the whole text before and after.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.functions.numerals import numeral_value, read_digits
from scribemend.functions.text import chained, contains_any, item_rows, let, rewrite_matches, strip

CHANGE = "struct<layer:string,type:string,before:string,after:string,reason:string,pos:int>"

# Patterns of the number rules.
YEAR = "([一二三四五六七八九零〇]{4})年"
MONTH_DAY = "(?U)([一二三四五六七八九十]{1,2})(月|日)|(?<=[一二三四五六七八九十]月)([一二三四五六七八九十]{1,2})号"
TIME = "([一二三四五六七八九十百千万零]+)点([一二三四五六七八九十百千万零]+)分"
PERCENT = "百分之([一二三四五六七八九十百千万零]+)"
SPEED = "限速([一二三四五六七八九十百千万零]+)公里每小时"
KILOMETRE = r"(?U)([Kk])?\s*([一二三四五六七八九十百千万零]+)\s*公里\s*([一二三四五六七八九十百千万零]+)\s*米"
TRAIN = r"(?U)([GDKTZC])\s*([一二三四五六七八九十百千万零]+)\s*次"
DIGIT_BY_DIGIT = r"(?U)([GDKTZC])?\s*([零〇一二三四五六七八九幺]{2,})\s*(次|号|道)"
NUMBERED = r"(?U)([一二三四五六七八九十百千万]+)\s*(号?)\s*(道岔|信号机|轨道电路|区段|道|线|按钮|计数器|锁闭按钮)"
NUMBERED_ASSETS = ["道岔", "信号机", "轨道电路", "区段", "道", "线", "按钮", "计数器", "锁闭按钮"]
TRACK = r"(?U)([一二三四五六七八九十])\s*到(?=发车|接车|进路|停车|出站|进站)"
STAND_ALONE = r"(?U)([一二三四五六七八九十])\s*号(?![道岔信号机轨道区段线按钮计数器锁闭])"
TRAIN_PREFIX = r"(?U)([gdktzc])(\d+)次"

# Words that steer punctuation.
ROLE_WORDS = ["报告值班员", "车站值班员", "列车调度员", "内勤", "外勤", "站长", "司机", "列车长",
              "乘务员", "随车机械师", "调度所", "指挥中心"]
PAUSE_WORDS = ["值班员", "调度员", "扳道员", "司机", "站长", "干部", "工务", "电务", "车站", "列车",
               "好了", "明白", "收到", "执行", "注意"]
SENTENCE_ENDS = ["司机明白", "明白", "收到", "好了", "完毕", "正常", "停妥", "到达", "出发", "通过",
                 "出站", "已?下道", "返回安全区域"]
MARKS = "，。；！？、"
CLOSING = [".", "。", "!", "！", "?", "？"]
LONG_SEGMENT = 10


@dataclass(frozen=True)
class Rule:
    name: str
    apply: Callable[[Column], Column]
    layer: str = "itn"


def _or_same(value: Column, match: Column) -> Column:
    """A malformed numeral leaves its match as it is."""
    return F.coalesce(value, match)


def _padded(value: Column, width: int) -> Column:
    """At least `width` digits, never cut."""
    return let(value.cast("string"), lambda v: F.when(F.length(v) < width, F.lpad(v, width, "0")).otherwise(v))


def year(text: Column) -> Column:
    return rewrite_matches(text, YEAR, 1, lambda m, g: F.concat(read_digits(g[0]), F.lit("年")), ["年"])


def month_day(text: Column) -> Column:
    return rewrite_matches(text, MONTH_DAY, 3, lambda m, g: _or_same(
        F.when(g[1] != "", F.concat(numeral_value(g[0]), g[1]))
        .otherwise(F.concat(numeral_value(g[2]), F.lit("日"))), m), ["月", "日"])


def clock_time(text: Column) -> Column:
    def convert(m: Column, g: list[Column]) -> Column:
        return _or_same(F.concat(numeral_value(g[0]), F.lit(":"), _padded(numeral_value(g[1]), 2)), m)

    return rewrite_matches(text, TIME, 2, convert, ["点"])


def percent(text: Column) -> Column:
    return rewrite_matches(text, PERCENT, 1, lambda m, g: _or_same(F.concat(numeral_value(g[0]), F.lit("%")), m), ["百分之"])


def speed(text: Column) -> Column:
    return rewrite_matches(text, SPEED, 1, lambda m, g: _or_same(
        F.concat(F.lit("限速"), numeral_value(g[0]), F.lit("km/h")), m), ["限速"])


def kilometre(text: Column) -> Column:
    def convert(m: Column, g: list[Column]) -> Column:
        return _or_same(F.concat(F.lit("K"), numeral_value(g[1]), F.lit("+"), _padded(numeral_value(g[2]), 3)), m)

    return rewrite_matches(text, KILOMETRE, 3, convert, ["公里"])


def train_number(text: Column) -> Column:
    return rewrite_matches(text, TRAIN, 2, lambda m, g: _or_same(
        F.concat(F.upper(g[0]), numeral_value(g[1]), F.lit("次")), m), ["次"])


def digit_by_digit(text: Column) -> Column:
    return rewrite_matches(text, DIGIT_BY_DIGIT, 3, lambda m, g: F.concat(F.upper(g[0]), read_digits(g[1]), g[2]),
                           ["次", "号", "道"])


def numbered_asset(text: Column) -> Column:
    def convert(m: Column, g: list[Column]) -> Column:
        sign = F.when(g[2].isin("道", "线"), g[1]).otherwise(F.lit("号"))
        return _or_same(F.concat(numeral_value(g[0]), sign, g[2]), m)

    return rewrite_matches(text, NUMBERED, 3, convert, NUMBERED_ASSETS)


def misheard_track(text: Column) -> Column:
    return rewrite_matches(text, TRACK, 1, lambda m, g: _or_same(F.concat(numeral_value(g[0]), F.lit("道")), m),
                           ["到"])


def stand_alone_number(text: Column) -> Column:
    return rewrite_matches(text, STAND_ALONE, 1, lambda m, g: _or_same(
        F.concat(numeral_value(g[0]), F.lit("号")), m), ["号"])


def train_prefix(text: Column) -> Column:
    return rewrite_matches(text, TRAIN_PREFIX, 2, lambda m, g: F.concat(F.upper(g[0]), g[1], F.lit("次")),
                           ["次"])


def spacing(text: Column) -> Column:
    """No blanks beside CJK characters, none between a single letter and a digit, none at the ends."""
    cjk = "[\u4e00-\u9fa5]"
    word = r"[\p{L}\p{N}_]"

    def beside_cjk(t: Column) -> Column:
        t = F.regexp_replace(t, rf"(?U)({cjk})\s+({cjk})", "$1$2")
        t = F.regexp_replace(t, rf"(?U)({cjk})\s+({word})", "$1$2")
        return F.regexp_replace(t, rf"(?U)({word})\s+({cjk})", "$1$2")

    out = F.when(text.rlike(cjk), beside_cjk(text)).otherwise(text)
    return let(out, lambda t: strip(F.when(t.rlike(r"(?U)[A-Za-z]\s+\d"), F.regexp_replace(
        t, rf"(?U)([A-Za-z])(?<!{word}(?s:.))\s+(\d)", "$1$2")).otherwise(t)))


def full_stops(text: Column) -> Column:
    out = F.regexp_replace(F.replace(text, F.lit("、"), F.lit("，")), "。{2,}", "。")
    return F.when(contains_any(text, ["、", "。"]), out).otherwise(text)


def _closed(text: Column) -> Column:
    return F.substring(text, -1, 1).isin(*CLOSING)


def close_text(text: Column, stop: str = "。") -> Column:
    """Terminal mark for a text that has none."""
    return F.when(_closed(text), text).otherwise(F.concat(text, F.lit(stop)))


def role_segments(text: Column, roles: list[str] = ROLE_WORDS) -> Column:
    """Split before every role word; blank segments dropped, the rest trimmed."""
    pieces = F.when(contains_any(text, roles), F.split(text, f"(?={'|'.join(roles)})", -1)).otherwise(F.array(text))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def _ends_sentence(segment: Column, ends: list[str]) -> Column:
    """The words are tried on the tail only; none is longer than its own pattern."""
    tail = max(len(e) for e in ends)
    return F.substring(segment, -tail, tail).rlike(f"(?:{'|'.join(ends)})$")


def close_segment(segment: Column, ends: list[str] = SENTENCE_ENDS, stop: str = "。") -> Column:
    """A segment that ends with a sentence-end word gets a full stop."""
    return F.when(_ends_sentence(segment, ends), close_text(segment, stop)).otherwise(segment)


def pause_commas(segment: Column, words: list[str] = PAUSE_WORDS, comma: str = "，") -> Column:
    """A comma after every pause word that no mark follows, but not in front of a numbered asset."""
    guard = r"(?!(?s:.)?\d号(?:道岔|按钮|区段)|\d号信号机)"
    out = segment
    for word in words:
        out = F.regexp_replace(out, rf"(?U)({word}){guard}([^{MARKS}\s])", f"$1{comma}$2")
    return F.when(contains_any(segment, words), out).otherwise(segment)


def punctuate(text: Column) -> Column:
    """Close punctuated text; split, pause and close text without any mark."""

    def one(segment: Column) -> Column:
        return (F.when(_ends_sentence(segment, SENTENCE_ENDS), close_text(segment))
                .when(F.length(segment) > LONG_SEGMENT, pause_commas(segment)).otherwise(segment))

    bare = let(F.array_join(F.transform(role_segments(text), one), ""), lambda t: close_text(t))
    return (F.when(~text.rlike(r"(?U)\S"), text)
            .when(contains_any(text, list(MARKS)), close_text(text))
            .otherwise(bare))


NUMBER_RULES = [
    Rule("year", year), Rule("month_day", month_day), Rule("time", clock_time), Rule("percent", percent),
    Rule("speed", speed), Rule("kilometer", kilometre), Rule("train_number", train_number),
    Rule("digit_by_digit", digit_by_digit), Rule("numbered_term", numbered_asset),
    Rule("track_number", misheard_track), Rule("standalone_number", stand_alone_number),
    Rule("train_prefix", train_prefix), Rule("punctuation", spacing), Rule("cn_punctuation", full_stops),
]
RULES = [*NUMBER_RULES, Rule("add_punctuation", punctuate, "punctuation")]


def normalize(df: DataFrame, text_col: str = "text", rules: list[Rule] = RULES,
              out: str = "normalized", changes: str = "changes") -> DataFrame:
    """Apply rules in order; adds the new text and the change records."""
    names = F.array(*[F.struct(F.lit(r.layer).alias("layer"), F.lit(r.name).alias("type")) for r in rules])

    def records(states: Column) -> Column:
        changed = F.transform(names, lambda r, k: F.when(states[k] != states[k + 1], F.struct(
            r["layer"].alias("layer"), r["type"].alias("type"), states[k].alias("before"), states[k + 1].alias("after"),
            F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("pos"))))
        return F.filter(changed, lambda c: c.isNotNull())

    log = let(F.col("_states"), records) if rules else F.expr(f"CAST(array() AS array<{CHANGE}>)")
    return (chained(df, text_col, [r.apply for r in rules])
            .withColumn(changes, log).withColumn(out, F.element_at("_states", -1)).drop("_states"))


def rule_hits(normalized: DataFrame, changes: str = "changes") -> DataFrame:
    """Texts changed per rule."""
    return (item_rows(normalized, [], F.col(changes), "c")
            .groupBy(F.col("c.type").alias("rule")).agg(F.count("*").alias("hits")))
