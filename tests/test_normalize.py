import pytest
from pyspark.sql import functions as F

from scribemend.functions.numerals import numeral_value, spell_number
from scribemend.operators import normalize as N

GOLDEN = [
    ("十八号道差开通反位，信号好了", "18号道差开通反位，信号好了。"), ("二零二五年", "2025年。"), ("三月五号", "3月5日。"),
    ("十点三十分", "10:30。"), ("百分之五十", "50%。"), ("限速八十公里每小时", "限速80km/h。"),
    ("一百三十四公里八百米", "K134+800。"), ("K一千零二十三次", "K1023次。"), ("四八六幺五次", "48615次。"),
    ("一四号道岔", "14号道岔。"), ("十八号道差", "18号道差。"), ("三道", "3道。"), ("一到发车", "1道发车。"),
    ("二号扳道员", "2号扳道员。"), ("g534次", "G534次。"), ("好、明白。。", "好，明白。"), ("请司机明白", "请司机明白。"),
    (" 中 文 G 12 ab ", "中文G 12 ab。"), ("G 1023次", "G1023次。"), ("", ""), ("  ", ""),
    ("列车调度员请注意三道接车进路已经准备", "列车，调度员，请注意，3道接车进路已经准备。"),
    ("坏字一三道", "坏字一3道。"),
]


@pytest.fixture(scope="module")
def normalized(spark):
    df = spark.createDataFrame(GOLDEN, "text string, want string")
    return {r.text: r for r in N.normalize(df).collect()}


@pytest.mark.parametrize("text,want", GOLDEN)
def test_golden(normalized, text, want):
    assert normalized[text].normalized == want


def test_changes_hold_whole_texts_in_order(normalized):
    changes = normalized["十八号道差开通反位，信号好了"].changes
    assert [c.type for c in changes] == ["numbered_term", "add_punctuation"]
    assert changes[0].before == "十八号道差开通反位，信号好了"
    assert changes[1].after == "18号道差开通反位，信号好了。"


def test_five_is_no_day_without_a_month(spark):
    row = spark.range(1).select(N.month_day(F.lit("五号道岔")).alias("x")).first()
    assert row.x == "五号道岔"


def test_second_run_changes_nothing(spark):
    df = spark.createDataFrame([(w,) for _, w in GOLDEN if w], "text string")
    again = N.normalize(df).filter("normalized <> text").count()
    assert again == 0


def test_numerals_round_trip_and_reject_malformed(spark):
    df = spark.range(0, 20000, 7).withColumn("s", spell_number(F.col("id")))
    assert df.filter(~numeral_value(F.col("s")).eqNullSafe(F.col("id"))).count() == 0
    bad = spark.createDataFrame([(x,) for x in ("一二", "百", "十百", "一千二", "零五", "")], "s string")
    assert bad.filter(numeral_value(F.col("s")).isNotNull()).count() == 0


def test_comma_not_in_front_of_numbered_asset(spark):
    row = spark.range(1).select(N.pause_commas(F.lit("请值班员5号道岔加锁")).alias("a"),
                                N.pause_commas(F.lit("请值班员马上去加锁")).alias("b")).first()
    assert (row.a, row.b) == ("请值班员5号道岔加锁", "请值班员，马上去加锁")
