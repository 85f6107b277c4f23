"""Normalisation rules over whole tables.

The given texts hold no Chinese, so spoken numbers are spelled out by Spark from the
numbers of orders, parts, lineitem and events; the SQL side writes the expected text
straight from those numbers.  Rules that do not depend on Chinese run on documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import UTTERANCES_SQL, documents, read, utterances
from scribemend.functions.numerals import numeral_value, spell_digits, spell_number
from scribemend.operators import normalize as N


def _orders(spark, folder):
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("y"),
        F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"))


ORDERS = """(SELECT o_orderkey AS id, o_custkey AS cust, year(o_orderdate) AS y, month(o_orderdate) AS m,
  day(o_orderdate) AS d FROM orders)"""


def _events(spark, folder):
    return read(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"),
                                                F.hour("ts").alias("h"), F.minute("ts").alias("mi"))


EVENTS = "(SELECT event_id AS id, user_id AS u, hour(ts) AS h, minute(ts) AS mi FROM events)"


def _parts(spark, folder):
    return read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))


PARTS = "(SELECT p_partkey AS id, p_size AS size FROM part)"


def _spoken(*pieces):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _apply(df, text, rule, *more):
    return df.withColumn("spoken", text).select("id", rule(F.col("spoken")).alias("text"), *more)


def number_values(spark, folder):
    spelled = _orders(spark, folder).withColumn("spoken", spell_number(F.col("id")))
    broken = F.concat(F.col("spoken"), F.lit("一二"))
    return spelled.select("id", numeral_value(F.col("spoken")).alias("value"), numeral_value(broken).isNull().alias("rejected"))


def year_rule(spark, folder):
    text = _spoken("在", spell_digits(F.col("y")), "年到达")
    return _apply(_orders(spark, folder), text, N.year)


def month_day_rule(spark, folder):
    text = _spoken(spell_number(F.col("m")), "月", spell_number(F.col("d")), "号，", spell_number(F.col("m")), "号道岔")
    return _apply(_orders(spark, folder).withColumn("kept", spell_number(F.col("m"))), text, N.month_day, "kept")


SPOKEN_SMALL = ("['一','二','三','四','五','六','七','八','九','十','十一','十二']")


def time_rule(spark, folder):
    text = _spoken("现在", spell_number(F.col("h")), "点", spell_number(F.col("mi")), "分开车")
    return _apply(_events(spark, folder), text, N.clock_time)


def percent_rule(spark, folder):
    text = _spoken("空闲百分之", spell_number(F.col("user")), "。")
    return _apply(_events(spark, folder), text, N.percent)


def speed_rule(spark, folder):
    text = _spoken("限速", spell_number(F.col("size")), "公里每小时，限速", spell_number(F.col("size") + 100), "公里每小时")
    return _apply(_parts(spark, folder), text, N.speed)


def kilometre_rule(spark, folder):
    text = _spoken("在", spell_number(F.col("id")), "公里", spell_number(F.col("cust")), "米停车，k",
                   spell_number(F.col("cust")), " 公里 ", spell_number(F.col("id")), "米")
    return _apply(_orders(spark, folder), text, N.kilometre)


def train_number_rule(spark, folder):
    text = _spoken("G", spell_number(F.col("id")), "次与D ", spell_number(F.col("cust")), "次交会")
    return _apply(_orders(spark, folder), text, N.train_number)


def digit_by_digit_rule(spark, folder):
    digits = F.translate(spell_digits(F.col("id")), "一", "幺")
    spoken = _spoken("接", digits, "次，K", digits, " 道")
    return _orders(spark, folder).withColumn("t", spoken).select("id", N.digit_by_digit(F.col("t")).alias("text"))


def numbered_asset_rule(spark, folder):
    asset = F.when(F.col("size") < 10, "道岔").when(F.col("size") < 20, "信号机").when(F.col("size") < 30, "道").otherwise("线")
    text = _spoken(spell_number(F.col("size")), asset, "，", spell_number(F.col("size")), "号", asset)
    return _apply(_parts(spark, folder), text, N.numbered_asset)


def misheard_track_rule(spark, folder):
    line = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"))
    text = _spoken(spell_number(F.col("n")), "到发车，", spell_number(F.col("n")), "到那里")
    return _apply(line, text, N.misheard_track)


def stand_alone_rule(spark, folder):
    line = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"))
    text = _spoken(spell_number(F.col("n")), "号扳道员，", spell_number(F.col("n")), "号道岔")
    return _apply(line, text, N.stand_alone_number)


def train_prefix_rule(spark, folder):
    text = _spoken("接g", F.col("id").cast("string"), "次，z", F.col("cust").cast("string"), "次，g车")
    return _apply(_orders(spark, folder), text, N.train_prefix)


def spacing_rule(spark, folder):
    chinese = _spoken(" 列 车 ", F.col("id").cast("string"), " 次 G ", F.col("cust").cast("string"), " end of line ")
    ours = _orders(spark, folder).select("id", N.spacing(chinese).alias("text"))
    return ours.unionByName(documents(spark, folder).select((-F.col("id") - 1).alias("id"), N.spacing(F.col("text")).alias("text")))


def full_stop_rule(spark, folder):
    return documents(spark, folder).select("id", N.full_stops(F.translate("text", ",.", "、。")).alias("text"))


def terminal_mark(spark, folder):
    return documents(spark, folder).select("id", N.close_text(F.col("text")).alias("text"))


ROLES, ENDS, PAUSES = ["Then ", "und ", "pour ", "with "], ["the", "tion", "que", "der"], ["with", "that", "mit", "dans"]


def role_split(spark, folder):
    parts = documents(spark, folder).select("id", F.posexplode(N.role_segments(F.col("text"), ROLES)).alias("k", "segment"))
    return parts.select("id", F.col("k").cast("long").alias("k"), "segment")


def _role_split_sql() -> str:
    marked = "text"
    for role in ROLES:
        marked = f"replace({marked}, '{role}', chr(1) || '{role}')"
    return f"""SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k, segment FROM (
  SELECT id, i, trim(part, E' \\n\\t') AS segment FROM (
    SELECT id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT doc_id AS id, string_split({marked}, chr(1)) AS parts FROM documents))) WHERE segment <> ''"""


def sentence_close(spark, folder):
    return utterances(spark, folder).select("id", N.close_segment(F.col("text"), ENDS).alias("text"))


def pause_commas(spark, folder):
    return utterances(spark, folder).select("id", N.pause_commas(F.col("text"), PAUSES).alias("text"))


def _pause_sql() -> str:
    text = "text"
    for word in PAUSES:
        text = f"regexp_replace({text}, '({word})([^，。；！？、\\s])', '\\1，\\2', 'g')"
    return f"SELECT id, {text} AS text FROM ({UTTERANCES_SQL})"


# A rule of the user's own is a name and a function on Columns.
LATIN_RULES = [
    N.Rule("marks", lambda c: F.regexp_replace(c, r"[&*#%$]{3}", "")),
    N.Rule("pipes", lambda c: F.replace(c, F.lit(" | "), F.lit("; "))),
    N.Rule("blanks", lambda c: F.regexp_replace(c, " {2,}", " ")),
    N.Rule("numbers", lambda c: F.regexp_replace(c, r"(\d)-(\d)", "$1 to $2")),
]


def custom_rules(spark, folder):
    out = N.normalize(documents(spark, folder), rules=LATIN_RULES)
    return out.select("id", "normalized", F.size("changes").cast("long").alias("n_changes"))


def rule_hits(spark, folder):
    return N.rule_hits(N.normalize(documents(spark, folder), rules=LATIN_RULES))


def _latin_sql() -> str:
    sql = "SELECT doc_id AS id, text AS s0 FROM documents"
    rules = ["regexp_replace(s0, '[&*#%$]{3}', '', 'g')", "replace(s1, ' | ', '; ')", "regexp_replace(s2, ' {2,}', ' ', 'g')",
             "regexp_replace(s3, '(\\d)-(\\d)', '\\1 to \\2', 'g')"]
    for k, rule in enumerate(rules):
        sql = f"SELECT *, {rule} AS s{k + 1} FROM ({sql})"
    return sql


def spoken_dispatch(spark, folder):
    """All rules in order on full utterances made of order and customer numbers."""
    text = _spoken("G", spell_number(F.col("id")), "次列车司机请注意", spell_number(F.col("m")), "月",
                   spell_number(F.col("d")), "号在", spell_number(F.col("cust")), "公里", spell_number(F.col("d")),
                   "米限速", spell_number(F.col("d") + 20), "公里每小时经", spell_number(F.col("m")), "号道差进",
                   spell_number(F.col("d")), "道")
    out = N.normalize(_orders(spark, folder).withColumn("text", text))
    return out.select("id", F.col("normalized").alias("text"),
                      F.array_join(F.transform("changes", lambda c: c["type"]), ",").alias("rules"))


QUERIES = {
    "number_values": number_values, "year_rule": year_rule, "month_day_rule": month_day_rule, "time_rule": time_rule,
    "percent_rule": percent_rule, "speed_rule": speed_rule, "kilometre_rule": kilometre_rule,
    "train_number_rule": train_number_rule, "digit_by_digit_rule": digit_by_digit_rule,
    "numbered_asset_rule": numbered_asset_rule, "misheard_track_rule": misheard_track_rule,
    "stand_alone_rule": stand_alone_rule, "train_prefix_rule": train_prefix_rule, "spacing_rule": spacing_rule,
    "full_stop_rule": full_stop_rule, "terminal_mark": terminal_mark, "role_split": role_split,
    "sentence_close": sentence_close, "pause_commas": pause_commas, "custom_rules": custom_rules,
    "rule_hits": rule_hits, "spoken_dispatch": spoken_dispatch,
}
_LONG_DAY = f"CASE WHEN d < 30 THEN '二十' || {SPOKEN_SMALL}[d - 20] ELSE '三十一' END"
_ASSET = "CASE WHEN size < 10 THEN '道岔' WHEN size < 20 THEN '信号机' WHEN size < 30 THEN '道' ELSE '线' END"
SQL = {
    "number_values": "SELECT o_orderkey AS id, o_orderkey AS value, TRUE AS rejected FROM orders",
    "year_rule": f"SELECT id, '在' || y || '年到达' AS text FROM {ORDERS}",
    # a day of three characters (21-29, 31) does not count as a date
    "month_day_rule": f"""SELECT id, m || '月' || CASE WHEN d <= 20 OR d = 30 THEN d || '日' ELSE {_LONG_DAY} || '号' END || '，' || kept || '号道岔' AS text, kept
FROM (SELECT *, {SPOKEN_SMALL}[m] AS kept FROM {ORDERS})""",
    "time_rule": f"SELECT id, '现在' || h || ':' || lpad(mi::VARCHAR, 2, '0') || '开车' AS text FROM {EVENTS}",
    "percent_rule": f"SELECT id, '空闲' || u || '%。' AS text FROM {EVENTS}",
    "speed_rule": f"SELECT id, '限速' || size || 'km/h，限速' || (size + 100) || 'km/h' AS text FROM {PARTS}",
    "kilometre_rule": f"""SELECT id, '在K' || id || '+' || CASE WHEN cust < 1000 THEN lpad(cust::VARCHAR, 3, '0') ELSE cust::VARCHAR END
  || '停车，K' || cust || '+' || CASE WHEN id < 1000 THEN lpad(id::VARCHAR, 3, '0') ELSE id::VARCHAR END AS text FROM {ORDERS}""",
    "train_number_rule": f"SELECT id, 'G' || id || '次与D' || cust || '次交会' AS text FROM {ORDERS}",
    "digit_by_digit_rule": f"""SELECT id, CASE WHEN id > 9 THEN '接' || id || '次，K' || id || '道'
  ELSE '接' || ['零','幺','二','三','四','五','六','七','八','九'][id + 1] || '次，K'
    || ['零','幺','二','三','四','五','六','七','八','九'][id + 1] || ' 道' END AS text FROM {ORDERS}""",
    "numbered_asset_rule": f"""SELECT id, size || CASE WHEN asset IN ('道', '线') THEN '' ELSE '号' END || asset || '，' || size || '号' || asset
  AS text FROM (SELECT *, {_ASSET} AS asset FROM {PARTS})""",
    "misheard_track_rule": f"SELECT l_orderkey AS id, l_linenumber || '道发车，' || {SPOKEN_SMALL}[l_linenumber] || '到那里' AS text FROM lineitem",
    "stand_alone_rule": f"SELECT l_orderkey AS id, l_linenumber || '号扳道员，' || {SPOKEN_SMALL}[l_linenumber] || '号道岔' AS text FROM lineitem",
    "train_prefix_rule": f"SELECT id, '接G' || id || '次，Z' || cust || '次，g车' AS text FROM {ORDERS}",
    "spacing_rule": f"""SELECT id, '列车' || id || '次G ' || cust || ' end of line' AS text FROM {ORDERS} UNION ALL
SELECT -doc_id - 1 AS id, trim(regexp_replace(text, '(^|[^\\p{{L}}\\p{{N}}_])([A-Za-z])\\s+(\\d)', '\\1\\2\\3', 'g'), E' \\n\\t') AS text FROM documents""",
    "full_stop_rule": """SELECT doc_id AS id, regexp_replace(replace(translate(text, ',.', '、。'), '、', '，'), '。{2,}', '。', 'g') AS text
FROM documents""",
    "terminal_mark": """SELECT doc_id AS id, CASE WHEN right(text, 1) IN ('.', '。', '!', '！', '?', '？') THEN text ELSE text || '。' END AS text
FROM documents""",
    "role_split": _role_split_sql(),
    "sentence_close": f"""SELECT id, CASE WHEN regexp_matches(text, '(?:{'|'.join(ENDS)})$') AND NOT regexp_matches(text, '[.。!！?？]$')
  THEN text || '。' ELSE text END AS text FROM ({UTTERANCES_SQL})""",
    "pause_commas": _pause_sql(),
    "custom_rules": f"""SELECT id, s4 AS normalized, CAST((s1 <> s0)::INT + (s2 <> s1)::INT + (s3 <> s2)::INT + (s4 <> s3)::INT AS BIGINT)
  AS n_changes FROM ({_latin_sql()})""",
    "rule_hits": " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS hits FROM ({_latin_sql()}) WHERE s{k + 1} <> s{k} HAVING count(*) > 0"
        for k, name in enumerate(("marks", "pipes", "blanks", "numbers"))),
    "spoken_dispatch": f"""SELECT id, 'G' || id || '次列车司机，请注意，' || m || '月'
  || CASE WHEN d <= 20 OR d = 30 THEN d || '日' WHEN d < 30 THEN '二十' || (d - 20) || '号' ELSE '三十1号' END || '在K' || cust || '+' || lpad(d::VARCHAR, 3, '0')
  || '限速' || (d + 20) || 'km/h经' || m || '号道差进' || d || '道。' AS text,
  'month_day,speed,kilometer,train_number,numbered_term,' || CASE WHEN d <= 20 OR d = 30 THEN '' ELSE 'standalone_number,' END
  || 'add_punctuation' AS rules FROM {ORDERS}""",
}
