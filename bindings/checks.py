"""Guard, evaluation, failures and service metrics over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import PAIRS_SQL, TURNS_SQL, counts_as_long, misheard_sql, pairs, plain_sql, read, turns, values, values_sql
from scribemend.operators import evaluate as E
from scribemend.operators import failures as X
from scribemend.operators import guard as G
from scribemend.operators import metrics as M
from scribemend.functions.text import numbers
from pyspark.sql import Window as W


def dispatches(spark, folder):
    """(id, before, after): dispatch texts made of the orders, some damaged on the way."""
    o = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.month("o_orderdate").alias("m"),
        F.dayofmonth("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p"))
    before = F.format_string("G%d次经%d号道岔进%d道，K%d+%03d限速%dkm/h，%d:%02d好了", "id", "cust", "m", "cust", "d",
                             F.col("d") + 20, "d", "m")
    o = o.withColumn("before", before)
    after = (F.when(F.col("p").startswith("1"), F.regexp_replace("before", r"^G(\d+)次", "G7$1次"))
             .when(F.col("p").startswith("2"), F.format_string("G%d次", "id"))
             .when(F.col("p").startswith("3"), F.concat("before", F.lit("。")))
             .when(F.col("p").startswith("4"), F.concat("before", F.lit("，"), "before")).otherwise(F.col("before")))
    return o.select("id", "p", "before", after.alias("after"))


DISPATCH_SQL = """SELECT id, p, m, d, cust, before, CASE left(p, 1) WHEN '1' THEN 'G7' || before[2:] WHEN '2' THEN 'G' || id || '次'
  WHEN '3' THEN before || '。' WHEN '4' THEN before || '，' || before ELSE before END AS after FROM (
  SELECT *, 'G' || id || '次经' || cust || '号道岔进' || m || '道，K' || cust || '+' || lpad(d::VARCHAR, 3, '0') || '限速' || (d + 20)
    || 'km/h，' || d || ':' || lpad(m::VARCHAR, 2, '0') || '好了' AS before FROM (
  SELECT o_orderkey AS id, o_custkey AS cust, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderpriority AS p FROM orders))"""


def entity_rows(spark, folder):
    rows = G.entity_rows(dispatches(spark, folder), "id", "before")
    return counts_as_long(rows.select("id", "type", "text", "value", "start", "end"))


_KINDS = {"train": ("'G' || id || '次'", "id"), "switch": ("cust || '号道岔'", "cust"), "track": ("m || '道'", "m"),
          "kilometer": ("'K' || cust || '+' || lpad(d::VARCHAR, 3, '0')", "cust || lpad(d::VARCHAR, 3, '0')"),
          "speed": ("'限速' || (d + 20) || 'km/h'", "(d + 20)"),
          "time": ("d || ':' || lpad(m::VARCHAR, 2, '0')", "d || ':' || lpad(m::VARCHAR, 2, '0')")}
ENTITY_SQL = " UNION ALL ".join(
    f"SELECT id, '{kind}' AS type, {text} AS text, ({value})::VARCHAR AS value, {lead} + strpos(before, {anchor} || {text}) AS start FROM ({DISPATCH_SQL})"
    for kind, (text, value) in _KINDS.items()
    for anchor, lead in [(("'经'", "0") if kind == "switch" else ("'进'", "0") if kind == "track" else ("'，'", "0") if kind in ("kilometer", "time")
                          else ("''", "-1"))])


def lost_entities(spark, folder):
    d = dispatches(spark, folder)
    return G.lost_entities(d.select("id", F.col("before").alias("text")), d.select("id", F.col("after").alias("text")))


def guard_results(spark, folder):
    d = dispatches(spark, folder).withColumn("g", G.guard(F.col("before"), F.col("after")))
    return d.select("id", F.col("g.passed").alias("passed"), F.coalesce("g.reason", F.lit("")).alias("reason"))


def turn_guard(spark, folder):
    """Every turn against the next one of its conversation: numbers and length kept?"""
    t = turns(spark, folder).withColumn("after", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    g = t.filter(F.col("after").isNotNull()).withColumn("g", G.guard(F.col("text"), F.col("after")))
    return g.select("id", F.col("g.passed").alias("passed"), F.coalesce("g.reason", F.lit("")).alias("reason"))


def repeat_injections(spark, folder):
    return G.repeat_injections(dispatches(spark, folder), "before", "after")


def turn_repeats(spark, folder):
    t = turns(spark, folder).withColumn("after", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return G.repeat_injections(t.filter(F.col("after").isNotNull()), "text", "after")


def _repeats_sql(source: str, before: str, after: str) -> str:
    def runs(text: str, b: int) -> str:
        return f"SELECT id, substr({text}, i, 5) AS run, {b} AS b FROM (SELECT id, {text}, unnest(range(1, length({text}) - 3)) AS i FROM ({source}) WHERE length({after}) > length({before}) + 2)"

    return f"""SELECT DISTINCT id FROM (SELECT id, run FROM ({runs(before, 1)} UNION ALL {runs(after, 0)})
GROUP BY id, run HAVING sum(b) >= 1 AND sum(1 - b) > sum(b))"""


TURN_PAIRS_SQL = f"SELECT * FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM ({TURNS_SQL})) WHERE after IS NOT NULL"


def cleaned_outputs(spark, folder):
    """Fenced, quoted and bare forms of every turn cleaned again."""
    fenced = F.concat(F.lit("```text\n"), "text", F.lit("\n```\n"))
    quoted = F.concat(F.lit(" 「"), "text", F.lit("」\n"))
    t = turns(spark, folder)
    return t.select("id", G.clean_output(fenced).alias("fenced"), G.clean_output(quoted).alias("quoted"),
                    G.clean_output(F.concat(F.lit("```"), "text")).alias("open"))


def merged_results(spark, folder):
    d = dispatches(spark, folder)
    refined = d.filter(~F.col("p").startswith("5")).select("id", F.concat(F.lit("```\n"), "after", F.lit("\n```")).alias("refined"))
    out = G.merge_refined(d.select("id", F.col("before").alias("text")), refined)
    return out.select("id", "final", "guard_passed", "changed", F.coalesce("reason", F.lit("")).alias("reason"))


def chosen_results(spark, folder):
    """Two candidate results for every pair: one restores the text, one drops letters."""
    p = pairs(spark, folder)
    a, b = F.replace("asr", F.lit("teh"), F.lit("the")), F.regexp_replace("correct", "[0-9]", "")
    return p.select("id", G.choose_result(F.col("asr"), F.col("asr"), a, b, F.contains(a, F.lit("the")), F.contains(b, F.lit("und")))
                    .alias("winner"))


def layered(spark, folder):
    """(id, correct, raw, layer1, layer2, layer3): repair step by step, the last step does harm."""
    return (pairs(spark, folder).withColumnRenamed("asr", "raw")
            .withColumn("layer1", F.replace("raw", F.lit("teh"), F.lit("the")))
            .withColumn("layer2", F.replace("layer1", F.lit("adn"), F.lit("and")))
            .withColumn("layer3", F.replace("layer2", F.lit("dre"), F.lit("der")))
            .withColumn("layer3", F.replace("layer3", F.lit("ing"), F.lit("in"))))


LAYERED_SQL = f"""SELECT id, correct, raw, layer1, layer2, replace(replace(layer2, 'dre', 'der'), 'ing', 'in') AS layer3 FROM (
  SELECT *, replace(layer1, 'adn', 'and') AS layer2 FROM (
    SELECT id, correct, asr AS raw, replace(asr, 'teh', 'the') AS layer1 FROM ({PAIRS_SQL})))"""
OUTPUTS = {"raw": "raw", "layer1": "layer1", "layer2": "layer2", "layer3": "layer3"}


def _cer(text: str, right: str = "correct") -> str:
    return (f"CASE WHEN greatest(length({text}), length({right})) = 0 THEN 0.0 "
            f"ELSE levenshtein({text}, {right}) / greatest(length({text}), length({right})) END")


RATED_SQL = f"SELECT *, {', '.join(f'{_cer(x)} AS {x}_cer' for x in OUTPUTS)} FROM ({LAYERED_SQL})"


def rated(spark, folder):
    return E.with_error_rates(layered(spark, folder), "correct", OUTPUTS)


def error_rates(spark, folder):
    return rated(spark, folder).select("id", *[F.round(f"{x}_cer", 6).alias(f"{x}_cer") for x in OUTPUTS])


def error_rate_summary(spark, folder):
    out = E.error_rate_summary(rated(spark, folder), "raw", list(OUTPUTS))
    return counts_as_long(out.withColumn("mean_cer", F.round("mean_cer", 6)))


def mode_comparison(spark, folder):
    r = rated(spark, folder)
    long = r.select("id", F.explode(F.array(*[F.struct(F.lit(x).alias("mode"), F.col(f"{x}_cer").alias("cer")) for x in OUTPUTS])).alias("x"))
    out = E.mode_comparison(long.select("id", "x.mode", "x.cer"), list(OUTPUTS))
    return out.select("id", *[F.round(x, 6).alias(x) for x in OUTPUTS])


# Reference terms of the accuracy figure.
REFERENCE_TERMS = [("the",), ("and",), ("ing",), ("der",), ("que",), ("station",), ("moron",)]


def term_accuracy(spark, folder):
    out = E.term_accuracy(layered(spark, folder), values(spark, REFERENCE_TERMS, "term string"), "correct", OUTPUTS)
    return counts_as_long(out.withColumn("accuracy", F.round("accuracy", 6)))


def entity_fidelity(spark, folder):
    share = E.entity_fidelity(F.col("before"), F.col("after"))
    return dispatches(spark, folder).groupBy("p").agg(F.round(F.avg(share), 6).alias("fidelity"), F.count("*").alias("texts"))


def failure_rows(spark, folder):
    d = layered(spark, folder)
    outputs = F.array("layer1", "layer2", "layer3", F.lit(None).cast("string"))
    return d.select("id", X.failure_class(F.col("raw"), F.col("layer3"), F.col("correct")).alias("failure_type"),
                    X.responsible_layer(F.col("raw"), F.col("correct"), outputs).alias("layer_responsible"))


def number_classes(spark, folder):
    """Failure classes where numbers change: dispatch texts before, after and as expected."""
    d = dispatches(spark, folder)
    return d.groupBy("p", X.failure_class(F.col("before"), F.col("after"), F.concat("before", F.lit("。"))).alias("failure_type")
                     ).agg(F.count("*").alias("n"))


def same_numbers(spark, folder):
    return dispatches(spark, folder).select("id", (numbers(F.col("before")) == numbers(F.col("after"))).alias("same"))


def layer_steps(spark, folder):
    d = layered(spark, folder)
    long = d.select("id", F.col("correct").alias("expected"), F.posexplode(F.array("raw", "layer1", "layer2", "layer3")).alias("layer_no", "text"))
    out = X.layer_steps(long)
    return out.select("id", F.col("layer_no").cast("long").alias("layer_no"), F.round("cer", 6).alias("cer"),
                      F.round("previous_cer", 6).alias("previous_cer"))


def failure_counts(spark, folder):
    return X.failure_counts(failure_rows(spark, folder))


def _classes(o: str, c: str, e: str) -> str:
    def nums(x: str) -> str:
        return f"list_sort(list_distinct(regexp_extract_all({x}, '\\d+')))"

    return (f"CASE WHEN {nums(c)} <> {nums(e)} AND {nums(o)} = {nums(e)} THEN '数字篡改' WHEN {c} = {o} THEN '漏纠' "
            f"WHEN {c} <> {e} THEN '过纠' ELSE '其他' END")


FAILURE_SQL = f"""SELECT id, {_classes('raw', 'layer3', 'correct')} AS failure_type, CASE
  WHEN layer1 <> raw AND layer1_cer > raw_cer + 0.01 THEN 'layer1'
  WHEN layer2 <> layer1 AND layer2_cer > layer1_cer + 0.01 THEN 'layer2'
  WHEN layer3 <> layer2 AND layer3_cer > layer2_cer + 0.01 THEN 'layer3'
  WHEN layer3 <> correct THEN 'layer4' WHEN layer2 <> correct THEN 'layer2' WHEN layer1 <> correct THEN 'layer1' ELSE 'unknown' END
  AS layer_responsible FROM ({RATED_SQL})"""


def _events(spark, folder):
    return read(spark, folder, "events")


def request_totals(spark, folder):
    return M.request_totals(_events(spark, folder), ["user_id"], F.col("event_type") == "error")


def latency_percentiles(spark, folder):
    out = M.exact_percentiles(_events(spark, folder), "event_type", "value")
    mean = _events(spark, folder).groupBy("event_type").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg"))
    return out.join(mean, "event_type").select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "avg")])


def latest_latency(spark, folder):
    recent = M.latest_samples(_events(spark, folder), ["event_type"], [F.desc("ts"), F.desc("event_id")], "event_id", 1000)
    out = M.bounded_latency(recent, ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "avg")])


def service_snapshot(spark, folder):
    out = M.service_snapshot(_events(spark, folder), ["user_id"], "value", F.col("event_type") == "error",
                             [F.desc("ts"), F.desc("event_id")], "event_id", 50)
    return out.select("user_id", "request_count", "error_count", "error_rate", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "avg")])


_P = "round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS avg"

QUERIES = {
    "entity_rows": entity_rows, "lost_entities": lost_entities, "guard_results": guard_results, "turn_guard": turn_guard,
    "repeat_injections": repeat_injections, "turn_repeats": turn_repeats, "cleaned_outputs": cleaned_outputs,
    "merged_results": merged_results, "chosen_results": chosen_results, "error_rates": error_rates,
    "error_rate_summary": error_rate_summary, "mode_comparison": mode_comparison, "term_accuracy": term_accuracy,
    "entity_fidelity": entity_fidelity, "failure_rows": failure_rows, "number_classes": number_classes,
    "same_numbers": same_numbers, "layer_steps": layer_steps, "failure_counts": failure_counts,
    "request_totals": request_totals, "latency_percentiles": latency_percentiles, "latest_latency": latest_latency,
    "service_snapshot": service_snapshot,
}
_REASON = "CASE left(p, 1) WHEN '1' THEN 'entity lost: train:' || id WHEN '2' THEN 'entity lost: switch:' || cust"
_A, _B = "replace(asr, 'teh', 'the')", "regexp_replace(correct, '[0-9]', '', 'g')"
_NUM = "list_sort(list_distinct(regexp_extract_all({}, '\\d+')))"
SQL = {
    "entity_rows": f"SELECT id, type, text, value, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS \"end\" FROM ({ENTITY_SQL})",
    "lost_entities": f"""SELECT id, 'train' AS type, id::VARCHAR AS value FROM ({DISPATCH_SQL}) WHERE left(p, 1) = '1'
UNION ALL SELECT e.id, e.type, e.value FROM ({ENTITY_SQL}) e JOIN ({DISPATCH_SQL}) d ON d.id = e.id AND left(p, 1) = '2' WHERE type <> 'train'""",
    "guard_results": f"SELECT id, left(p, 1) NOT IN ('1', '2') AS passed, {_REASON} ELSE '' END AS reason FROM ({DISPATCH_SQL})",
    "turn_guard": f"""SELECT id, length(after) >= length(text) * 0.5 AS passed, CASE WHEN length(after) < length(text) * 0.5
  THEN 'shortened: ' || length(text) || ' -> ' || length(after) ELSE '' END AS reason FROM ({TURN_PAIRS_SQL})""",
    "repeat_injections": _repeats_sql(DISPATCH_SQL, "before", "after"),
    "turn_repeats": _repeats_sql(TURN_PAIRS_SQL, "text", "after"),
    "cleaned_outputs": f"""SELECT id, trim(trim(text, E' \\n\\t'), '"''「」') AS fenced, trim(text, '"''「」') AS quoted, trim(CASE WHEN contains(text, chr(10))
  THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END, '"''「」') AS open FROM ({TURNS_SQL})""",
    "merged_results": f"""SELECT id, CASE WHEN left(p, 1) = '3' THEN after ELSE before END AS final, left(p, 1) = '3' AS guard_passed,
  left(p, 1) = '3' AS changed, {_REASON} WHEN '3' THEN '' WHEN '4' THEN 'repeated passage' ELSE 'no result' END AS reason FROM ({DISPATCH_SQL})""",
    "chosen_results": f"""SELECT id, CASE WHEN a = b THEN 'B' WHEN na = nr AND nb <> nr THEN 'A' WHEN nb = nr AND na <> nr THEN 'B'
  WHEN contains(a, 'the') AND NOT contains(b, 'und') THEN 'A' WHEN contains(b, 'und') AND NOT contains(a, 'the') THEN 'B'
  WHEN levenshtein(asr, a) < levenshtein(asr, b) THEN 'A' ELSE 'B' END AS winner FROM (
  SELECT *, {_NUM.format('a')} AS na, {_NUM.format('b')} AS nb, {_NUM.format('asr')} AS nr FROM (
    SELECT *, {_A} AS a, {_B} AS b FROM ({PAIRS_SQL})))""",
    "error_rates": f"SELECT id, {', '.join(f'round({x}_cer, 6) AS {x}_cer' for x in OUTPUTS)} FROM ({RATED_SQL})",
    "error_rate_summary": f"WITH rated AS MATERIALIZED ({RATED_SQL}) " + " UNION ALL ".join(
        f"""SELECT '{x}' AS output, round(avg({x}_cer), 6) AS mean_cer, count(*) FILTER ({x}_cer < raw_cer) AS improved,
  count(*) FILTER ({x}_cer = raw_cer) AS same, count(*) FILTER ({x}_cer > raw_cer) AS worse, count(*) AS texts FROM rated"""
        for x in OUTPUTS),
    "mode_comparison": f"SELECT id, {', '.join(f'round({x}_cer, 6) AS {x}' for x in OUTPUTS)} FROM ({RATED_SQL})",
    "term_accuracy": " UNION ALL ".join(f"""SELECT '{x}' AS output, count(*) FILTER (contains({x}, term)) AS found, count(*) AS expected,
  round(count(*) FILTER (contains({x}, term)) / count(*), 6) AS accuracy
FROM ({LAYERED_SQL}) JOIN {values_sql(REFERENCE_TERMS, 'term')} ON contains(correct, term)""" for x in OUTPUTS),
    "entity_fidelity": f"""SELECT p, round(avg(CASE left(p, 1) WHEN '1' THEN 5 / 6 WHEN '2' THEN 1 / 6 ELSE 1 END), 6) AS fidelity, count(*) AS texts
FROM ({DISPATCH_SQL}) GROUP BY p""",
    "failure_rows": FAILURE_SQL,
    "number_classes": f"""SELECT p, {_classes('before', 'after', 'expected')} AS failure_type, count(*) AS n FROM (
  SELECT *, before || '。' AS expected FROM ({DISPATCH_SQL})) GROUP BY 1, 2""",
    "same_numbers": f"SELECT id, {_NUM.format('before')} = {_NUM.format('after')} AS same FROM ({DISPATCH_SQL})",
    "layer_steps": f"WITH rated AS MATERIALIZED ({RATED_SQL}) " + " UNION ALL ".join(
        f"SELECT id, {k}::BIGINT AS layer_no, round({b}_cer, 6) AS cer, round({a}_cer, 6) AS previous_cer FROM rated WHERE {a} <> {b}"
        for k, (a, b) in enumerate((("raw", "layer1"), ("layer1", "layer2"), ("layer2", "layer3")), 1)),
    "failure_counts": f"""WITH f AS MATERIALIZED ({FAILURE_SQL}) SELECT 'by_type' AS kind, failure_type AS name, count(*) AS n FROM f GROUP BY 2
UNION ALL SELECT 'by_layer', layer_responsible, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM f""",
    "request_totals": """SELECT user_id, count(*) AS request_count, count(*) FILTER (event_type = 'error') AS error_count,
  round((count(*) FILTER (event_type = 'error') / count(*))::DECIMAL(18, 10), 4)::DOUBLE AS error_rate FROM events GROUP BY user_id""",
    "latency_percentiles": f"SELECT event_type, {_P} FROM events GROUP BY event_type",
    "latest_latency": f"""SELECT event_type, {_P} FROM (SELECT * FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000) GROUP BY event_type""",
    "service_snapshot": f"""SELECT * FROM (SELECT user_id, count(*) AS request_count, count(*) FILTER (event_type = 'error') AS error_count,
  round((count(*) FILTER (event_type = 'error') / count(*))::DECIMAL(18, 10), 4)::DOUBLE AS error_rate FROM events GROUP BY user_id)
JOIN (SELECT user_id, {_P} FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50)
  GROUP BY user_id) USING (user_id)""",
}
