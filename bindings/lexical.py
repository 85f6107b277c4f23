"""Alias, phrase, confusion and pattern rewrites of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import counts_as_long, documents, values
from scribemend.operators import aliases as A
from scribemend.operators import rewrites as R

# Overlapping aliases, an identity alias, an empty one and a single character.
ALIASES = [("the", "ze", 1), ("th", "z", 2), ("thin", "sin", 3), ("and", "und", 4), ("he", "hee", 5),
           ("er", "err", 6), ("tion", "shun", 7), ("in", "inn", 8), ("on", "on", 9), ("", "nothing", 10),
           ("a", "ah", 11), ("ing", "eng", 12), ("que", "ke", 13), ("ung", "oong", 14)]
CONFUSION = [("thion", "thyon", 1), ("of the", "off the", 2), ("inge", "inje", 3), ("der", "dair", 4),
             ("reer", "rear", 5), ("eau", "oh", 6), ("sh", "ch", 7), ("el", "ell", 8)]
PHRASES = [(1, r"&&&|\*\*\*|###|%%%|\$\$\$", ""), (2, r"(\w)\1\1", r"\1\1"), (3, " (of|to) (the|a) ", r" \1 that "),
           (4, "  +", " ")]
TERMS = [("theta", ["the", "then", "that"], ["of theta", "to theta [a-z]"], 1),
         ("shun", ["tion"], ["shun and", "no match here"], 2), ("unused", [], ["unused"], 3)]

ALIAS_SCHEMA = "alias string, canonical string, lex_order long"


def alias_table(spark):
    return values(spark, ALIASES, ALIAS_SCHEMA)


def _ordered():
    return sorted([a for a in ALIASES if a[0] and a[0] != a[1]], key=lambda a: (-len(a[0]), a[2]))


FIRST, FILL, LAST_FILL = 0xE100, chr(0xE200), chr(0xE1FF)


def _masked_sql(text: str) -> str:
    """Kept spans become a marker of their alias and fillers up to the alias length."""
    word = f"[\\p{{L}}\\p{{N}}_{chr(FIRST)}-{FILL}]"
    for alias, _, order in _ordered():
        mark = chr(FIRST + order) + FILL * (len(alias) - 1)
        if len(alias) > 1:
            text = f"replace({text}, '{alias}', '{mark}')"
        else:
            lone = f"(^|[^{word[1:-1]}]){alias}([^{word[1:-1]}]|$)"
            for _ in range(2):
                text = f"regexp_replace({text}, '{lone}', '\\1{mark}\\2', 'g')"
    return text


MASKED_SQL = f"SELECT doc_id AS id, text, {_masked_sql('text')} AS masked FROM documents"
MARKER = f"[{chr(FIRST)}-{LAST_FILL}]"
SPANS_SQL = f"""SELECT id, ord(right(piece, 1)) - {FIRST} AS lex_order,
  CAST(sum(length(piece)) OVER (PARTITION BY id ORDER BY k) - 1 AS BIGINT) AS pos
FROM (SELECT id, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS k
      FROM (SELECT id, regexp_extract_all(masked, '(?s)[^{chr(FIRST)}-{LAST_FILL}]*{MARKER}') AS pieces
            FROM ({MASKED_SQL})))"""


def _rewritten_sql() -> str:
    text = "masked"
    for alias, canonical, order in _ordered():
        text = f"replace({text}, '{chr(FIRST + order) + FILL * (len(alias) - 1)}', '{canonical}')"
    return text


def _lexicon_sql() -> str:
    body = ", ".join(f"('{a}', '{c}', {o})" for a, c, o in _ordered())
    return f"(VALUES {body}) AS l(alias, canonical, lex_order)"


def alias_span_matches(spark, folder):
    found = A.alias_occurrences(documents(spark, folder), alias_table(spark))
    return counts_as_long(found.groupBy("id", "alias").agg(
        F.count("*").alias("matches"), F.sum(F.col("pos").cast("long")).alias("pos_sum"), F.max("pos").alias("last_pos")))


def _span_matches_sql() -> str:
    parts = [f"""SELECT id, '{a}' AS alias, sum(length(piece)) OVER w + (row_number() OVER w - 1) * {len(a)} AS pos,
  row_number() OVER w AS k, n FROM (SELECT doc_id AS id, unnest(string_split(text, '{a}')) AS piece,
  unnest(range(1, len(string_split(text, '{a}')) + 1)) AS i, len(string_split(text, '{a}')) AS n FROM documents)
WINDOW w AS (PARTITION BY id ORDER BY i)""" for a, _, _ in _ordered()]
    return f"""SELECT id, alias, count(*) AS matches, CAST(sum(pos) AS BIGINT) AS pos_sum,
  CAST(max(pos) AS BIGINT) AS last_pos
FROM ({' UNION ALL '.join(parts)}) WHERE k < n GROUP BY id, alias"""


def alias_kept_spans(spark, folder):
    spans = A.kept_spans(documents(spark, folder), alias_table(spark))
    return counts_as_long(spans.select("id", "pos", "lex_order"))


def alias_rewritten_texts(spark, folder):
    out = A.resolve_aliases(documents(spark, folder), alias_table(spark))
    return out.select("id", F.col("resolved.text").alias("corrected"),
                      F.size("resolved.spans").cast("long").alias("n_changes"))


def correction_summary(spark, folder):
    spans = A.kept_spans(documents(spark, folder), alias_table(spark))
    per_text = spans.groupBy("alias", "canonical", "id").agg(F.count("*").alias("n"))
    return per_text.groupBy("alias", "canonical").agg(F.sum("n").alias("replacements"),
                                                      F.count("*").alias("texts_changed"))


def confusion_replace(spark, folder):
    table = values(spark, CONFUSION, "wrong string, correct string, lex_order long")
    out = R.replace_confusions(documents(spark, folder), table)
    return out.select("id", F.col("replaced").alias("corrected"), F.size("hits").cast("long").alias("n_changes"))


def _confusion_sql() -> str:
    sql = "SELECT doc_id AS id, text AS cur, 0 AS n FROM documents"
    for wrong, right, _ in sorted(CONFUSION, key=lambda c: (-len(c[0]), c[2])):
        sql = f"""SELECT id, CASE WHEN contains(cur, '{wrong}') THEN
  left(cur, strpos(cur, '{wrong}') - 1) || '{right}' || substr(cur, strpos(cur, '{wrong}') + {len(wrong)})
  ELSE cur END AS cur, n + contains(cur, '{wrong}')::INT AS n FROM ({sql})"""
    return f"SELECT id, cur AS corrected, CAST(n AS BIGINT) AS n_changes FROM ({sql})"


def phrase_replace(spark, folder):
    rules = R.phrase_rules(values(spark, PHRASES, "rule_no long, pattern string, replacement string"))
    out = R.replace_phrases(documents(spark, folder), rules)
    return out.select("id", F.col("replaced").alias("corrected"), F.size("phrase_changes").cast("long").alias("n_changes"))


def _phrase_sql() -> str:
    steps = "SELECT doc_id AS id, text AS cur, 0 AS n FROM documents"
    sql_rules = [(PHRASES[0][1], ""), None, (PHRASES[2][1], " \\1 that "), (PHRASES[3][1], " ")]
    for rule in sql_rules:
        if rule is None:
            # no back-references in this SQL engine: three equal word characters, one letter at a time
            letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
            new = "cur"
            for ch in letters:
                new = f"regexp_replace({new}, '{ch}{{3}}', '{ch}{ch}', 'g')"
        else:
            new = f"regexp_replace(cur, '{rule[0]}', '{rule[1]}', 'g')"
        steps = f"SELECT id, new AS cur, n + (new <> cur)::INT AS n FROM (SELECT id, cur, n, {new} AS new FROM ({steps}))"
    return f"SELECT id, cur AS corrected, CAST(n AS BIGINT) AS n_changes FROM ({steps})"


def term_pattern_replace(spark, folder):
    terms = values(spark, TERMS, "canonical string, aliases array<string>, patterns array<string>, lex_order long")
    out = R.replace_by_patterns(documents(spark, folder), R.tolerant_rules(terms))
    return out.select("id", F.col("replaced").alias("corrected"),
                      F.size("pattern_changes").cast("long").alias("n_changes"))


_STEP1 = "regexp_replace(text, 'of (?:theta|the|then|that)', 'of theta', 'g')"
_STEP2 = "regexp_replace(one, 'to (?:the|then|that)( [a-z])', 'to theta\\1', 'g')"
_STEP3 = "regexp_replace(two, '(?:shun|tion) and', 'shun and', 'g')"
_TERM_SQL = f"""SELECT id, three AS corrected, CAST(
    len(regexp_extract_all(text, 'of (?:theta|the|then|that)')) - len(regexp_extract_all(text, 'of theta'))
  + len(regexp_extract_all(one, 'to (?:the|then|that) [a-z]'))
  + len(regexp_extract_all(two, 'tion and')) AS BIGINT) AS n_changes
FROM (SELECT *, {_STEP3} AS three FROM (SELECT *, {_STEP2} AS two FROM (
  SELECT doc_id AS id, text, {_STEP1} AS one FROM documents)))"""

QUERIES = {
    "correction_summary": correction_summary,
    "alias_span_matches": alias_span_matches,
    "alias_kept_spans": alias_kept_spans,
    "alias_rewritten_texts": alias_rewritten_texts,
    "confusion_replace": confusion_replace,
    "phrase_replace": phrase_replace,
    "term_pattern_replace": term_pattern_replace,
}
SQL = {
    "correction_summary": f"""SELECT alias, canonical, count(*) AS replacements, count(DISTINCT id) AS texts_changed
FROM ({SPANS_SQL}) s JOIN {_lexicon_sql()} USING (lex_order) GROUP BY alias, canonical""",
    "alias_span_matches": _span_matches_sql(),
    "alias_kept_spans": f"SELECT id, pos, CAST(lex_order AS BIGINT) AS lex_order FROM ({SPANS_SQL})",
    "alias_rewritten_texts": f"""SELECT id, {_rewritten_sql()} AS corrected,
  CAST(len(regexp_extract_all(masked, '{MARKER}')) AS BIGINT) AS n_changes FROM ({MASKED_SQL})""",
    "confusion_replace": _confusion_sql(),
    "phrase_replace": _phrase_sql(),
    "term_pattern_replace": _TERM_SQL,
}
