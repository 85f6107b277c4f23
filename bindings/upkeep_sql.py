"""SQL of the upkeep queries."""

from bindings.common import UTTERANCES_SQL, values_sql
from bindings.lexical import ALIASES, CONFUSION, MARKER, SPANS_SQL, SQL as LEXICAL, _lexicon_sql, _masked_sql, _rewritten_sql
from bindings.upkeep import PARTS_SQL

_LINES = "SELECT unnest(string_split_regex(text, '\\r?\\n')) AS line FROM {}"


def _layers(source: str) -> str:
    """(id, n2, text2, text3, n3) after the alias and the confusion step."""
    sql = f"""SELECT id, len(regexp_extract_all(masked, '{MARKER}')) AS n2, {_rewritten_sql()} AS text2
FROM (SELECT id, text, {_masked_sql('text')} AS masked FROM {source})"""
    sql = f"SELECT *, text2 AS cur, 0 AS n3 FROM ({sql})"
    for wrong, right, _ in sorted(CONFUSION, key=lambda c: (-len(c[0]), c[2])):
        sql = f"""SELECT * EXCLUDE (cur, n3), CASE WHEN contains(cur, '{wrong}') THEN
  left(cur, strpos(cur, '{wrong}') - 1) || '{right}' || substr(cur, strpos(cur, '{wrong}') + {len(wrong)}) ELSE cur END AS cur,
  n3 + contains(cur, '{wrong}')::INT AS n3 FROM ({sql})"""
    return sql


DOCS = "(SELECT doc_id AS id, text FROM documents)"


def _confusion_hits() -> str:
    """One row per document and confused word that is replaced on the evolving text."""
    ordered = sorted(CONFUSION, key=lambda c: (-len(c[0]), c[2]))
    sql = f"SELECT id, {_rewritten_sql()} AS t0 FROM (SELECT id, text, {_masked_sql('text')} AS masked FROM {DOCS})"
    for k, (wrong, right, _) in enumerate(ordered):
        sql = f"""SELECT *, CASE WHEN contains(t{k}, '{wrong}') THEN left(t{k}, strpos(t{k}, '{wrong}') - 1) || '{right}'
  || substr(t{k}, strpos(t{k}, '{wrong}') + {len(wrong)}) ELSE t{k} END AS t{k + 1} FROM ({sql})"""
    return f"WITH s AS MATERIALIZED ({sql}) " + " UNION ALL ".join(
        f"SELECT 'context' AS layer, 'railway_confusion' AS type, '{w}' AS before, '{r}' AS after, count(*) AS n FROM s WHERE contains(t{k}, '{w}') HAVING n > 0"
        for k, (w, r, _) in enumerate(ordered))


SQL = {
    "error_types": """SELECT role AS error_type, count(*) AS n FROM conversations GROUP BY role
UNION ALL SELECT 'long', count(*) FROM conversations WHERE length(text) > 300""",
    "written_lines": """SELECT alias, arg_max(canonical, line_no) AS canonical, max(line_no) AS lex_order FROM (
  SELECT p_partkey AS line_no, p_name AS alias, lower(p_type) AS canonical FROM part WHERE p_size < 40 AND p_size % 10 <> 0) GROUP BY alias""",
    "json_lines": """SELECT upper(role) AS correct, role AS error_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
FROM conversations GROUP BY role""",
    "corpus_lines": f"""SELECT text, count(*) AS n FROM (SELECT trim(line, E' \\n\\t') AS text FROM ({_LINES.format('documents')})) WHERE text <> '' GROUP BY text""",
    "extended_corpus": f"""SELECT DISTINCT text FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM ({UTTERANCES_SQL}))
WHERE length(text) >= 2 AND regexp_matches(text, '\\p{{L}}')
  AND text NOT IN (SELECT trim(line, E' \\n\\t') FROM ({_LINES.format('conversations')}))""",
    "assembled_conversations": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id",
    "versioned_pages": """SELECT page_id, CASE WHEN last = '' THEN '.html' ELSE last END AS category
FROM (SELECT page_id, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) AS last FROM pages)""",
    "failure_log": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS failure_type, count(*) AS n FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' GROUP BY 1, 2""",
    "report_samples": "SELECT event_id AS id, 'layer' || (user_id % 4) AS layer_responsible FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20",
    "lexicon_versions": f"""SELECT 'all' AS version, count(*) AS n FROM {PARTS_SQL} UNION ALL
SELECT 'promo', count(*) FROM {PARTS_SQL} WHERE category IS NULL UNION ALL SELECT 'active', count(*) FROM {PARTS_SQL} WHERE category IS NULL""",
    "synced_versions": f"""WITH lines AS (SELECT p_name AS alias, lower(p_type) || ' ' || (p_size % 5) AS canonical,
  CASE WHEN p_partkey % 2 = 0 THEN 'v.md' ELSE 'v.txt' END AS doc, p_partkey AS pos FROM part)
SELECT 'v' AS version, alias, arg_max(canonical, doc || lpad(pos::VARCHAR, 12, '0')) AS canonical FROM lines GROUP BY alias
UNION ALL SELECT 'v', 'map of 1', p_name FROM part WHERE p_partkey = 1
UNION ALL SELECT '01', 'rows', count(*)::VARCHAR FROM {PARTS_SQL} WHERE enabled
UNION ALL SELECT '1.10', 'rows', count(*)::VARCHAR FROM {PARTS_SQL} WHERE category IS NULL UNION ALL SELECT 'gone', 'rows', '0'""",
    "listed_words": f"SELECT id, word FROM {PARTS_SQL} WHERE category = 'SMALL' AND enabled",
    "words_by_category": f"""SELECT coalesce(category, 'default') AS category, count(*) AS n, string_agg(word, '|' ORDER BY word) AS words
FROM {PARTS_SQL} WHERE enabled GROUP BY 1""",
    "inserted_words": f"""WITH p AS {PARTS_SQL}, old AS (SELECT * FROM p WHERE enabled), new AS (SELECT DISTINCT word, category FROM p WHERE NOT enabled),
marked AS (SELECT *, EXISTS (SELECT 1 FROM old WHERE old.word = new.word AND old.category IS NOT DISTINCT FROM new.category) AS clash FROM new)
SELECT word, category, count(*) AS n, 'kept' AS state FROM (SELECT word, category FROM old UNION ALL SELECT word, category FROM marked WHERE NOT clash) GROUP BY 1, 2
UNION ALL SELECT word, category, 1, 'rejected' FROM marked WHERE clash""",
    "updated_words": f"""SELECT id, CASE WHEN hit AND length(id) > 3 THEN 'renamed' ELSE word END AS word,
  CASE WHEN hit AND length(id) > 3 THEN NULL ELSE category END AS category, CASE WHEN hit AND length(id) <= 3 THEN FALSE ELSE enabled END AS enabled
FROM (SELECT *, id IN (SELECT l_partkey::VARCHAR FROM lineitem) AS hit FROM {PARTS_SQL})""",
    "missing_updates": f"SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders WHERE o_custkey::VARCHAR NOT IN (SELECT id FROM {PARTS_SQL} WHERE enabled)",
    "deleted_words": f"SELECT id, word FROM {PARTS_SQL} WHERE id NOT IN (SELECT l_partkey::VARCHAR FROM lineitem WHERE l_quantity > 40)",
    "snapshot_counts": f"SELECT count(*) FILTER (enabled) AS updated, 7::BIGINT AS deleted, count(*) FILTER (NOT enabled) AS skipped FROM {PARTS_SQL}",
    "lexicon_union": f"""SELECT DISTINCT word, term FROM (
  SELECT p_type AS word, p_type AS term FROM part UNION ALL SELECT alias, canonical FROM {values_sql(ALIASES, 'alias, canonical, o')}
  UNION ALL SELECT canonical, canonical FROM {values_sql(ALIASES, 'alias, canonical, o')}
  UNION ALL SELECT correct, correct FROM {values_sql(CONFUSION, 'wrong, correct, o')}
  UNION ALL SELECT word, word FROM {PARTS_SQL} WHERE enabled) WHERE word <> '' AND term <> ''""",
    "custom_vocabulary": "SELECT p_name AS word FROM part UNION SELECT lower(p_type) FROM part",
    "accepted_texts": """SELECT doc_id AS id, CASE WHEN text IS NULL OR length(text) < 1 THEN 'empty' WHEN length(text) > 4096 THEN 'too long'
  ELSE 'accepted' END AS state FROM documents""",
    "corrected_documents": f"""SELECT id, cur AS corrected, CASE WHEN n2 > 0 AND n3 > 0 THEN 'dictionary,context' WHEN n2 > 0 THEN 'dictionary'
  WHEN n3 > 0 THEN 'context' ELSE '' END AS layers, CAST(n2 + n3 AS BIGINT) AS n_changes FROM ({_layers(DOCS)})""",
    "corrected_turns_once": f"SELECT id, cur AS corrected, CAST(n2 + n3 AS BIGINT) AS n_changes FROM ({_layers(f'({UTTERANCES_SQL})')})",
    "stored_results": f"""SELECT 'dictionary' AS layer, 'alias_replace' AS type, alias AS before, canonical AS after, count(*) AS n
FROM ({SPANS_SQL}) JOIN {_lexicon_sql()} USING (lex_order) GROUP BY 3, 4 UNION ALL SELECT * FROM ({_confusion_hits()})""",
    "trigger_rates": f"""WITH d AS MATERIALIZED ({_layers(DOCS)}) SELECT 'layer2' AS layer, round(avg((n2 > 0)::INT), 6) AS rate FROM d
UNION ALL SELECT 'layer3', round(avg((n3 > 0)::INT), 6) FROM d""",
    "skipped_texts": f"SELECT id, NOT (n2 = 0 AND length(text2) <= 8) AS refined FROM ({_layers(f'({UTTERANCES_SQL})')})",
    "streamed_corrections": LEXICAL["alias_rewritten_texts"],
    "streamed_active_lexicon": f"SELECT id, corrected FROM ({LEXICAL['alias_rewritten_texts']})",
    # windows that the watermark has closed when the stream is drained: all days but the last one
    "streamed_metrics": """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS request_count, count(*) FILTER (event_type = 'error') AS error_count,
  round(avg(value), 6) AS avg FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY 1""",
    "streamed_once": "SELECT DISTINCT user_id, event_type FROM events",
}
