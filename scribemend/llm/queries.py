"""The registered queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemend.llm import (bpe, dac, dialogue, divergence, exact, jaccard, mixing, neighbours, pages, pii, quality, toxicity,
                            warc)
from scribemend.llm.common import table


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked(table(spark, folder, "documents"))


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_text(table(spark, folder, "pages"))


def op5_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return dac.ids_written_and_read(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.measured(table(spark, folder, "documents"))
    return mixing.mix(mixing.with_quality(sizes, table(spark, folder, "labels")))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_copies(table(spark, folder, "documents")).drop("n_chars")


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages")).drop("url")


def op11_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.damaged_and_repaired(table(spark, folder, "conversations"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    "op1_bpe": op1_bpe, "op2_neighbours": op2_neighbours, "op3_jaccard": op3_jaccard, "op4_html": op4_html,
    "op5_token_ids": op5_token_ids, "op6_toxicity": op6_toxicity, "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup, "op9_pii": op9_pii, "op10_warc": op10_warc, "op11_dialogue": op11_dialogue,
    "op12_divergence": op12_divergence, "op13_quality": op13_quality,
}

def _edited(x: str, cost: int, letter: str, line: str = "") -> str:
    """SQL of a repair so far (cost, audit, lines) with one more edit."""
    lines = f"list_append({x}.r, {line})" if line else f"{x}.r"
    return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'r': {lines}}}"


def _least(*items: str) -> str:
    return f"list_sort([{', '.join(items)}])[1]"


def _inserted(x: str, role: str) -> str:
    return _edited(x, 5, "I", f"'{role}:'")


CLOSE_U = _least("u", _inserted("z", "user"), _inserted("s", "user"), _inserted("w", "user"))
CLOSE_W = _least("w", _inserted("u1", "assistant"))
FAR = "{'c': 1000000000, 'a': '', 'r': []::VARCHAR[]}"

SQL = {
    "op3_jaccard": r"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM said),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM reached JOIN both_ways ON x = doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n""",
    "op8_exact_dedup": r"""
WITH norm AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
              FROM documents),
ranked AS (SELECT doc_id, n, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size
           FROM norm WINDOW w AS (PARTITION BY n ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(n) AS text_sha256 FROM ranked""",
    "op7_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE q.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) q USING (doc_id)),
keyed AS (SELECT *, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5)
                        / 281474976710656.0::DOUBLE) / weight AS key FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
                    1.5::DOUBLE * sum(source_size) OVER () AS total FROM sources),
poured AS (
  SELECT 0 AS step, []::VARCHAR[] AS full_ones, max(total) / sum(w) AS level FROM weighted
  UNION ALL
  SELECT step + 1, f.names, f.level FROM poured p, LATERAL (
    SELECT list(coalesce('=' || source, 'null')) FILTER (2.0 * source_size < p.level * w) AS names,
           (max(total) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (2.0 * source_size < p.level * w), 0))
             / sum(w) FILTER (NOT 2.0 * source_size < p.level * w) AS level FROM weighted) f
  WHERE len(coalesce(f.names, [])) > len(p.full_ones)),
last AS (SELECT level FROM poured ORDER BY step DESC LIMIT 1),
targets AS (SELECT source, source_size, least(2.0 * source_size, level * w) AS target FROM weighted, last),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
placed AS (SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, round(b.target - b.epochs * b.source_size)::BIGINT AS budget,
                  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
           FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM placed""",
    "op10_warc": """
WITH paid AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM paid)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM firsts""",
    "op11_dialogue": f"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                                               lambda ch: ascii(ch)::BIGINT),
                         lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                                  lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS fate
  FROM conversations),
damaged AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE fate <> 0),
placed AS (SELECT *, coalesce('=' || conv_id, 'null') AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY name, role, text ORDER BY i) AS time, lead(i) OVER (PARTITION BY name ORDER BY i) IS NULL AS final,
                lag(substr(role, 1, 1)) OVER (PARTITION BY name ORDER BY i) AS before FROM placed),
faults AS (SELECT name, i, turn, role, text, final, before, said = '' AS blank, said <> '' AND time > 1 AS duplicate,
                  said <> '' AND time = 1 AND right(said, 1) NOT IN ('.', '!', '?') AS truncated FROM seen),
chain AS (
  SELECT DISTINCT name, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS z, {FAR} AS s, {FAR} AS u, {FAR} AS w FROM placed
  UNION ALL
  SELECT name, i, {_edited("z", 2, "D")},
         CASE WHEN NOT gone AND role[1] = 's' THEN {_least(_edited('s', 2, 'D'), "{'c': z.c + cut, 'a': z.a || 'K', 'r': list_append(z.r, role || ':' || text)}")}
              ELSE {_edited('s', 2, 'D')} END,
         CASE WHEN gone THEN {_edited('u1', 2, 'D')} ELSE {_least(_edited('u1', 2, 'D'), *[f"{{'c': {x}.c + cut + CASE role[1] WHEN 'u' THEN 0 ELSE 1 END, 'a': {x}.a || CASE role[1] WHEN 'u' THEN 'K' ELSE 'R' END, 'r': list_append({x}.r, CASE role[1] WHEN 'u' THEN role ELSE 'user' END || ':' || text)}}" for x in ('z', 's', 'w1')])} END,
         CASE WHEN gone THEN {_edited('w1', 2, 'D')} ELSE {_least(_edited('w1', 2, 'D'), "{'c': u1.c + cut + CASE role[1] WHEN 'a' THEN 0 ELSE 1 END, 'a': u1.a || CASE role[1] WHEN 'a' THEN 'K' ELSE 'R' END, 'r': list_append(u1.r, CASE role[1] WHEN 'a' THEN role ELSE 'assistant' END || ':' || text)}")} END
  FROM (SELECT *, {CLOSE_W} AS w1 FROM (
    SELECT c.name, c.z, c.s, c.u, c.w, {CLOSE_U} AS u1, f.i, f.role, f.text, f.blank OR f.duplicate AS gone, CASE WHEN f.truncated THEN 5 ELSE 0 END AS cut
    FROM chain c JOIN faults f ON f.name = c.name AND f.i = c.i + 1))),
ends AS (SELECT name, {_least('z', CLOSE_W)} AS best FROM (SELECT c.*, {CLOSE_U} AS u1 FROM chain c JOIN faults f ON f.name = c.name AND f.i = c.i AND f.final)),
counts AS (SELECT name, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                  count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY name)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, 'null') AS name FROM conversations) o
LEFT JOIN counts USING (name) LEFT JOIN ends USING (name)""",
    "op12_divergence": r"""
WITH said AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
per_doc AS (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(words) AS term FROM said) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM per_doc GROUP BY lang, term HAVING count(*) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM said),
counts AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM per_doc JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + l.v) AS p,
                  1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v) AS q
           FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a
          JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL
           SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
