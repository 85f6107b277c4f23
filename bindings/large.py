"""Rule tables that grow with the data: every sentence end or word of the given texts is a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import TURNS_SQL, documents, turns
from bindings.upkeep import _drained, _stream
from scribemend.operators import aliases as A
from scribemend.operators import evaluate as E
from scribemend.operators import lookup as L
from scribemend.operators import rewrites as R
from scribemend.plans import correct as P
from scribemend.session import new_table_path, stored
from scribemend.streaming import transcripts as Y

# The last letters of a sentence with its full stop, and words of some length.
ENDING, WORD, LONG_WORD = r"[a-z]{2,}\.", "[a-z]{5,}", "[a-z]{11,}"


def _found(texts, pattern):
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("word")).distinct()


def _mark(word):
    return F.regexp_replace(word, r"\.$", "!")


def endings(spark, folder):
    """Each distinct sentence end of the documents as an alias: thousands, many of them ends of others."""
    words = _found(documents(spark, folder), ENDING)
    return words.select(F.col("word").alias("alias"), _mark("word").alias("canonical"), F.lit(0).cast("long").alias("lex_order"))


def large_lexicon_rewrites(spark, folder):
    out = A.resolve_aliases(documents(spark, folder), endings(spark, folder))
    return out.select("id", F.col("resolved.text").alias("corrected"), F.size("resolved.spans").cast("long").alias("n_changes"))


def large_lexicon_by_joins(spark, folder):
    """The same over the bound of an index, on the turns of the conversations."""
    out = A.resolve_aliases(turns(spark, folder), endings(spark, folder), limit=0)
    return out.select("id", F.col("resolved.text").alias("corrected"), F.size("resolved.spans").cast("long").alias("n_changes"))


def streamed_large_lexicon(spark, folder):
    """A lexicon within the bound of an index is a projection of the stream, a larger one meets micro-batches by joins."""
    stream, lexicon = _stream(spark, folder, "documents", ["doc_id", "text"]), endings(spark, folder)
    try:
        done = _drained(spark, Y.correct_stream(stream, P.stateless_aliases(P.Resources(aliases=lexicon))), "large")
    except P.LexiconTooLarge:
        out = new_table_path(spark, "large")
        Y.correct_batches(stream, stored(lexicon, "lexicon"), out, new_table_path(spark, "large-mark")).awaitTermination()
        done = spark.read.parquet(out)
    return done.select(F.col("doc_id").alias("id"), "corrected", F.size("changes").cast("long").alias("n_changes"))


def large_confusion_rewrites(spark, folder):
    """Each distinct sentence end is a confused word: a text takes every one that it holds, once, longest first."""
    table = endings(spark, folder).select(F.col("alias").alias("wrong"), F.col("canonical").alias("correct"), "lex_order")
    out = R.replace_confusions(documents(spark, folder), table)
    return out.select("id", F.col("replaced").alias("corrected"), F.size("hits").cast("long").alias("n_changes"))


def held_terms(spark, folder):
    """How many distinct long words of the conversations each document holds, also inside of others."""
    terms = _found(turns(spark, folder), LONG_WORD).withColumnRenamed("word", "string")
    held = L.with_held_strings(documents(spark, folder), terms)
    size = F.aggregate("held", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w))
    return held.select("id", F.size("held").cast("long").alias("n_terms"), size.alias("letters"))


def held_terms_by_joins(spark, folder):
    """The same the other way round and over the bound of an index: words of the documents in the turns."""
    terms = _found(documents(spark, folder), WORD).withColumnRenamed("word", "string")
    held = L.held_strings(turns(spark, folder), terms, limit=0)
    return held.groupBy("string").agg(F.count("*").alias("n_texts"))


def term_accuracy_of_all_words(spark, folder):
    """Reference terms are all words of the documents, found again in the turns without their letter e."""
    terms = _found(documents(spark, folder), WORD).withColumnRenamed("word", "term")
    rated = turns(spark, folder).withColumn("less", F.replace("text", F.lit("e"), F.lit("")))
    return E.term_accuracy(rated, terms, "text", {"less": "less"}).withColumn("accuracy", F.round("accuracy", 6))


QUERIES = {
    "large_lexicon_rewrites": large_lexicon_rewrites, "large_lexicon_by_joins": large_lexicon_by_joins,
    "streamed_large_lexicon": streamed_large_lexicon, "large_confusion_rewrites": large_confusion_rewrites,
    "held_terms": held_terms, "held_terms_by_joins": held_terms_by_joins, "term_accuracy_of_all_words": term_accuracy_of_all_words,
}


def _endings_sql(source: str) -> str:
    return f"""SELECT id, regexp_replace(text, '([a-z]{{2,}})\\.', '\\1!', 'g') AS corrected,
  len(regexp_extract_all(text, '{ENDING}'))::BIGINT AS n_changes FROM ({source})"""


DOCS_SQL = "SELECT doc_id AS id, text FROM documents"
#: A turn's sentence ends need not be ones of the documents: the longest end of each that is.
_TURN_SQL = f"""WITH ends AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{ENDING}')) AS e FROM documents),
pieces AS (SELECT id, unnest(regexp_extract_all(text, '(?s)[^.]*\\.|[^.]+$')) AS piece,
                  generate_subscripts(regexp_extract_all(text, '(?s)[^.]*\\.|[^.]+$'), 1) AS k FROM ({TURNS_SQL})),
tried AS (SELECT id, k, piece, unnest(range(length(regexp_extract(piece, '{ENDING}$')), 1, -1)) AS n FROM pieces),
best AS (SELECT id, k, max(n) AS n FROM tried JOIN ends ON e = right(piece, n) GROUP BY id, k),
done AS (SELECT id, k, best.n IS NOT NULL AS hit, CASE WHEN best.n IS NULL THEN piece ELSE left(piece, length(piece) - 1) || '!' END AS piece
         FROM pieces LEFT JOIN best USING (id, k))
SELECT t.id, coalesce(string_agg(piece, '' ORDER BY k), any_value(t.text)) AS corrected, count(*) FILTER (hit) AS n_changes
FROM ({TURNS_SQL}) t LEFT JOIN done ON done.id = t.id GROUP BY t.id"""

SQL = {
    "large_lexicon_rewrites": _endings_sql(DOCS_SQL),
    "streamed_large_lexicon": _endings_sql(DOCS_SQL),
    "large_lexicon_by_joins": _TURN_SQL,
    "large_confusion_rewrites": f"""WITH runs AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '{ENDING}')) AS run FROM documents),
ends AS (SELECT DISTINCT run AS w FROM runs),
held AS (SELECT DISTINCT id, w FROM (SELECT id, run, unnest(range(3, length(run) + 1)) AS n FROM runs) JOIN ends ON w = right(run, n)),
lists AS (SELECT id, list(w ORDER BY length(w) DESC, w) AS ws FROM held GROUP BY id),
done AS (SELECT doc_id AS id, text, CASE WHEN ws IS NULL THEN text ELSE list_reduce(list_prepend(text, ws), lambda acc, w:
    CASE WHEN contains(acc, w) THEN left(acc, instr(acc, w) + length(w) - 2) || '!' || substr(acc, instr(acc, w) + length(w)) ELSE acc END) END AS corrected
  FROM documents LEFT JOIN lists ON id = doc_id)
SELECT id, corrected, length(replace(text, '!', '')) - length(replace(corrected, '!', '')) AS n_changes FROM done""",
    "held_terms": f"""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{LONG_WORD}')) AS term FROM conversations)
SELECT doc_id AS id, count(term) AS n_terms, coalesce(sum(length(term)), 0)::BIGINT AS letters FROM documents LEFT JOIN terms ON contains(text, term)
GROUP BY doc_id""",
    "held_terms_by_joins": f"""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS term FROM documents)
SELECT term AS string, count(*) AS n_texts FROM ({TURNS_SQL}) JOIN terms ON contains(text, term) GROUP BY term""",
    "term_accuracy_of_all_words": f"""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS term FROM documents),
held AS (SELECT contains(replace(text, 'e', ''), term) AS hit FROM ({TURNS_SQL}) JOIN terms ON contains(text, term))
SELECT 'less' AS output, count(*) FILTER (hit) AS found, count(*) AS expected, round(count(*) FILTER (hit) / count(*), 6) AS accuracy FROM held""",
}
