"""Sources, sinks, lexicon upkeep, correction jobs and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import documents, read, turns, utterances, values
from bindings.lexical import CONFUSION, alias_table
from scribemend.operators import lexicon as L
from scribemend.plans import correct as P
from scribemend.plans import jobs as J
from scribemend.session import new_table_path
from scribemend.sources import corpus as S
from scribemend.sources import lexicons as X
from scribemend.sources import stores as T
from scribemend.streaming import transcripts as Y


def _parts(spark, folder):
    """The parts as a lexicon: name, type as category (one type without), small ones disabled."""
    p = read(spark, folder, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("word"),
                    F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("category"), (F.col("p_size") > 5).alias("enabled"))


PARTS_SQL = """(SELECT p_partkey::VARCHAR AS id, p_name AS word, CASE WHEN p_type <> 'PROMO' THEN p_type END AS category,
  p_size > 5 AS enabled FROM part)"""


def written_lines(spark, folder):
    """Part names and types written as alias lines to a file, scanned and parsed again."""
    path = new_table_path(spark, "alias-lines")
    sep = F.when(F.col("p_size") < 20, " -> ").when(F.col("p_size") < 40, "|").otherwise(" = ")
    line = F.concat(F.when(F.col("p_size") % 10 == 0, "# ").otherwise(" "), F.col("p_name"), sep, F.lower("p_type"))
    read(spark, folder, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("\t"), line).alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.substring_index("value", "\t", 1).cast("long").alias("line_no"),
                                         F.substring_index("value", "\t", -1).alias("line"))
    return X.parse_alias_lines(lines)


def json_lines(spark, folder):
    """Utterance pairs written as JSON lines between broken ones, scanned again."""
    path = new_table_path(spark, "pairs")
    t = read(spark, folder, "conversations")
    good = t.select(F.to_json(F.struct(F.col("text").alias("asr"), F.upper("role").alias("correct"),
                                       F.array("role").alias("error_types"))).alias("value"))
    broken = t.select(F.concat(F.lit('{"asr": "'), F.col("role")).alias("value"))
    good.unionByName(broken).write.text(path)
    pairs = S.read_error_pairs(spark, path)
    return pairs.groupBy("correct", F.array_join("error_types", ",").alias("error_type")).agg(
        F.count("*").alias("n"), F.sum(F.length("asr")).cast("long").alias("chars"))


def error_types(spark, folder):
    """Distribution of the error types of pairs: speakers and long turns stand for the types."""
    from scribemend.operators.evaluate import error_type_counts
    t = read(spark, folder, "conversations")
    return error_type_counts(t.select(F.when(F.length("text") > 300, F.array(F.col("role"), F.lit("long")))
                                      .otherwise(F.array("role")).alias("error_types")))


def corpus_lines(spark, folder):
    return S.corpus_lines(documents(spark, folder), "text").groupBy("text").agg(F.count("*").alias("n"))


def extended_corpus(spark, folder):
    """Utterances of the documents that no turn holds, each once."""
    return S.extend_corpus(utterances(spark, folder), S.corpus_lines(turns(spark, folder), "text"))


def assembled_conversations(spark, folder):
    return X.assemble_documents(read(spark, folder, "conversations"), "conv_id", "turn", "text")


def versioned_pages(spark, folder):
    """Pages picked by the last part of their address."""
    pages = read(spark, folder, "pages").select("page_id", F.concat(F.regexp_extract("url", "^([^?]*)", 1), F.lit(".html")).alias("name"))
    return X.pick_version(pages, None).select("page_id", "category")


def failure_log(spark, folder):
    """Events appended to a log by day; the last seven days read back."""
    path = new_table_path(spark, "failures")
    e = read(spark, folder, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("failure_type"))
    T.append_failures(e, path)
    recent = T.recent_failures(spark, path, F.lit("2024-01-20").cast("date"))
    return recent.groupBy(F.col("dt").cast("string").alias("day"), "failure_type").agg(F.count("*").alias("n"))


def report_samples(spark, folder):
    e = read(spark, folder, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("failure_type"),
        F.concat(F.lit("layer"), F.pmod("user_id", F.lit(4)).cast("string")).alias("layer_responsible"))
    _, first = T.weekly_report(e)
    return first.select("id", "layer_responsible")


def lexicon_versions(spark, folder):
    """Parts saved as two versions, one of them twice; the active one listed."""
    store = T.LexiconStore(spark, new_table_path(spark, "lexicon"))
    parts = _parts(spark, folder)
    store.save("all", parts.filter("enabled"))
    store.save("promo", parts.filter("category IS NULL"))
    store.save("all", parts)
    store.activate("all")
    store.activate("promo")
    active = store.active().agg(F.count("*").alias("n")).select(F.lit("active").alias("version"), "n")
    return store.versions().unionByName(active)


def synced_versions(spark, folder):
    """Versions that look like numbers, an emptied one and one of two alias documents and a map, each activated and read."""
    store = T.LexiconStore(spark, new_table_path(spark, "lexicon"))
    parts = _parts(spark, folder)
    store.save("01", parts.filter("enabled"))
    store.save("1.10", parts.filter("category IS NULL"))
    store.save("gone", parts)
    store.save("gone", parts.filter("false"))
    p = read(spark, folder, "part")
    line = F.concat("p_name", F.lit(" -> "), F.lower("p_type"), F.lit(" "), (F.col("p_size") % 5).cast("string"))
    lines = p.select(F.when(F.col("p_partkey") % 2 == 0, "v.md").otherwise("v.txt").alias("doc"), F.col("p_partkey").alias("pos"), line.alias("content"))
    mapped = p.filter("p_partkey <= 5").select(F.lit("v.json").alias("doc"), F.lit(1).cast("long").alias("pos"), F.to_json(
        F.create_map(F.concat(F.lit("map of "), F.col("p_partkey").cast("string")), F.col("p_name"))).alias("content")).filter("content LIKE '%map of 1\"%'")
    broken = p.filter("p_partkey = 1").select(F.lit("v.old.json").alias("doc"), F.lit(1).cast("long").alias("pos"), F.lit("{broken").alias("content"))
    J.sync_aliases(store, lines.unionByName(mapped).unionByName(broken), "v")
    out = store.active().select(F.lit("v").alias("version"), "alias", "canonical")
    for version in ("01", "1.10", "gone"):
        store.activate(version)
        held = store.active().agg(F.count("*").cast("string").alias("canonical"))
        out = out.unionByName(held.select(F.lit(version).alias("version"), F.lit("rows").alias("alias"), "canonical"))
    return out


def listed_words(spark, folder):
    return L.list_words(_parts(spark, folder), "SMALL").select("id", "word")


def words_by_category(spark, folder):
    return L.by_category(_parts(spark, folder)).select("category", F.size("words").cast("long").alias("n"),
                                                       F.array_join("words", "|").alias("words"))


def inserted_words(spark, folder):
    """Names of dear parts offered to the lexicon of small ones; clashes by word and category."""
    parts = _parts(spark, folder)
    small, offered = parts.filter("enabled"), parts.filter("NOT enabled").select("word", "category", "enabled")
    grown, rejected = L.insert_words(small, offered)
    return grown.groupBy("word", "category").agg(F.count("*").alias("n")).withColumn("state", F.lit("kept")).unionByName(
        rejected.groupBy("word", "category").agg(F.count("*").alias("n")).withColumn("state", F.lit("rejected")))


def updated_words(spark, folder):
    parts = _parts(spark, folder)
    orders = read(spark, folder, "lineitem").select(F.col("l_partkey").cast("string").alias("id")).distinct()
    changes = orders.select("id", F.lit("renamed").alias("word"), F.lit(None).cast("string").alias("category"), F.lit(False).alias("enabled"),
                            F.when(F.length("id") > 3, F.array(F.lit("word"), F.lit("category"))).otherwise(F.array(F.lit("enabled"))).alias("given"))
    new, _ = L.update_words(parts, changes)
    return new.select("id", "word", "category", "enabled")


def missing_updates(spark, folder):
    """Suppliers as ids of an update: those no part row has."""
    ids = read(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("id")).distinct()
    changes = ids.select("id", F.lit("x").alias("word"), F.lit(None).cast("string").alias("category"), F.lit(True).alias("enabled"),
                         F.array(F.lit("word")).alias("given"))
    _, missing = L.update_words(_parts(spark, folder).filter("enabled"), changes)
    return missing


def deleted_words(spark, folder):
    ids = read(spark, folder, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").cast("string").alias("id"))
    return L.delete_words(_parts(spark, folder), ids).select("id", "word")


def snapshot_counts(spark, folder):
    parts = _parts(spark, folder).withColumn("word", F.when(F.col("enabled"), F.col("word")))
    _, counts = L.replace_snapshot(parts, 7)
    return counts


def lexicon_union(spark, folder):
    aliases = alias_table(spark)
    terms = read(spark, folder, "part").select(F.col("p_type").alias("canonical"))
    confusion = values(spark, CONFUSION, "wrong string, correct string, lex_order long")
    return L.term_union(terms, aliases, confusion, _parts(spark, folder))


def custom_vocabulary(spark, folder):
    names = read(spark, folder, "part").select(F.col("p_name").alias("alias"), F.lower("p_type").alias("canonical"))
    return L.custom_vocabulary(names)


def accepted_texts(spark, folder):
    good, bad = P.validate(documents(spark, folder))
    return good.select("id", F.lit("accepted").alias("state")).unionByName(bad.select("id", F.col("reason").alias("state")))


def _resources(spark):
    from bindings.normal import LATIN_RULES
    return P.Resources(rules=LATIN_RULES, aliases=alias_table(spark),
                       confusion=values(spark, CONFUSION, "wrong string, correct string, lex_order long"))


def corrected_documents(spark, folder):
    out = P.correct(documents(spark, folder), _resources(spark), (2, 3))
    return out.select("id", "corrected", F.array_join("layers_applied", ",").alias("layers"),
                      F.size("changes").cast("long").alias("n_changes"))


def corrected_turns_once(spark, folder):
    """Roles and short openings repeat: every distinct text is corrected once."""
    df = utterances(spark, folder)
    out = P.correct_distinct(df, _resources(spark), (2, 3))
    return out.select("id", "corrected", F.size("changes").cast("long").alias("n_changes"))


def stored_results(spark, folder):
    """Nested results written and read back: change records per layer, type and form."""
    path = new_table_path(spark, "results")
    T.write_results(P.correct(documents(spark, folder), _resources(spark), (2, 3)), path)
    from scribemend.operators.evaluate import change_counts
    return change_counts(spark.read.parquet(path)).select("layer", "type", "before", "after", "n")


def trigger_rates(spark, folder):
    from scribemend.operators.evaluate import trigger_rates as rates
    out = P.correct(documents(spark, folder), _resources(spark), (2, 3))
    return rates(out, {"layer2": "changes_layer2", "layer3": "changes_layer3"}).select("layer", F.round("rate", 6).alias("rate"))


def skipped_texts(spark, folder):
    from scribemend.plans.prompts import needs_refinement
    out = P.correct(utterances(spark, folder), _resources(spark), (2,))
    return out.select("id", needs_refinement(F.col("changes"), F.col("corrected")).alias("refined"))


def _stream(spark, folder, table, columns):
    """A given table as a file stream, read where it lies; a glob may stand for one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]").select(*columns)


def _drained(spark, stream, name):
    out, mark = new_table_path(spark, name), new_table_path(spark, f"{name}-mark")
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def streamed_corrections(spark, folder):
    stream = _stream(spark, folder, "documents", ["doc_id", "text"])
    out = Y.correct_stream(stream, P.stateless_aliases(_resources(spark)))
    return _drained(spark, out, "corrected").select(F.col("doc_id").alias("id"), "corrected", F.size("changes").cast("long").alias("n_changes"))


def streamed_metrics(spark, folder):
    stream = _stream(spark, folder, "events", ["ts", "value", "event_type"])
    out = Y.windowed_metrics(stream, "ts", "value", F.col("event_type") == "error", "1 day", "1 hour")
    return _drained(spark, out, "metrics").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "request_count", "error_count",
                                                  F.round("avg", 6).alias("avg"))


def streamed_once(spark, folder):
    stream = _stream(spark, folder, "events", ["ts", "user_id", "event_type"])
    out = Y.once_per_key(stream, ["user_id", "event_type"], "ts", "3650 days")
    return _drained(spark, out, "once").select("user_id", "event_type")


def streamed_active_lexicon(spark, folder):
    store = T.LexiconStore(spark, new_table_path(spark, "lexicon"))
    store.save("v1", alias_table(spark))
    store.activate("v1")
    out = new_table_path(spark, "batches")
    stream = _stream(spark, folder, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "id")
    Y.correct_with_active(stream, store, out, new_table_path(spark, "mark")).awaitTermination()
    return spark.read.parquet(out).select("id", "corrected")


QUERIES = {
    "error_types": error_types,
    "written_lines": written_lines, "json_lines": json_lines, "corpus_lines": corpus_lines, "extended_corpus": extended_corpus,
    "assembled_conversations": assembled_conversations, "versioned_pages": versioned_pages, "failure_log": failure_log,
    "report_samples": report_samples, "lexicon_versions": lexicon_versions, "synced_versions": synced_versions, "listed_words": listed_words,
    "words_by_category": words_by_category, "inserted_words": inserted_words, "updated_words": updated_words,
    "missing_updates": missing_updates, "deleted_words": deleted_words, "snapshot_counts": snapshot_counts,
    "lexicon_union": lexicon_union, "custom_vocabulary": custom_vocabulary, "accepted_texts": accepted_texts,
    "corrected_documents": corrected_documents, "corrected_turns_once": corrected_turns_once, "stored_results": stored_results,
    "trigger_rates": trigger_rates, "skipped_texts": skipped_texts, "streamed_corrections": streamed_corrections,
    "streamed_metrics": streamed_metrics, "streamed_once": streamed_once, "streamed_active_lexicon": streamed_active_lexicon,
}
