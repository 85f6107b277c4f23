"""Streams in several micro-batches over the given tables: open windows, late rows, expiring state, changing lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import read
from bindings.large import endings
from bindings.lexical import SQL as LEXICAL
from bindings.lexical import alias_table
from scribemend.session import new_table_path
from scribemend.sources import stores as T
from scribemend.streaming import transcripts as Y

BATCHES = 4
LATE = "2 hours"


def _in_parts(spark, folder, table, part, columns, folder_out=None, parts=range(BATCHES)):
    """A stream of a given table that comes a part at a time; each part is one file, written after the one before.

    Row groups of 16 MB let many tasks read it.
    """
    path = folder_out or new_table_path(spark, "parts")
    rows = read(spark, folder, table).withColumn("part", part)
    for k in parts:
        rows.filter(F.col("part") == k).select(*columns).coalesce(1).write.mode("append").option("parquet.block.size", 16 << 20).parquet(path)
    schema = rows.select(*columns).schema
    return path, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _quarter(spark, folder):
    """Quarters of the span of the event times, so that parts come in their order."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = read(spark, folder, "events").agg(F.min(at), F.max(at)).first()
    return F.floor((at - F.lit(low)) * BATCHES / F.lit((high or 0) - (low or 0) + 1)).cast("int")


def _by_id():
    """The last digit of the id deals the events over the parts: most times of later parts lie before the newest one."""
    return (F.col("event_id") % BATCHES).cast("int")


def open_window_metrics(spark, folder):
    """Days of the events, in four micro-batches in the order of time; the last day is still open and has its row."""
    _, stream = _in_parts(spark, folder, "events", _quarter(spark, folder), ["ts", "value", "event_type"])
    out, mark = new_table_path(spark, "open"), new_table_path(spark, "open-mark")
    Y.metrics_table(stream, "ts", "value", F.col("event_type") == "error", out, mark, "1 day", "1 hour").awaitTermination()
    found = Y.current_metrics(spark.read.parquet(out))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "request_count", "error_count",
                        F.round("avg", 6).alias("avg"), "p50", "p95", "p99")


def late_events(spark, folder):
    """Events that come more than two hours behind the newest one of the micro-batches before, by batch and kind."""
    _, stream = _in_parts(spark, folder, "events", _by_id(), ["event_id", "ts", "event_type"])
    out = new_table_path(spark, "split")
    Y.split_late(stream, "ts", out, new_table_path(spark, "split-mark"), LATE).awaitTermination()
    sides = [spark.read.parquet(f"{out}/{name}").withColumn("side", F.lit(name)) for name in ("late", "timely")]
    return sides[0].unionByName(sides[1]).groupBy(F.col("batch").cast("long").alias("batch"), "side", "event_type").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def streamed_once_within(spark, folder):
    """Events that come out when each one silences its user and kind for three days; state expires and is told again."""
    _, stream = _in_parts(spark, folder, "events", _quarter(spark, folder), ["ts", "user_id", "event_type"])
    stream = Y.once_within(stream, ["user_id", "event_type"], "ts", 3 * 86_400, "1 hour")
    out = new_table_path(spark, "within")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_table_path(spark, "within-mark"))
     .trigger(availableNow=True).start().awaitTermination())
    found = spark.read.schema(stream.schema).parquet(out)
    return found.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("told"))


def streamed_lexicon_change(spark, folder):
    """English documents come while v1 is active, others after v2 has been activated and the query started again.

    Then the second batch is made once more, as after a lost run, with v1 active again: it keeps its version.
    """
    store = T.LexiconStore(spark, new_table_path(spark, "lexicon"))
    store.save("v1", alias_table(spark))
    store.save("v2", endings(spark, folder))
    store.activate("v1")
    out, mark = new_table_path(spark, "changing"), new_table_path(spark, "changing-mark")
    part = F.when(F.col("lang") == "en", 0).otherwise(1)
    columns = [F.col("doc_id").alias("id"), "text"]
    path, stream = _in_parts(spark, folder, "documents", part, columns, parts=[0])
    Y.correct_with_active(stream, store, out, mark).awaitTermination()
    store.activate("v2")
    _, stream = _in_parts(spark, folder, "documents", part, columns, path, [1])
    Y.correct_with_active(stream, store, out, mark).awaitTermination()
    store.activate("v1")
    assert store.pinned(out, 1)[0] == "v2"
    return spark.read.parquet(out).select("id", "corrected", "version")


QUERIES = {"open_window_metrics": open_window_metrics, "late_events": late_events, "streamed_once_within": streamed_once_within,
           "streamed_lexicon_change": streamed_lexicon_change}
SQL = {
    "open_window_metrics": """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS request_count, count(*) FILTER (event_type = 'error') AS error_count,
  round(avg(value), 6) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
FROM events GROUP BY 1""",
    "late_events": f"""WITH batches AS (SELECT *, event_id % {BATCHES} AS batch FROM events),
newest AS (SELECT batch + 1 AS batch, max(max(ts)) OVER (ORDER BY batch) AS newest FROM batches GROUP BY batch)
SELECT batch, CASE WHEN ts < newest - INTERVAL {LATE} THEN 'late' ELSE 'timely' END AS side, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids
FROM batches LEFT JOIN newest USING (batch) GROUP BY ALL""",
    "streamed_once_within": """WITH RECURSIVE said AS (
  SELECT user_id, event_type, min(epoch_us(ts)) AS told FROM events GROUP BY ALL
  UNION ALL
  SELECT s.user_id, s.event_type, (SELECT min(epoch_us(e.ts)) FROM events e WHERE e.user_id = s.user_id AND e.event_type = s.event_type
                                   AND epoch_us(e.ts) >= s.told + 259200000000::BIGINT) FROM said s WHERE s.told IS NOT NULL)
SELECT user_id, event_type, told FROM said WHERE told IS NOT NULL""",
    "streamed_lexicon_change": f"""SELECT id, corrected, 'v1' AS version FROM ({LEXICAL['alias_rewritten_texts']}) JOIN documents ON doc_id = id WHERE lang = 'en'
UNION ALL SELECT doc_id, regexp_replace(text, '([a-z]{{2,}})\\.', '\\1!', 'g'), 'v2' FROM documents WHERE coalesce(lang, '') <> 'en'""",
}
