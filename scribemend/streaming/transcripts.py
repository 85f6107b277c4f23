"""Streams of transcripts and of request events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scribemend.operators.aliases import resolve_aliases, span_changes
from scribemend.session import ship_package
from scribemend.sources.stores import LexiconStore

#: Groups over which the keys of a state are dealt: a call of Python is for a group, not for a key.
BUCKETS = 4096


def correct_stream(stream: DataFrame, resolve: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """Alias correction as a stateless projection: no shuffle, no state."""
    return (stream.withColumn("_r", resolve(F.col(text_col)))
            .withColumn("corrected", F.col("_r.text")).withColumn("changes", span_changes(F.col("_r.spans"))).drop("_r"))


def correct_batches(stream: DataFrame, lexicon: DataFrame, out: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """The rows of `correct_stream` for a lexicon of any size, a folder of `out` for each micro-batch.

    Over the bound of an index texts meet the lexicon by joins, on a key made of the whole row.
    """

    def run(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("_key", F.xxhash64(*batch.columns))
        done = resolve_aliases(keyed, lexicon, "_key", text_col)
        (done.select(*batch.columns, F.col("resolved.text").alias("corrected"), span_changes(F.col("resolved.spans")).alias("changes"))
         .write.mode("overwrite").parquet(f"{out}/batch={number}"))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(stream: DataFrame, ts: str, value: str, is_error: Column, window: str = "1 hour",
                     late: str = "10 minutes") -> DataFrame:
    """Totals and latency figures per window; events later than the watermark are dropped.

    The percentiles of a stream are approximate: their sketch bounds the state.
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return (timed.groupBy(F.window("_ts", window)).agg(
        F.count("*").alias("request_count"), F.sum(F.when(is_error, 1).otherwise(0)).alias("error_count"),
        F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(10_000)).alias("p"),
        F.avg(value).alias("avg"))
        .select(F.col("window.start").alias("start"), "request_count", "error_count",
                F.round(F.col("error_count") / F.col("request_count"), 4).alias("error_rate"),
                F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "avg"))


def metrics_table(stream: DataFrame, ts: str, value: str, is_error: Column, out: str, checkpoint: str,
                  window: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Windows that are still open are written, too: each micro-batch adds the windows that it has changed.

    A batch has a folder of its own, so a repeated one replaces itself; `current_metrics` reads the last state of each.
    """
    changed = windowed_metrics(stream, ts, value, is_error, window, late)

    def run(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")

    return (changed.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_metrics(written: DataFrame) -> DataFrame:
    """The last state of every window, open ones included; rows of a table made by `metrics_table`."""
    figures = [c for c in written.columns if c not in ("start", "batch", "number")]
    return (written.groupBy("start").agg(F.max_by(F.struct(*figures), "batch").alias("last")).select("start", "last.*"))


def split_late(stream: DataFrame, ts: str, out: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """Rows written to out/late or out/timely: late is older than the newest time of all batches before it by more than `late`.

    The newest time after each batch is a row of out/newest; a batch that is repeated reads those of the batches before.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("number long, newest timestamp").parquet(f"{out}/newest") if number else None
        newest = known.filter(F.col("number") < number).agg(F.max("newest")).first()[0] if known is not None else None
        at = F.col(ts).cast("timestamp")
        is_late = F.lit(False) if newest is None else F.coalesce(at < F.lit(newest) - F.expr(f"INTERVAL {late}"), F.lit(False))
        for name, rows in (("late", batch.filter(is_late)), ("timely", batch.filter(~is_late))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        upto = batch.agg(F.max(at).alias("newest")).select(F.greatest("newest", F.lit(newest).cast("timestamp")).alias("newest"))
        upto.write.mode("overwrite").parquet(f"{out}/newest/number={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_key(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first event of every key within the time bound."""
    return (stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
            .dropDuplicatesWithinWatermark(keys).drop("_ts"))


def once_within(stream: DataFrame, keys: list[str], ts: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(keys, ts) of the events that come out when each one silences its key for so many seconds of event time.

    The state of a key is the time until which it is silent. Keys are dealt over BUCKETS groups, whose state is that of
    their keys: keys whose time the watermark has passed leave it with the next events of the group, a timer drops it
    when the watermark has passed all of them. The events of a key are taken in the order of their times within a
    micro-batch; of equal times one comes out. Events behind the watermark are dropped, null keys are a key of their own.
    """
    ship_package(stream.sparkSession)
    timed = stream.select(*keys, F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", late)
    kinds = {k: timed.schema[k].dataType.simpleString() for k in keys}
    name = F.to_json(F.array(*[_spelled(F.col(k), kind) for k, kind in kinds.items()]))
    named = timed.select("_ts", F.unix_micros("_ts").alias("_at"), name.alias("_key"))

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = [(frame["_at"].to_numpy(np.int64), frame["_key"].to_numpy(object)) for frame in frames]
        times, names = (np.concatenate(side) for side in zip(*rows, strict=True))
        order = np.argsort(times, kind="stable")
        told, passed = [], state.getCurrentWatermarkMs()
        for key, at in zip(names[order].tolist(), times[order].tolist(), strict=True):
            if at >= until.get(key, at):
                told.append((key, at))
                until[key] = at + seconds * 1_000_000
        until = {key: end for key, end in until.items() if end > passed * 1000}
        if until:
            state.update((list(until), list(until.values())))
            state.setTimeoutTimestamp(max(max(until.values()) // 1000, passed) + 1)
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=["_key", "_at"])

    dealt = named.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int"))
    found = dealt.groupBy("_bucket").applyInPandasWithState(
        run, "_key string, _at long", "names array<string>, until array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    names = F.from_json("_key", "array<string>")
    return (found.select(names.alias("_names"), "_at")
            .select(*[_read(F.col("_names")[i], kind).alias(k) for i, (k, kind) in enumerate(kinds.items())], F.timestamp_micros("_at").alias(ts)))


def _spelled(column: Column, kind: str) -> Column:
    """A value as text that `_read` reads again."""
    return F.hex(column) if kind == "binary" else F.unix_micros(column).cast("string") if kind == "timestamp" else column.cast("string")


def _read(text: Column, kind: str) -> Column:
    return F.unhex(text) if kind == "binary" else F.timestamp_micros(text.cast("long")) if kind == "timestamp" else text.cast(kind)


def correct_with_active(stream: DataFrame, store: LexiconStore, out: str, checkpoint: str, id_col: str = "id",
                        text_col: str = "text") -> StreamingQuery:
    """Correct every micro-batch with the lexicon version that is active when it first starts.

    The batch is tied to that save of the version before anything is written, so that it is corrected alike if it
    has to be repeated after a restart, whatever has been activated since.
    """

    def run(batch: DataFrame, number: int) -> None:
        version, lexicon = store.pinned(out, number)
        done = resolve_aliases(batch, lexicon, id_col, text_col)
        (done.select(id_col, F.col("resolved.text").alias("corrected"), F.lit(number).alias("batch"), F.lit(version).alias("version"))
         .write.mode("overwrite").parquet(f"{out}/batch={number}"))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
