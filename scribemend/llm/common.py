"""What the operators of this folder share: tables in the shared folder, joins that stand hot keys, open files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemend.session import drop_paths, made_paths, open_output, ship_package, skew_safe_join, stored

__all__ = ["KEY_ROWS", "WORD", "as_text", "attach", "dealt_join", "in_stage", "keyed_as", "matching", "open_input", "open_output", "open_places", "ship_package", "stored", "table", "text_slices"]

#: Words of a text: runs of anything but space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of fixed-width keys (a few numbers or one digest) that may be broadcast: under 100 MB.
KEY_ROWS = 1_000_000
#: A key of a join is dealt over cells of a thousandth of all rows, but not of fewer than DEALT.
CELLS, DEALT = 1000, 10_000
#: Bytes of text that one step of an Arrow function holds as Python's strings.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_stage(function: Callable[..., DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage of a pipeline: what stages before it stored for themselves is deleted, unless its documents still read it."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        context = spark.sparkContext
        drop_paths(spark, getattr(context, "_scribemend_stage_paths", []), keep=docs)
        before = set(made_paths(spark))
        out = function(spark, docs, sf_dir)
        left = [path for path in getattr(context, "_scribemend_stage_paths", []) if path in before]
        context._scribemend_stage_paths = left + [path for path in made_paths(spark) if path not in before]
        return out

    return run


def attach(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: Column) -> DataFrame:
    """Left join with a stored table of one row per key whose column `weight` says how many rows the key has.

    Keys with a thousandth of all weight (a thousand at most) go by broadcast, so no key fills a task.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.filter(F.col(weight) * 1000 >= F.lit(total))
    return skew_safe_join(left, right, keys, hot, spread)


def dealt_join(left: DataFrame, counted: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """Join with a table of one row per key, of any width; rows of a frequent key are dealt over cells by `spread`.

    `counted` is a stored table whose keys are as frequent as those of `left`.  The row of a frequent key is copied once
    for each of its cells, 2 x CELLS times for all keys together; only their keys are broadcast.
    """
    total = counted.count()
    if total <= DEALT:
        return left.join(right, key)
    size = max(DEALT, -(-total // CELLS))
    hot = counted.groupBy(key).count().filter(F.col("count") > size).collect()  # fewer than CELLS rows
    if not hot:
        return left.join(right, key)
    cells = F.broadcast(left.sparkSession.createDataFrame(
        [(row[key], -(-row["count"] // size)) for row in hot], f"{key} long, _cells long"))
    dealt = left.join(cells, key, "left").withColumn("_cell", F.pmod(F.xxhash64(spread), F.coalesce("_cells", F.lit(1))))
    copied = right.join(cells, key, "left").withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_cells", F.lit(1)) - 1)))
    return dealt.drop("_cells").join(copied.drop("_cells"), [key, "_cell"]).drop("_cell")


def matching(left: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", rows: int = KEY_ROWS) -> DataFrame:
    """Rows of `left` with (or by left_anti: without) a row in `keys`, a stored table of fixed-width keys.

    The keys are counted: up to `rows` they are broadcast, beyond that both sides are shuffled.
    """
    return left.join(F.broadcast(keys) if keys.count() <= rows else keys, on, how)


def text_slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut at about so many bytes of a text column, so that Python holds the texts of one cut at a time."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(ends)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def as_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) for a pandas function: the id as text, because pandas turns numbers beside nulls into floats."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def keyed_as(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose doc_id has the type that it has in `docs` again."""
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def open_input(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


@contextmanager
def open_places(path: str) -> Iterator[tuple[Callable[[int, int], bytes], int]]:
    """A file to read at any place: a function of (first byte, number of bytes), and the size of the file."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as file:
        yield lambda at, size: file.read_at(size, at), file.size()
