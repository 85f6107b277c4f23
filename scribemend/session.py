"""Session helpers: shared folder, size-checked broadcast, bounded collection."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
LITERAL_ROWS = 4000
LITERAL_BYTES = 1024 * 1024


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scribemend")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", _own_folder())
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _own_folder() -> str:
    """The folder that Spark's own settings name, else a new one: a local session's tasks all see this machine's."""
    from pyspark import SparkConf

    return SparkConf().get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="scribemend-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees, as named by spark.checkpoint.dir (or set on the context of a local session)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scribemend-"))
    return context.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    made_paths(spark).append(path)
    return path


def made_paths(spark: SparkSession) -> list[str]:
    """The paths given out so far and not dropped, oldest first."""
    context = spark.sparkContext
    if not hasattr(context, "_scribemend_paths"):
        context._scribemend_paths = []
    return context._scribemend_paths


def drop_paths(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> list[str]:
    """Deletes given paths with what is in them, but none that `keep` reads; returns those that are gone."""
    read = keep.inputFiles() if keep is not None else []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = []
    for path in paths:
        if not any(path.rsplit("/", 1)[1] in file for file in read):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            gone.append(path)
    context_paths = made_paths(spark)
    context_paths[:] = [path for path in context_paths if path not in gone]
    return gone


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, safe from lost executors."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_output(path: str):
    """A file in the shared folder, opened for writing from any executor (file:, hdfs: and object stores)."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)  # else the file's name decides


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors, which need not have it installed; once a context."""
    context = spark.sparkContext
    if not getattr(context, "_scribemend_shipped", False):
        root, held = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(held, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, str(file.relative_to(root.parent)))
        path = new_table_path(spark, "package") + ".zip"
        with open_output(path) as out:
            out.write(held.getvalue())
        context.addPyFile(path)
        context._scribemend_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows, measured by one aggregate."""
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return int(row["b"] or 0)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only below a measured size; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def bounded_rows(df: DataFrame, max_rows: int = LITERAL_ROWS, max_bytes: int = LITERAL_BYTES):
    """Rows of a rule table for use as literals, or None if the table is over the bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    size = sum(len(str(value).encode()) for row in rows for value in row if value is not None)
    return rows if size <= max_bytes else None


def skew_safe_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame,
                   spread: Column, how: str = "left") -> DataFrame:
    """Equi-join in which the rows of hot keys never meet in one task.

    `hot` holds the part of `right` with the frequent keys and must be bounded by
    its definition (for example: keys with at least 1/10000 of all rows).  Hot rows
    are answered by the broadcast; in the shuffle they carry a null-safe key spread
    over all partitions and can match nothing, so the cold side needs no salt.
    """
    if how != "left":
        raise ValueError("only left joins")
    values = [c for c in right.columns if c not in keys]
    hot_side = hot.select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in values],
                          F.lit(True).alias("_is_hot"))
    step = left.join(F.broadcast(hot_side), keys, "left")
    is_hot = F.coalesce(F.col("_is_hot"), F.lit(False))
    step = step.withColumn("_spread", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(1 << 20))
                                             + F.lit(1)).otherwise(F.lit(0).cast("long")))
    cold = right.select(*keys, *[F.col(c).alias(f"_cold_{c}") for c in values],
                        F.lit(0).cast("long").alias("_spread"))
    joined = step.join(cold, [*keys, "_spread"], "left")
    return joined.select(
        *left.columns,
        *[F.when(is_hot, F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in values],
    )
