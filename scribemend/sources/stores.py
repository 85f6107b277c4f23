"""Stored tables: correction results, failure log, reports, versioned lexicons."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scribemend.operators.failures import failure_counts


def append_failures(failures: DataFrame, path: str) -> None:
    """Append to the log, one folder per day of `ts`."""
    failures.withColumn("dt", F.to_date("ts")).write.mode("append").partitionBy("dt").parquet(path)


def recent_failures(spark: SparkSession, path: str, today: Column, days: int = 7) -> DataFrame:
    """Failures of the last days; only those folders are read."""
    log = spark.read.parquet(path)
    return log.filter((F.col("dt") >= F.date_sub(today, days - 1)) & (F.col("dt") <= today))


def weekly_report(failures: DataFrame, samples: int = 20) -> tuple[DataFrame, DataFrame]:
    """(counts, first samples) of a period."""
    return failure_counts(failures), failures.orderBy("ts", "id").limit(samples)


def write_report(failures: DataFrame, path: str, samples: int = 20) -> None:
    counts, first = weekly_report(failures, samples)
    counts.write.mode("overwrite").json(f"{path}/counts")
    first.write.mode("overwrite").json(f"{path}/samples")


def write_results(results: DataFrame, path: str) -> None:
    """Nested correction results as parquet."""
    results.write.mode("overwrite").parquet(path)


class LexiconStore:
    """Versions of a lexicon below one folder, and a pointer to the active one.

    Every save is a folder of its own and a row of the catalogue (version, folder, n, at, fields), so a version
    is replaced as a whole, by no rows, too, and readers of the save before are not disturbed.  Activating appends
    a pointer; the pointer before it is the backup, so nothing is copied.  Versions are text: 01 and 1.10 stay as they are.
    """

    CATALOGUE = "version string, folder string, n long, at timestamp, fields string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, version: str, rows: DataFrame) -> None:
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        held = self.spark.read.schema(rows.schema).parquet(folder).count()
        row = (version, folder, held, rows.schema.json())
        (self.spark.createDataFrame([row], "version string, folder string, n long, fields string")
         .withColumn("at", F.current_timestamp()).select("version", "folder", "n", "at", "fields")
         .coalesce(1).write.mode("append").parquet(f"{self.path}/saves"))

    def _latest(self) -> DataFrame:
        saves = self.spark.read.schema(self.CATALOGUE).parquet(f"{self.path}/saves")
        return saves.groupBy("version").agg(F.max_by(F.struct("folder", "n", "fields"), "at").alias("s")).select("version", "s.*")

    def versions(self) -> DataFrame:
        """(version, n), versions without rows included."""
        return self._latest().select("version", "n").orderBy("version")

    def read(self, version: str) -> DataFrame:
        row = self._latest().filter(F.col("version") == version).first()
        if row is None:
            raise ValueError(f"no version {version}")
        return self.spark.read.schema(StructType.fromJson(json.loads(row["fields"]))).parquet(row["folder"])

    def activate(self, version: str) -> None:
        if self._latest().filter(F.col("version") == version).isEmpty():
            raise ValueError(f"no version {version}")
        (self.spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp())
         .coalesce(1).write.mode("append").parquet(f"{self.path}/active"))

    def pointers(self) -> DataFrame:
        """Every activation, the latest last; the one before the latest is the backup."""
        return self.spark.read.schema("version string, at timestamp").parquet(f"{self.path}/active").orderBy("at")

    def active(self) -> DataFrame:
        return self.read(self.pointers().agg(F.max_by("version", "at")).first()[0])

    def pinned(self, user: str, number: int) -> tuple[str, DataFrame]:
        """(version, rows) of the save to which step `number` of a user is tied; the active one, if it is not tied yet."""
        path = f"{self.path}/pins/{hashlib.sha256(user.encode()).hexdigest()}/number={number}"
        kind = "version string, folder string, fields string"
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")  # a pin that was not written to the end does not count
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            version = self.pointers().agg(F.max_by("version", "at")).first()[0]
            row = self._latest().filter(F.col("version") == version).select("version", "folder", "fields")
            row.coalesce(1).write.mode("overwrite").parquet(path)
        row = self.spark.read.schema(kind).parquet(path).first()
        return row["version"], self.spark.read.schema(StructType.fromJson(json.loads(row["fields"]))).parquet(row["folder"])
