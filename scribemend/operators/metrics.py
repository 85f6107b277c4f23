"""Service metrics: totals, error rate, latency percentiles, latest samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribemend.session import broadcast_if_small, cut_lineage

PERCENTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
SAMPLES = 10_000
SALTS = 32
BINS = 200


def request_totals(df: DataFrame, by: list[str], is_error: Column) -> DataFrame:
    """Requests, errors and the error rate rounded to four digits."""
    errors = F.coalesce(F.sum(F.when(is_error, 1).otherwise(0)), F.lit(0))
    return (df.groupBy(*by).agg(F.count("*").alias("request_count"), errors.alias("error_count"))
            .withColumn("error_rate", F.round(F.col("error_count") / F.greatest("request_count", F.lit(1)), 4)))


def latest_samples(df: DataFrame, by: list[str], order: list[Column], unique: str, n: int = SAMPLES) -> DataFrame:
    """The latest n rows of every series.

    Each of 32 salts of a series keeps its own latest n first, so a series that holds
    a third of all rows is not sorted in one task.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(unique), F.lit(SALTS)))
    part = W.partitionBy(*by, "_salt").orderBy(*order)
    whole = W.partitionBy(*by).orderBy(*order)
    return (salted.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= n)
            .withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= n).drop("_n", "_salt"))


def bounded_latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Percentiles with linear interpolation and the mean of series of bounded length."""
    return df.groupBy(*by).agg(
        *[F.coalesce(F.percentile(value, p), F.lit(0.0)).alias(name) for name, p in PERCENTS.items()],
        F.coalesce(F.avg(value), F.lit(0.0)).alias("avg"))


def exact_percentiles(df: DataFrame, by: str, value: str, percents: dict[str, float] = PERCENTS) -> DataFrame:
    """Exact interpolated percentiles of series of any length.

    Equal values are counted first.  A sketch cuts every series into about 200 bins, the
    bin totals tell which bins hold the wanted ranks, and only the values of those bins
    are put in order, so no series is sorted or gathered as a whole.
    """
    data = df.select(by, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    counted = data.groupBy(by, "v").agg(F.count("*").alias("n"))
    edges = data.groupBy(by).agg(F.percentile_approx(
        "v", F.array(*[F.lit(k / BINS) for k in range(1, BINS)]), F.lit(10_000)).alias("edges"))
    # small tables that are read again: a few hundred numbers and at most six rows per series
    edges = cut_lineage(edges)
    binned = (counted.join(broadcast_if_small(edges), by)
              .withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges"))
    totals = binned.groupBy(by, "bin").agg(F.sum("n").alias("n"))
    run = W.partitionBy(by).orderBy("bin")
    placed = totals.select(by, "bin", (F.sum("n").over(run) - F.col("n")).alias("first"),
                           F.sum("n").over(run).alias("past"), F.sum("n").over(W.partitionBy(by)).alias("total"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in percents.items()]))
    ranks = (placed.select("*", wanted.alias("w"))
             .withColumn("at", (F.col("total") - 1) * F.col("w.p"))
             .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
             .filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
             .select(by, "bin", "w.name", "at", "rank", "first"))
    ranks = cut_lineage(ranks)
    inside = W.partitionBy(by, "bin").orderBy("v")
    needed = binned.join(broadcast_if_small(ranks.select(by, "bin").distinct()), [by, "bin"], "left_semi")
    ordered = (needed.withColumn("upto", F.sum("n").over(inside)).withColumn("before", F.col("upto") - F.col("n"))
               .select(by, "bin", "v", "before", "upto"))
    hits = (ordered.join(broadcast_if_small(ranks), [by, "bin"])
            .filter((F.col("rank") - F.col("first") >= F.col("before")) & (F.col("rank") - F.col("first") < F.col("upto"))))
    low = F.min(F.struct("rank", "v")).alias("low")
    high = F.max(F.struct("rank", "v")).alias("high")
    values = (hits.groupBy(by, "name", "at").agg(low, high)
              .select(by, "name", (F.col("low.v") + (F.col("high.v") - F.col("low.v")) * (F.col("at") - F.col("low.rank")))
                      .alias("value")))
    return values.groupBy(by).pivot("name", list(percents)).agg(F.first("value"))


def service_snapshot(df: DataFrame, by: list[str], value: str, is_error: Column, order: list[Column], unique: str,
                     n: int = SAMPLES) -> DataFrame:
    """Totals over all requests, latency figures over the latest n samples of each series."""
    totals = request_totals(df, by, is_error)
    latency = bounded_latency(latest_samples(df, by, order, unique, n), by, value)
    return totals.join(latency, by)
