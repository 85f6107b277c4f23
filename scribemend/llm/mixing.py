"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis).

Every document draws the key -ln(u) / weight, u from a digest of its id, so that reruns agree. Whole epochs of a
source come first; what its target asks beyond them is filled in the order of the keys until the word budget is
reached. The document on which the budget ends gives only the words that are still missing, so that a source
meets its target to the word.

The prefix sums need no ordered pass over a source: keys fall in BINS bins, the sums of the bins are added up, and
only the bin in which the budget ends is ordered row by row.

Null or empty texts have size 0 and are never taken. Null sources are one source, the last one. Rows that repeat a
doc_id share their key and are ordered by size. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribemend.llm.common import WORD, attach, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BINS = 4096


def uniform(key: Column, seed: str) -> Column:
    """A number between 0 and 1 from a digest of the key: 48 bits, never 0."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def n_words(text: Column) -> Column:
    """Words of a text, counted without a list of them: each becomes one character with the blanks behind it."""
    words = F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.length(F.regexp_replace(words, WORD + r"[\x20\x09-\x0D]*", "x")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows): one row per source.

    Targets go with the weights; a source stops at `most` times its size and the excess goes to the others.  With
    sources in the order of size over weight, the first k are full and the rest share what is left.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    given = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                               (place % len(weights) + 1).cast("int")))
    full = F.lit(float(most)) * F.col("source_size")
    by_fill = Window.orderBy(full / F.col("w"), F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("w").over(after)
    steps = given.withColumn("full", full).withColumn("level", level)
    # the level is right at the first source that it does not fill; at later ones it is lower
    fits = F.max(F.when(F.col("level") * F.col("w") <= F.col("full"), F.col("level"))).over(Window.partitionBy())
    return steps.select("source", "source_size", "rows",
                        F.least("full", F.coalesce(fits, F.lit(float("inf"))) * F.col("w")).alias("target"))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, weight) of each row of (doc_id, text, source); every weight is 1."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
                       F.lit(1.0).alias("weight"))


def mix(sizes: DataFrame, seed: str = "mix-1:", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of (doc_id, source, size, weight).

    `weight` is the quality weight of the document, above 0; null counts as 1.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    key = -F.log(uniform(F.col("doc_id"), seed)) / weight
    rows = sizes.select("doc_id", "source", "size", key.alias("key"))
    # bins of 1 - exp(-key): in the order of the keys, and evenly filled for weight 1
    rows = rows.withColumn("bin", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * BINS).cast("int"))
    rows = stored(rows.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))), "sizes")
    bins = stored(rows.groupBy("name", "source", "bin").agg(F.sum("size").alias("bin_size"), F.count("*").alias("rows")), "bins")
    per_source = bins.groupBy("name", "source").agg(F.sum("bin_size").alias("source_size"), F.sum("rows").alias("rows"))
    targets = source_targets(per_source.select("source", "source_size", "rows"), weights, share, most)
    targets = targets.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                                 .otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    # the bin in which the budget of a source ends, and the words of the bins before it
    so_far = Window.partitionBy("name").orderBy("bin")
    ends = (bins.join(targets.select("name", "budget"), "name")
            .withColumn("upto", F.sum("bin_size").over(so_far)).filter(F.col("upto") >= F.col("budget"))
            .groupBy("name").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("end")))
    plan = stored(targets.drop("source").join(ends, "name", "left"), "plan")
    out = attach(rows.drop("source"), plan, ["name"], "rows", F.col("doc_id"))
    out = out.withColumn("at_end", F.col("bin") == F.col("end.bin"))
    # only rows of the end bins are ordered; the others are spread by a number of their own
    inside = Window.partitionBy("name", "at_end", F.when(F.col("at_end"), F.lit(0)).otherwise(
        F.pmod(F.xxhash64("doc_id"), F.lit(BINS)).cast("int"))).orderBy("key", "doc_id", "size")
    before = F.col("end.before") + F.coalesce(
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("budget") - before))
    extra = F.when(F.col("at_end"), part).when(F.col("bin") < F.col("end.bin"), F.col("size")).otherwise(F.lit(0))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def with_quality(sizes: DataFrame, labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """Sizes with the weight that labels.quality gives: `good` or `bad` (the lowest, if several), 1 without a label."""
    given = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = stored(sizes, "measured").join(given, "doc_id", "left")
    weight = F.when(F.col("quality") == 1, F.lit(good)).when(F.col("quality") == 0, F.lit(bad)).otherwise(F.lit(1.0))
    return joined.withColumn("weight", weight).drop("quality")


def mixed(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """`docs` (all columns) as the mix takes them: as many copies as epochs, a part counts if it is half or more.

    Documents of no words are left out: the mix takes nothing of them.  Rows that share a doc_id (or have none) are
    copied as often as the one that is taken most often.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    times = stored(decisions.filter("taken > 0").groupBy(name.alias("name")).agg(
        F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times")).filter("times > 0"), "times")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"))
    joined = packed.filter(F.coalesce("row.text", F.lit("")).rlike(WORD)).join(times, "name")
    return joined.select("row", F.explode(F.expr("sequence(1, times)"))).select("row.*")
