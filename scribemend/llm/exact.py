"""Exact dedup by progressive refinement, in DataFrame functions only.

Rows are told apart by ever dearer marks: length, hash of the beginning, hash of the whole, and at last the
content itself, which is shuffled only for rows whose group survived all cheaper marks.

Null texts count as empty. Rows that repeat both doc_id and text are one document: they share its decision, and
`drop_copies` leaves one of them. A null doc_id comes last among equals. Other columns are carried, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.llm.common import attach, matching, stored

BLANKS = r"[\x20\x09-\x0D]+"
HEAD = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, length, head, whole, text_sha256) of every row; no text."""
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .select("doc_id", F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
            .select("doc_id", "n_chars", F.length("norm").cast("long").alias("length"),
                    F.xxhash64(F.substring("norm", 1, HEAD)).alias("head"), F.xxhash64("norm").alias("whole"),
                    F.sha2(F.col("norm"), 256).alias("text_sha256")))


def _repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows that share `keys` with another row."""
    groups = stored(rows.groupBy(*keys).count().filter("count > 1").drop("count"), name)
    return matching(rows, groups, keys)


def copy_groups(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(text_sha256, best_chars, keep_id, group_size) of every text that more than one row has; stored."""
    left = _repeated(facts.select("length", "head", "whole"), ["length"], "by-length")
    left = _repeated(left, ["length", "head"], "by-head")
    left = stored(left.groupBy("length", "head", "whole").count().filter("count > 1").drop("count"), "by-whole")
    texts = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
             .select("doc_id", F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
             .withColumn("length", F.length("norm").cast("long"))
             .withColumn("head", F.xxhash64(F.substring("norm", 1, HEAD))).withColumn("whole", F.xxhash64("norm")))
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"))
    groups = (matching(texts, left, ["length", "head", "whole"])
              .groupBy("norm").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
              .filter("group_size > 1")
              .select(F.sha2(F.col("norm"), 256).alias("text_sha256"), (-F.col("best.less")).alias("best_chars"),
                      F.col("best.id").alias("keep_id"), "group_size"))
    return stored(groups, "copies")


def exact_copies(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    facts = stored(marks(docs), "marks")
    groups = copy_groups(docs, facts)
    rows = attach(facts.select("doc_id", "n_chars", "text_sha256"), groups, ["text_sha256"], "group_size", F.col("doc_id"))
    alone = F.col("group_size").isNull()
    return rows.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("best_chars")))).alias("kept"),
        "text_sha256", "n_chars")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (all columns) without copies: one row of each text stays."""
    found = stored(exact_copies(docs).filter("group_size > 1"), "found")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = packed.select("row", F.col("row.doc_id").alias("doc_id"), normalised(F.col("row.text")).alias("norm"),
                          F.length(F.coalesce("row.text", F.lit(""))).cast("long").alias("n_chars"))
    keyed = keyed.select("row", "doc_id", "n_chars", F.sha2(F.col("norm"), 256).alias("text_sha256"))
    on = ["doc_id", "n_chars", "text_sha256"]
    # a null doc_id never equals itself in a join, so it travels as text with a mark of its own
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    keyed = keyed.withColumn("doc_id", name)
    found = stored(found.withColumn("doc_id", name).select(*on, "kept"), "named")
    out = matching(keyed, found.filter(~F.col("kept")).select(*on).distinct(), on, "left_anti")
    tied = stored(found.filter("kept").groupBy(*on).count().filter("count > 1").select(*on), "tied")
    if not tied.isEmpty():
        one = matching(out, tied, on).dropDuplicates(on)
        out = matching(out, tied, on, "left_anti").unionByName(one)
    return out.select("row.*")
