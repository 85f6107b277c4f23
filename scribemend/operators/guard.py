"""Guard of refined texts: entities kept, length kept, no repeated passage; merge of results."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.functions.entities import entities, entity_keys
from scribemend.functions.text import edit_distance, in_project, item_rows, let, numbers, strip
from scribemend.operators.lookup import by_slices
from scribemend.session import ship_package

SHINGLE = 5


def entity_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, type, text, value, start, end), one row per entity."""
    return item_rows(df, [id_col], entities(F.col(text_col)), "e").select(id_col, "e.*")


def lost_entities(before: DataFrame, after: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, type, value) of the text before that the text after lacks."""
    old = entity_rows(before, id_col, text_col).select(id_col, "type", "value").distinct()
    new = entity_rows(after, id_col, text_col).select(id_col, "type", "value")
    return old.join(new, [id_col, "type", "value"], "left_anti")


def guard(before: Column, after: Column) -> Column:
    """STRUCT<passed, reason>: every entity kept, and at least half of the length."""
    lost = F.array_except(entity_keys(before), entity_keys(after))
    short = F.length(after) < F.length(before) * 0.5
    return let(lost, lambda gone: F.struct(
        (after.isNotNull() & (F.size(gone) == 0) & ~short).alias("passed"),
        F.when(after.isNull(), F.lit("no result"))
        .when(F.size(gone) > 0, F.concat(F.lit("entity lost: "), F.array_join(F.slice(gone, 1, 1), "")))
        .when(short, F.concat(F.lit("shortened: "), F.length(before).cast("string"), F.lit(" -> "),
                              F.length(after).cast("string"))).alias("reason")))


def shingles(text: Column) -> Column:
    """All runs of five characters, overlapping."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))


def repeat_injections(df: DataFrame, before: str, after: str, id_col: str = "id") -> DataFrame:
    """Ids of texts that grew by more than two characters and repeat a known run more often than before.

    A row whose id is its own is decided where it lies; runs travel only for ids of several rows, which share their counts.
    """
    ship_package(df.sparkSession)
    grown = df.filter(F.length(after) > F.length(before) + 2)
    several = grown.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull()).select(id_col)

    @in_project("boolean")
    def repeats(old: pa.Array, new: pa.Array) -> pa.Array:
        return by_slices(lambda a, b: pa.array([more_often(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.bool_()), old, new)

    alone = grown.filter(F.col(id_col).isNotNull()).join(several, id_col, "left_anti")
    single = alone.withColumn("_repeats", repeats(F.col(before), F.col(after))).filter("_repeats").select(id_col)
    shared = grown.join(several.withColumnRenamed(id_col, "_id"), F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    rows = item_rows(shared, [id_col, F.lit(1).alias("b"), F.lit(0).alias("a")], shingles(F.col(before)), "run").unionByName(
        item_rows(shared, [id_col, F.lit(0).alias("b"), F.lit(1).alias("a")], shingles(F.col(after)), "run"))
    counted = (rows.groupBy(id_col, "run").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
               .filter((F.col("b") >= 1) & (F.col("a") > F.col("b"))).select(id_col).distinct())
    return single.unionByName(counted)


def more_often(before: str, after: str) -> bool:
    """Does the text after hold a run of the text before more often?"""
    known = Counter(before[k:k + SHINGLE] for k in range(len(before) - SHINGLE + 1))
    for k in range(len(after) - SHINGLE + 1):
        run = after[k:k + SHINGLE]
        left = known.get(run)
        if left is not None:
            if not left:
                return True
            known[run] = left - 1
    return False


def clean_output(text: Column) -> Column:
    """Model output without code fence, blanks and quotes around it."""
    def unfence(t: Column) -> Column:
        body = F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(F.substring(t, 4, 1 << 30))
        return F.when(F.startswith(t, F.lit("```")), body).otherwise(t)

    def unclose(t: Column) -> Column:
        return F.when(F.endswith(t, F.lit("```")), F.regexp_replace(t, r"(?U)\s*```\z", "")).otherwise(t)

    out = let(strip(text), unfence)
    out = let(F.regexp_replace(out, r"(?U)\s+\z", ""), unclose)
    return F.btrim(out, F.lit("\"'「」"))


def merge_refined(base: DataFrame, refined: DataFrame, id_col: str = "id", text_col: str = "text",
                  refined_col: str = "refined") -> DataFrame:
    """Refined text where there is one and it passes every check, else the text itself.

    Adds final, guard_passed, reason and changed.
    """
    joined = base.select(id_col, text_col).join(
        refined.select(id_col, clean_output(F.col(refined_col)).alias("_new")), id_col, "left")
    repeats = repeat_injections(joined.filter(F.col("_new").isNotNull()), text_col, "_new", id_col).withColumn(
        "_repeat", F.lit(True))
    checked = (joined.join(repeats, id_col, "left").withColumn("_g", guard(F.col(text_col), F.col("_new")))
               .withColumn("_repeat", F.coalesce("_repeat", F.lit(False))))
    passed = F.col("_g.passed") & ~F.col("_repeat")
    final = F.when(passed, F.col("_new")).otherwise(F.col(text_col))
    return checked.select(id_col, text_col, final.alias("final"), passed.alias("guard_passed"),
                          F.when(F.col("_repeat") & F.col("_g.passed"), F.lit("repeated passage"))
                          .otherwise(F.col("_g.reason")).alias("reason"),
                          (final != F.col(text_col)).alias("changed"))


def choose_result(original: Column, rule_text: Column, a: Column, b: Column, backed_a: Column, backed_b: Column) -> Column:
    """'A' or 'B': equal texts are B; a changed number loses; then a backed change; then fewer edits."""
    kept_a, kept_b = numbers(a) == numbers(rule_text), numbers(b) == numbers(rule_text)
    decided = (F.when(a == b, "B")
               .when(kept_a & ~kept_b, "A").when(kept_b & ~kept_a, "B")
               .when(backed_a & ~backed_b, "A").when(backed_b & ~backed_a, "B"))
    open_text = F.when(decided.isNull(), rule_text)  # no edits are counted where they decide nothing
    edits_a, edits_b = edit_distance(open_text, a), edit_distance(open_text, b)
    return F.coalesce(decided, F.when(edits_a < edits_b, "A").otherwise("B"))
