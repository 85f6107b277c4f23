"""Upkeep of lexicon tables: listing, insert, update, delete, snapshot replace, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.session import broadcast_if_small

DEFAULT_CATEGORY = "default"


def with_id(df: DataFrame) -> DataFrame:
    """Stable id of a word in its category; enabled unless said otherwise."""
    return df.select(F.sha2(F.concat_ws("\u0001", "word", F.coalesce("category", F.lit("\u0002"))), 256).alias("id"),
                     "word", "category", F.coalesce("enabled", F.lit(True)).alias("enabled"))


def list_words(lexicon: DataFrame, category: str | None = None, enabled_only: bool = True) -> DataFrame:
    out = lexicon if category is None else lexicon.filter(F.col("category") == category)
    return (out.filter("enabled") if enabled_only else out).orderBy("word", "id")


def insert_words(lexicon: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lexicon with the new words, rejected ones); a word clashes within its category, null included."""
    same = (F.col("n.word") == F.col("o.word")) & F.col("n.category").eqNullSafe(F.col("o.category"))
    fresh = new.groupBy("word", "category").agg(F.min("enabled").alias("enabled")).alias("n")  # off, if one row says so
    old = lexicon.select("word", "category").alias("o")
    accepted = with_id(fresh.join(old, same, "left_anti"))
    rejected = fresh.join(old, same, "left_semi").select("word", "category")
    return lexicon.unionByName(accepted), rejected


def update_words(lexicon: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated lexicon, ids that are not there).

    Changes: id, word, category, enabled and given ARRAY<STRING>, the fields to set; a
    given field may be set to null.
    """
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in ("word", "category", "enabled")], "given")
    joined = lexicon.join(broadcast_if_small(new), "id", "left")

    def pick(field: str) -> Column:
        return F.when(F.array_contains("given", field), F.col(f"_{field}")).otherwise(F.col(field)).alias(field)

    return (joined.select("id", pick("word"), pick("category"), pick("enabled")),
            changes.select("id").join(lexicon.select("id"), "id", "left_anti"))


def delete_words(lexicon: DataFrame, ids: DataFrame) -> DataFrame:
    return lexicon.join(broadcast_if_small(ids.select("id").distinct()), "id", "left_anti")


def replace_snapshot(entries: DataFrame, previous_count: int) -> tuple[DataFrame, DataFrame]:
    """(new lexicon, one row of counts); entries without a word are skipped."""
    usable = F.coalesce(F.length("word"), F.lit(0)) > 0
    counts = entries.agg(F.coalesce(F.sum(F.when(usable, 1).otherwise(0)), F.lit(0)).alias("updated"),
                         F.lit(previous_count).cast("long").alias("deleted"),
                         F.coalesce(F.sum(F.when(usable, 0).otherwise(1)), F.lit(0)).alias("skipped"))
    return with_id(entries.filter(usable)), counts


def by_category(lexicon: DataFrame) -> DataFrame:
    """(category, words) of the enabled words, null category as the default one."""
    return (lexicon.filter("enabled").groupBy(F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("category"))
            .agg(F.array_sort(F.collect_list("word")).alias("words")))


def term_union(terms: DataFrame, aliases: DataFrame, confusion: DataFrame, hotwords: DataFrame) -> DataFrame:
    """(word, term) of all lexicons: the spoken form and the term it stands for."""
    parts = [terms.select(F.col("canonical").alias("word"), F.col("canonical").alias("term")),
             aliases.select(F.col("alias").alias("word"), F.col("canonical").alias("term")),
             aliases.select(F.col("canonical").alias("word"), F.col("canonical").alias("term")),
             confusion.select(F.col("correct").alias("word"), F.col("correct").alias("term")),
             hotwords.filter("enabled").select("word", F.col("word").alias("term"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter((F.length("word") > 0) & (F.length("term") > 0)).distinct()


def custom_vocabulary(aliases: DataFrame) -> DataFrame:
    """(word): canonical forms and aliases, each once."""
    return (aliases.select(F.col("canonical").alias("word")).union(aliases.select("alias"))
            .filter(F.length("word") > 0).distinct())
