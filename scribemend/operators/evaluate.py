"""Evaluation: character error rate, term accuracy, entity fidelity, changes and triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.functions.entities import entity_keys
from scribemend.functions.text import character_error_rate, item_rows
from scribemend.operators.lookup import with_held_strings


def with_error_rates(df: DataFrame, expected: str, outputs: dict[str, str], suffix: str = "cer") -> DataFrame:
    """Add one error rate column per named output column; an output equal to the one before shares its rate."""
    named = [(f"{name}_{suffix}", F.col(col)) for name, col in outputs.items()]
    own = {name: character_error_rate(F.when(~text.eqNullSafe(last), text), F.col(expected))
           for (name, text), (_, last) in zip(named[1:], named, strict=False)}
    rates = {name: character_error_rate(text, F.col(expected)) for name, text in named[:1]} | own
    df = df.withColumns({f"_own_{name}": rate for name, rate in rates.items()})  # one pass of Python for all
    shared: dict[str, Column] = {}
    for k, (name, text) in enumerate(named):
        mine = F.col(f"_own_{name}")
        shared[name] = F.when(text.eqNullSafe(named[k - 1][1]), shared[named[k - 1][0]]).otherwise(mine) if k else mine
    return df.withColumns(shared).drop(*[f"_own_{name}" for name in shared])


def error_rate_summary(rated: DataFrame, base: str, names: list[str]) -> DataFrame:
    """One row per output: mean error rate and the texts it improved, left equal or worsened."""
    aggregates = []
    for name in names:
        delta = F.col(f"{name}_cer") - F.col(f"{base}_cer")
        aggregates.append(F.struct(
            F.lit(name).alias("output"), F.avg(f"{name}_cer").alias("mean_cer"),
            F.coalesce(F.sum(F.when(delta < 0, 1).otherwise(0)), F.lit(0)).alias("improved"),
            F.coalesce(F.sum(F.when(delta == 0, 1).otherwise(0)), F.lit(0)).alias("same"),
            F.coalesce(F.sum(F.when(delta > 0, 1).otherwise(0)), F.lit(0)).alias("worse"), F.count("*").alias("texts")))
    return rated.agg(F.array(*aggregates).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def term_accuracy(df: DataFrame, terms: DataFrame, expected: str, outputs: dict[str, str], id_col: str = "id") -> DataFrame:
    """Per output: reference terms also found in it over all reference terms."""
    counted = with_held_strings(df, terms.select(F.col("term").alias("string")), id_col, expected, "_terms")

    def kept(col: str) -> Column:
        return F.size(F.filter("_terms", lambda t: F.contains(F.col(col), t)))

    rows = [F.struct(F.lit(name).alias("output"), F.sum(kept(col)).alias("found"),
                     F.sum(F.size("_terms")).alias("expected")) for name, col in outputs.items()]
    return (counted.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
            .withColumn("accuracy", F.when(F.col("expected") > 0, F.col("found") / F.col("expected"))))


def entity_fidelity(before: Column, after: Column) -> Column:
    """Share of the entities of a text that are kept; null without entities."""
    keys = entity_keys(before)
    return F.when(F.size(keys) > 0, F.size(F.array_intersect(keys, entity_keys(after))) / F.size(keys))


def trigger_rates(df: DataFrame, layers: dict[str, str]) -> DataFrame:
    """(layer, rate): share of texts with at least one change record of the layer."""
    rows = [F.struct(F.lit(layer).alias("layer"), F.avg(F.when(F.size(col) > 0, 1.0).otherwise(0.0)).alias("rate"))
            for layer, col in layers.items()]
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def change_counts(df: DataFrame, changes: str = "changes") -> DataFrame:
    """(layer, type, before, after, n) over all change records."""
    return (item_rows(df, [], F.col(changes), "c")
            .groupBy("c.layer", "c.type", "c.before", "c.after").agg(F.count("*").alias("n")))


def error_type_counts(pairs: DataFrame) -> DataFrame:
    """(error_type, n) of pairs with an array of error types."""
    return (pairs.select(F.explode("error_types").alias("error_type")).groupBy("error_type")
            .agg(F.count("*").alias("n")))


def mode_comparison(results: DataFrame, modes: list[str], id_col: str = "id") -> DataFrame:
    """One row per text with the error rate of every mode; rows (id, mode, cer)."""
    return results.groupBy(id_col).pivot("mode", modes).agg(F.first("cer"))
