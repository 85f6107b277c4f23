"""Failed corrections: class, responsible layer, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribemend.functions.text import character_error_rate, numbers

LAYERS = ["layer1", "layer2", "layer3", "layer4"]
WORSE_BY = 0.01

# Names of the failure classes.
NUMBER_ALTERED, MISSED, OVER_CORRECTED, OTHER = "数字篡改", "漏纠", "过纠", "其他"


def failure_class(original: Column, corrected: Column, expected: Column) -> Column:
    """First match wins: a number altered, nothing done, changed but still wrong, other."""
    altered = (numbers(corrected) != numbers(expected)) & (numbers(original) == numbers(expected))
    return (F.when(altered, NUMBER_ALTERED).when(corrected == original, MISSED)
            .when((original != corrected) & (corrected != expected), OVER_CORRECTED).otherwise(OTHER))


def responsible_layer(original: Column, expected: Column, outputs: Column) -> Column:
    """First layer that raises the error rate by more than 0.01, else the last one still wrong.

    `outputs` is ARRAY<STRING> of layer texts in order; null means the layer did not run.
    """
    texts = [original]
    for k in range(len(LAYERS)):
        texts.append(F.coalesce(F.get(outputs, F.lit(k)), texts[-1]))
    # the error rate is worked out only where a layer changed the text
    steps = F.array(*[F.struct(
        F.lit(name).alias("name"), after.alias("text"), (before != after).alias("changed"),
        F.when(before != after, character_error_rate(F.when(before != after, after), expected)).alias("cer"))
        for name, before, after in zip(LAYERS, texts, texts[1:], strict=False)])
    start = F.struct(character_error_rate(original, expected).alias("cer"), F.lit(None).cast("string").alias("blame"),
                     F.lit("unknown").alias("last_bad"))

    def fold(acc: Column, s: Column) -> Column:
        worse = s["changed"] & (s["cer"] > acc["cer"] + WORSE_BY)
        return F.struct(F.coalesce(s["cer"], acc["cer"]).alias("cer"),
                        F.coalesce(acc["blame"], F.when(worse, s["name"])).alias("blame"),
                        F.when(s["text"] != expected, s["name"]).otherwise(acc["last_bad"]).alias("last_bad"))

    return F.aggregate(steps, start, fold, lambda acc: F.coalesce(acc["blame"], acc["last_bad"]))


def layer_steps(df: DataFrame, expected: str = "expected", id_col: str = "id") -> DataFrame:
    """(id, layer_no, cer, previous_cer): layers that changed their input, from rows (id, layer_no, text).

    Layer 0 is the original text.
    """
    w = W.partitionBy(id_col).orderBy("layer_no")
    rated = df.withColumn("previous", F.lag("text").over(w)).filter((F.col("layer_no") > 0) & (F.col("text") != F.col("previous")))
    return rated.select(id_col, "layer_no", character_error_rate(F.col("text"), F.col(expected)).alias("cer"),
                        character_error_rate(F.col("previous"), F.col(expected)).alias("previous_cer"))


def failure_counts(failures: DataFrame) -> DataFrame:
    """(kind, name, n): failures by type, by layer and in total."""
    return (failures.groupingSets([["failure_type"], ["layer_responsible"], []], "failure_type", "layer_responsible")
            .agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
            .select(F.when(F.col("g") == 1, "by_type").when(F.col("g") == 2, "by_layer").otherwise("total").alias("kind"),
                    F.coalesce("failure_type", "layer_responsible", F.lit("")).alias("name"), "n"))
