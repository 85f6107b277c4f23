"""Corpus lines and error pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemend.functions.text import strip

PAIR_SCHEMA = "asr string, correct string, error_types array<string>"


def read_error_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(asr, correct, error_types) of JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(PAIR_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def corpus_lines(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """(text): every non-blank line, trimmed."""
    return (texts.select(F.explode(F.split(text_col, r"\r?\n")).alias("line"))
            .select(strip(F.col("line")).alias("text")).filter("text <> ''"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return corpus_lines(spark.read.text(path))


def extend_corpus(candidates: DataFrame, corpus: DataFrame, min_length: int = 2, max_length: int | None = None) -> DataFrame:
    """Candidate lines (text) that are clean, of fair length, new to the corpus and each once; long ones stay unless bounded."""
    size = F.length("text") >= min_length
    if max_length is not None:
        size = size & (F.length("text") <= max_length)
    clean = (candidates.select(strip(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text"))
             .filter(size & F.col("text").rlike(r"\p{L}")))
    return clean.distinct().join(corpus.select("text").distinct(), "text", "left_anti")
