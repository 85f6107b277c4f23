"""Token tables, token windows and segmentation of unspaced text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.functions.text import item_rows, located_tokens, tokens
from scribemend.operators.aliases import resolve_aliases


LOOSE = r"[A-Za-z0-9]+|[^\s]"


def with_tokens(df: DataFrame, text_col: str = "text", out: str = "tokens", tokenizer=tokens) -> DataFrame:
    """Tokens of a text as an array in the same row; `tokenizer` is any Column -> ARRAY<STRING>."""
    return df.withColumn(out, F.filter(tokenizer(F.col(text_col)), lambda t: F.trim(t) != ""))


def token_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, token, start): one row per token with its character offset."""
    return (item_rows(df, [id_col], located_tokens(F.col(text_col)), "_t", "pos")
            .select(id_col, F.col("pos").cast("long").alias("pos"), "_t.token",
                    F.col("_t.start").cast("long").alias("start")))


def last_tokens(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, token): the last token of every text that has one."""
    found = df.select(id_col, tokens(F.col(text_col)).alias("_t")).filter(F.size("_t") > 0)
    return found.select(id_col, F.size("_t").cast("long").alias("pos"), F.element_at("_t", -1).alias("token"))


def segment_unspaced(df: DataFrame, words: DataFrame, id_col: str = "id", text_col: str = "text",
                     out: str = "located") -> DataFrame:
    """Located tokens of unspaced text: longest known word first, single characters elsewhere.

    Runs of digits and Latin letters stay together.  `words` is a table (word).
    """
    lexicon = words.select(F.col("word").alias("alias"), F.concat("word", F.lit(" ")).alias("canonical"),
                           F.abs(F.xxhash64("word")).alias("lex_order")).filter(F.length("alias") > 1)
    cut = resolve_aliases(df, lexicon, id_col, text_col)
    spans = F.col("resolved.spans")
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["pos"] + F.length(s["alias"])))
    starts = F.concat(F.transform(spans, lambda s: s["pos"]), F.array(F.length(text_col)))
    loose = F.zip_with(ends, starts, lambda a, b: F.transform(
        located_tokens(F.substring(F.col(text_col), a + 1, b - a), LOOSE),
        lambda t: F.struct(t["token"].alias("token"), (t["start"] + a).alias("start"))))
    known = F.concat(F.transform(spans, lambda s: F.array(F.struct(s["alias"].alias("token"), s["pos"].alias("start")))),
                     F.array(F.expr("CAST(array() AS array<struct<token:string,start:int>>)")))
    return cut.withColumn(out, F.flatten(F.zip_with(loose, known, lambda a, b: F.concat(a, b)))).drop("resolved")


def neighbours(token_array: Column, at: Column, before: int = 2, after: int = 2) -> Column:
    """STRUCT<before, after>: up to `before` / `after` tokens beside position `at` (from 0)."""
    start = F.greatest(at - before, F.lit(0))
    return F.struct(F.slice(token_array, start + 1, at - start).alias("before"),
                    F.slice(token_array, at + 2, F.lit(after)).alias("after"))


def around(token_array: Column, at: Column, window: int = 3) -> Column:
    """Tokens from `window` before to `window` after position `at` (from 0)."""
    start = F.greatest(at - window, F.lit(0))
    return F.slice(token_array, start + 1, at + window + 1 - start)


def gram_arrays(token_array: Column, n: int) -> Column:
    """All n-grams of a token array as ARRAY<ARRAY<STRING>>; the row keeps its place, no shuffle."""
    last = F.size(token_array) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                         lambda i: F.slice(token_array, i + 1, F.lit(n)))
                  ).otherwise(F.expr("CAST(array() AS array<array<string>>)"))
