"""Syllables of words: from a reading table or by folding Latin letters; similarity of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.session import broadcast_if_small

# Fixed value: a Latin syllable is consonants and vowels, the last one keeps its tail.
LATIN_SYLLABLE = "[^aeiouy]*[aeiouy]+(?:[^aeiouy]+$)?"


def latin_syllables(word: Column) -> Column:
    """Syllables of a lower-case Latin word; a word without a vowel is one syllable."""
    found = F.regexp_extract_all(word, F.lit(LATIN_SYLLABLE), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(word))


def reading_syllables(words: DataFrame, readings: DataFrame, word_col: str = "word") -> DataFrame:
    """Add `syls` to distinct words: characters joined with a table (ch, syllable).

    Characters without a reading stand together as one syllable, as a run of Latin
    letters does.  The table is broadcast only below the size bound.
    """
    distinct = words.select(word_col).distinct()
    runs = F.regexp_extract_all(F.col(word_col), F.lit(r"[㐀-鿿]|[^㐀-鿿]+"), F.lit(0))
    chars = distinct.select(word_col, F.posexplode(runs).alias("_pos", "ch"))
    read = chars.join(broadcast_if_small(readings.select("ch", "syllable")), "ch", "left")
    syls = (read.groupBy(word_col)
            .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("syllable", "ch").alias("s")))).alias("_s"))
            .select(word_col, F.transform("_s", lambda x: x["s"]).alias("syls")))
    return words.join(syls, word_col)


def syllable_key(syls: Column) -> Column:
    return F.array_join(syls, " ")


def reading_similarity(a: Column, b: Column) -> Column:
    """1 for equal readings; share of equal places; edit distance when the counts differ."""
    key_a, key_b = syllable_key(a), syllable_key(b)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    longer = F.greatest(F.length(key_a), F.length(key_b))
    distance = F.levenshtein(F.array_join(a, ""), F.array_join(b, ""))
    return (F.when(key_a == key_b, F.lit(1.0))
            .when(F.size(a) == F.size(b), equal / F.size(a))
            .when(longer == 0, F.lit(0.0)).otherwise(1 - distance / longer))
