"""Lexicon files as tables: JSON maps, term libraries, rules, hotword and alias documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemend.functions.text import strip


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon files are small; each is one row (file, value)."""
    return spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())


def map_entries(json: Column) -> Column:
    """A JSON object of strings as ARRAY<STRUCT<key, value>> in file order."""
    return F.map_entries(F.from_json(json, "map<string,string>"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical, lex_order) of a JSON object alias -> canonical."""
    return (_whole(spark, path).select(F.posexplode(map_entries(F.col("value"))).alias("pos", "e"))
            .select(F.col("e.key").alias("alias"), F.col("e.value").alias("canonical"), F.col("pos").cast("long").alias("lex_order")))


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, correct, lex_order); keys that start with _ are comments."""
    return (read_aliases(spark, path).filter(~F.col("alias").startswith("_"))
            .select(F.col("alias").alias("wrong"), F.col("canonical").alias("correct"), "lex_order"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, aliases, patterns, lex_order) of {terms: [...]}; an invalid file gives no rows."""
    schema = "struct<terms:array<struct<canonical:string,aliases:array<string>,patterns:array<string>>>>"
    return (_whole(spark, path).select(F.posexplode(F.from_json("value", schema)["terms"]).alias("pos", "t"))
            .filter(F.length("t.canonical") > 0)
            .select("t.canonical", "t.aliases", "t.patterns", F.col("pos").cast("long").alias("lex_order")))


def term_aliases(terms: DataFrame) -> DataFrame:
    """(canonical, alias), one row per alias; a term without any keeps one row with null."""
    return terms.select("canonical", F.explode_outer("aliases").alias("alias"))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(rule_no, pattern, replacement); entries without both keys are comments."""
    schema = "array<struct<pattern:string,replacement:string>>"
    return (_whole(spark, path).select(F.posexplode(F.from_json("value", schema)).alias("rule_no", "r"))
            .filter(F.col("r.pattern").isNotNull() & F.col("r.replacement").isNotNull())
            .select(F.col("rule_no").cast("long").alias("rule_no"), "r.pattern", "r.replacement"))


def read_syllable_confusion(spark: SparkSession, path: str) -> DataFrame:
    """(level, src, dst) of {level: {src: [dst]}}; duplicates and identities removed."""
    levels = F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("level", "by_src")
    return (_whole(spark, path).select(levels).select("level", F.explode("by_src").alias("src", "dsts"))
            .select("level", "src", F.explode("dsts").alias("dst")).filter("src <> dst").distinct())


def hotword_items(json: Column) -> Column:
    """Elements of a JSON array, legacy strings and objects alike, as STRUCT<word, category, enabled>."""
    return F.transform(F.from_json(json, "array<string>"), lambda x: F.when(F.startswith(strip(x), F.lit("{")), F.struct(
        F.get_json_object(x, "$.word").alias("word"), F.get_json_object(x, "$.category").alias("category"),
        F.coalesce(F.get_json_object(x, "$.enabled").cast("boolean"), F.lit(True)).alias("enabled"))).otherwise(F.struct(
            x.alias("word"), F.lit(None).cast("string").alias("category"), F.lit(True).alias("enabled"))))


def read_hotwords(spark: SparkSession, path: str) -> DataFrame:
    return (_whole(spark, path).select(F.explode(hotword_items(F.col("value"))).alias("h")).select("h.*")
            .filter(F.col("word").isNotNull()))


def read_word_list(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(word): one per line, or separated within the lines."""
    lines = spark.read.text(path)
    words = F.split("value", separator, -1) if separator else F.array("value")
    return lines.select(F.explode(words).alias("w")).select(strip(F.col("w")).alias("word")).filter("word <> ''")


def parse_alias_lines(lines: DataFrame, order: str = "line_no", text: str = "line") -> DataFrame:
    """(alias, canonical, lex_order) of lines `a -> b`, else `a|b`; # and other lines skipped; the last one wins."""
    line = strip(F.col(text))
    sep = F.when(F.contains(line, F.lit("->")), F.lit("->")).when(F.contains(line, F.lit("|")), F.lit("|"))
    at = F.position(sep, line)
    alias = strip(F.substring(line, F.lit(1), at - 1))
    canonical = strip(F.substring(line, at + F.length(sep), F.length(line)))
    rows = (lines.filter(~F.startswith(line, F.lit("#")) & sep.isNotNull())
            .select(alias.alias("alias"), canonical.alias("canonical"), F.col(order).alias("lex_order"))
            .filter("alias <> '' AND canonical <> ''"))
    return rows.groupBy("alias").agg(F.max_by("canonical", "lex_order").alias("canonical"), F.max("lex_order").alias("lex_order"))


def parse_hotword_lines(lines: DataFrame, text: str = "line", category: str = "category") -> DataFrame:
    """(word, category, enabled): a line is a word, or a JSON array of words; a broken array stays a word."""
    line = strip(F.col(text))
    words = F.when(F.startswith(line, F.lit("[")), F.coalesce(F.from_json(line, "array<string>"), F.array(line))).otherwise(F.array(line))
    return (lines.filter(line != "").select(F.explode(words).alias("word"), F.col(category).alias("category"),
                                            F.lit(True).alias("enabled")).filter(F.col("word").isNotNull()))


def assemble_documents(segments: DataFrame, doc: str = "doc", pos: str = "pos", content: str = "content") -> DataFrame:
    """(doc, text): the segments of every document joined with newlines, empty ones left out.

    A document is bounded by its own segments; segments of one document never exceed a file.
    """
    return (segments.filter(F.length(content) > 0).groupBy(doc)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(content).alias("c")))).alias("s"))
            .select(doc, F.array_join(F.transform("s", lambda x: x["c"]), "\n").alias("text")))


def document_stem(name: Column) -> Column:
    """File name without folder and last extension."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def pick_version(documents: DataFrame, version: str | None, name: str = "name") -> DataFrame:
    """Documents whose stem equals the version, as category `default`; all, by stem, without one."""
    stem = document_stem(F.col(name))
    if version is None:
        return documents.withColumn("category", F.when(stem == "", F.lit("default")).otherwise(stem))
    return documents.filter(stem == version).withColumn("category", F.lit("default"))

