"""Shared inputs of the registered queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accented letters of the test texts and their plain forms, because the
# SQL engine measures edit distance in bytes.
ACCENTED = "éóèñüçêäößíÉÈÑÓÇÄÜÊÖÍ"
UNACCENTED = "eoenuceaosiEENOCAUEOI"

SENTENCE_GAP = r"[.\n]+\s*"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table; a table in fewer files than cores is spread over the cores."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores or table not in ("documents", "conversations") else df.repartition(cores)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return (read(spark, folder, "conversations")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text"))


TURNS_SQL = "SELECT conv_id * 1000 + turn AS id, conv_id, turn, text FROM conversations"


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence or line of every document as a transcript (id, text)."""
    return (documents(spark, folder).select("id", F.posexplode(F.split("text", SENTENCE_GAP, -1)).alias("k", "part"))
            .filter(F.length("part") > 0)
            .select((F.col("id") * 1000000 + F.col("k")).alias("id"), F.col("part").alias("text")))


UTTERANCES_SQL = f"""SELECT doc_id * 1000000 + (i - 1) AS id, parts[i] AS text
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT doc_id, string_split_regex(text, '{SENTENCE_GAP}') AS parts FROM documents))
WHERE length(parts[i]) > 0"""


def plain(text: Column) -> Column:
    return F.lower(F.translate(text, ACCENTED, UNACCENTED))


def plain_sql(text: str) -> str:
    return f"lower(translate({text}, '{ACCENTED}', '{UNACCENTED}'))"


# Misspellings that turn a correct text into a wrong one.
MISHEARD = [("the", "teh"), ("and", "adn"), ("que", "qeu"), ("der", "dre")]


def misheard(text: Column) -> Column:
    for right, wrong in MISHEARD:
        text = F.replace(text, F.lit(right), F.lit(wrong))
    return text


def misheard_sql(text: str) -> str:
    for right, wrong in MISHEARD:
        text = f"replace({text}, '{right}', '{wrong}')"
    return text


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, correct, asr): every utterance and its misheard form."""
    correct = utterances(spark, folder).select("id", plain(F.col("text")).alias("correct"))
    return correct.withColumn("asr", misheard(F.col("correct")))


PAIRS_SQL = f"""SELECT id, correct, {misheard_sql('correct')} AS asr
FROM (SELECT id, {plain_sql('text')} AS correct FROM ({UTTERANCES_SQL}))"""


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({columns})"


def counts_as_long(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so that both engines give one type."""
    return df.select(*[F.col(name).cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else F.col(name)
                       for name, kind in df.dtypes])
