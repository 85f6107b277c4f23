"""Documents made into training data: each stage works on all that the one before has kept.

Toxic documents go; of equal texts one stays; of each class of near copies (five-word shingles, Jaccard 0.8 or more)
the smallest doc_id stays; sources are mixed to their target weights, a document as often as the mix takes it; the
texts become token ids.  All stages but the last return the columns of their documents.

What a stage stores for itself is deleted when the next one begins, which reads the stored result only.

Rows are never told apart by their place: repeated rows share decisions, a null doc_id stays until the mix, where it
has a size and a key like any other.  Null texts count as empty: they are not toxic, equal to one another, and taken
by no mix, since they have no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemend.llm import bpe, exact, jaccard, mixing, toxicity
from scribemend.llm.common import in_stage, stored, table
from scribemend.session import drop_paths, made_paths

#: Entries of each table of the encoder: a worker keeps them, about 30 MB, when it goes on to other stages.
KEPT = 100_000


@in_stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


@in_stage
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


@in_stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


@in_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sizes = mixing.measured(docs)
    return mixing.mixed(docs, mixing.mix(mixing.with_quality(sizes, table(spark, sf_dir, "labels"))))


@in_stage
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, kept=KEPT)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_dedup_stage), ("n-gram Jaccard join", jaccard_stage),
          ("mixing sources", mixing_stage), ("byte-level BPE", bpe_stage)]
#: SQL cannot train the classifier or encode; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs, results = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        results.append(made_paths(spark)[-1])
        drop_paths(spark, results, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
