"""Quality by votes of the nearest labelled documents in a latent-semantic space.

The terms of a text are its pairs of neighbouring character classes (letters by themselves, upper case as one class,
marks by themselves; counted over the whole text) and marks of how much it repeats its words and lines.  Terms are
weighed by their inverse frequency over all documents; the singular vectors of a bounded sample of labelled documents
span the latent space.  The sample's vectors are broadcast, every document's cosine with each of them is worked out
exactly, a block of documents at a time, and the labels of the NEAREST (all of them, if cosines tie with the last)
vote with their similarity.

At most LABELLED documents are drawn, by a digest of doc_id, from the rows whose crc32(doc_id as text) mod 5 is not 0;
the vectors stay under 8 MB whatever the corpus.  lang, source and doc_id are no terms.  A doc_id labelled twice has its
lower label, null labels and doc_ids say nothing; a labelled doc_id that several rows have counts once a row, up to
the bound.  A null or empty text is similar to nothing and gets the share of label 1 in the sample; without any label
every score is one half.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.llm.common import ship_package, stored
from scribemend.llm.toxicity import fold

LABELLED, DIMENSIONS, NEAREST = 8000, 64, 21
THRESHOLD = 0.3
DOCS_AT_ONCE = 256
CLASSES = 64
#: Marks that are a class of their own, after 26 letters, upper case, digits, space, line end and other bytes.
MARKS = ".,;:!?'\"()[]{}<>|/\\-_=+*#$%&@^~`"
#: Buckets of the shares of distinct words and lines, and of words of capital letters only; one term of repeated neighbours.
STEPS = 8
TERMS = CLASSES * CLASSES + 3 * STEPS + 1


def _classes() -> np.ndarray:
    out = np.full(256, 30, np.uint16)
    out[97:123] = np.arange(26)
    out[65:91], out[48:58], out[[32, 9]], out[[10, 13]] = 26, 27, 28, 29
    for k, mark in enumerate(MARKS):
        out[ord(mark)] = 31 + k
    return out


CLASS = _classes()
#: Pairs of letters tell languages apart more than quality, so that they count less than pairs with a mark or a gap.
LETTERS = 0.25
PAIR_WEIGHT = np.where(np.logical_and.outer(np.arange(CLASSES) < 26, np.arange(CLASSES) < 26), LETTERS, 1.0).ravel()


def terms_of(text: str | None) -> np.ndarray:
    """Weight of each term in a text: roots of the shares of class pairs, and buckets of repetition; zeros without text."""
    out = np.zeros(TERMS, np.float32)
    raw = (text or "").encode(errors="replace")
    words = raw.split()
    if not words:
        return out
    kinds = CLASS[np.frombuffer(raw, np.uint8)]
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
        out[:CLASSES * CLASSES] = np.sqrt(pairs / (len(kinds) - 1)) * PAIR_WEIGHT
    lines = [line for line in raw.split(b"\n") if line.strip()]
    shares = (len(set(words)) / len(words), len(set(lines)) / len(lines), sum(map(bytes.isupper, words)) / len(words))
    for k, share in enumerate(shares):
        out[CLASSES * CLASSES + k * STEPS + min(STEPS - 1, int(share * STEPS))] = 0.4
    again = sum(one == two for one, two in zip(words, words[1:], strict=False))
    out[-1] = np.sqrt(again / len(words))
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many documents have any; counted inside the tasks first."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(TERMS + 1, np.int64)
        for frame in frames:
            for text in frame["text"]:
                has = terms_of(text) > 0
                found[:-1] += has
                found[-1] += has.any()
        some = np.flatnonzero(found)
        yield pd.DataFrame({"term": some, "n": found[some]})

    rows = docs.select("text").mapInPandas(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, np.int64)  # at most TERMS + 1 rows came
    for row in rows:
        out[row["term"]] = row["n"]
    return out[:-1], int(out[-1])


@dataclass
class Model:
    """The latent space and the labelled vectors in it: LABELLED x DIMENSIONS numbers at most."""

    base: np.ndarray  # TERMS x DIMENSIONS, inverse frequencies included
    vectors: np.ndarray  # labelled documents x DIMENSIONS, of length 1 (0 for empty texts)
    labels: np.ndarray
    nearest: int = NEAREST

    def latent(self, rows: np.ndarray) -> np.ndarray:
        out = rows.astype(np.float64) @ self.base
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        prior, out = float(self.labels.mean()), np.empty(len(texts))
        for at in range(0, len(texts), DOCS_AT_ONCE):
            own = self.latent(np.stack([terms_of(text) for text in texts[at:at + DOCS_AT_ONCE]]))
            cosines = np.round(own @ self.vectors.T, 9)
            last = max(0, len(self.labels) - self.nearest)
            least = np.partition(cosines, last, axis=1)[:, last][:, None]
            votes = np.where((cosines >= least) & (cosines > 0), cosines, 0.0)
            total = votes.sum(axis=1)
            out[at:at + len(own)] = np.where(total > 0, votes @ self.labels / np.where(total > 0, total, 1.0), prior)
        return np.clip(out, 0.0, 1.0)


def latent_space(rows: np.ndarray, weight: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Inverse frequencies times the first right singular vectors of the weighted rows (block power iteration)."""
    weighted = rows * weight.astype(np.float32)
    wide = min(dimensions + 16, *weighted.shape)  # a wider block settles faster on the first ones
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((weighted.shape[1], wide)))[0].astype(np.float32)
    for _ in range(10):
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    turned = np.linalg.svd(weighted @ basis, full_matrices=False)[2][:dimensions]
    return weight[:, None] * (basis.astype(np.float64) @ turned.T)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, dimensions: int = DIMENSIONS,
          nearest: int = NEAREST, seed: int = 7) -> Model:
    own = labels.filter(fold(F.col("doc_id")) != 0).filter("quality IS NOT NULL AND doc_id IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = F.xxhash64(F.col("doc_id"), F.lit(seed))
    chosen = stored(own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(drawn, "doc_id").limit(labelled), "voter-ids")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by the argument

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [terms_of(text) for text in frame["text"]]
            some = [np.flatnonzero(row) for row in rows]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "quality": frame["quality"],
                                "at": [s.astype(np.uint16).tobytes() for s in some],
                                "weight": [row[s].tobytes() for row, s in zip(rows, some, strict=True)]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInPandas(kept, f"doc_id {kind}, quality int, at binary, weight binary")
    found = stored(found, "voters").orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id", "at", "weight").limit(labelled)
    rows = found.select("quality", "at", "weight").toArrow()  # a few kB a row, at most `labelled` rows
    voters = np.zeros((rows.num_rows, TERMS), np.float32)
    for out, at, weight in zip(voters, rows["at"], rows["weight"], strict=True):
        out[np.frombuffer(at.as_py(), np.uint16)] = np.frombuffer(weight.as_py(), np.float32)
    votes = np.array([float(x == 1) for x in rows["quality"].to_pylist()])
    if not len(votes) or not voters.any():
        return Model(np.zeros((TERMS, 1)), np.zeros((len(votes), 1)), votes, nearest)
    having, n = document_frequencies(docs)
    weight = np.where(having > 0, 1 + np.log((1 + n) / (1 + having)), 0.0)
    model = Model(latent_space(voters, weight, dimensions), np.zeros((0, 0)), votes, nearest)
    model.vectors = model.latent(voters)
    return model


def score(model: Model, docs: DataFrame, text: Column) -> Column:
    """Score of a text column of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))

    return voted(text)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ship_package(docs.sparkSession)
    model = train(docs, labels)
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(model, docs, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
