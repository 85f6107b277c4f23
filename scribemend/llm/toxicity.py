"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive examples, any other text is unlabelled.  With the class prior p, the risk
of a scorer g is  p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]),  l(z) = 1 / (1 + exp(z)) the sigmoid loss: what the
unlabelled texts cost as negatives, corrected for the positives among them and kept from falling below zero.  Several numpy classifiers are
trained this way, one to a task, each on all positives and a share of the unlabelled texts; a score is the
logistic function of their mean.

Features are the distinct words of a text (letters of A-Z lower-cased, other ASCII characters as gaps) and their first
4 to 7 bytes; texts are read whole.  Training takes at most POSITIVES and UNLABELLED documents, chosen by a digest of
doc_id; the prior comes from all labelled rows of the training folds.  Labels are learnt only from rows whose
crc32(doc_id as text) mod 5 is not 0 (a null doc_id counts as empty text).

A null or empty text gets the score of no feature at all.  Without any positive example all scores are 0.  A doc_id
labelled twice is toxic if one of its labels says so; null labels say nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.llm.common import matching, ship_package, stored, text_slices

POSITIVES, UNLABELLED, MODELS, FOLDS = 3000, 12000, 3, 5
MOST_FEATURES = 20_000
DECAY = 1e-5
WORDS = 150_000
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def fold(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def features(word: bytes) -> list[bytes]:
    return [word, *[b"^" + word[:n] for n in range(4, min(8, len(word)))]]


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode(errors="replace").translate(PLAIN).split())


def feature_rows(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Distinct features of each text as numbers, and the features: each word and feature is held once."""
    words: dict[bytes, np.ndarray] = {}
    numbers: dict[bytes, int] = {}
    rows = []
    for text in texts:
        parts = []
        for word in words_of(text):
            own = words.get(word)
            if own is None:
                own = words[word] = np.array([numbers.setdefault(f, len(numbers)) for f in features(word)], np.int32)
            parts.append(own)
        rows.append(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32))
    return rows, list(numbers)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: list[bytes], prior: float, steps: int = 300) -> dict[bytes, float]:
    """Weights by feature (the bias at b"") of one classifier, from rows of feature numbers."""
    n, m = len(positive), len(unlabelled)
    ones, others = (np.bincount(np.concatenate([np.zeros(0, np.int32), *rows]), minlength=len(names)) for rows in (positive, unlabelled))
    p, u = ones / n, (others + 0.5) / (m + 1)
    lift = (p - u) / np.sqrt(u * (1 - u) * (1 / n + 1 / m) + 1e-12)
    telling = sorted(np.flatnonzero((ones >= 3) & (lift > 5)).tolist(), key=lambda i: (-lift[i], names[i]))[:MOST_FEATURES]
    place = np.full(len(names), -1)
    place[telling] = np.arange(len(telling))
    names = [names[i] for i in telling]
    docs = [found[found >= 0] for found in (place[row] for row in [*positive, *unlabelled])]
    owner = np.repeat(np.arange(n + m), [len(d) for d in docs])
    which = np.concatenate([np.zeros(0, int), *docs]).astype(int)
    weight, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        g = bias + np.bincount(owner, weight[which], n + m)
        as_one = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        negative = as_one[n:].mean() - prior * as_one[:n].mean()  # what the unlabelled cost as negatives, corrected
        steep = as_one * (1 - as_one)
        push = np.empty(n + m)
        if negative >= 0:
            push[:n], push[n:] = -2 * prior * steep[:n] / n, steep[n:] / m
        else:  # the corrected part has gone below zero: go back up
            push[:n], push[n:] = prior * steep[:n] / n, -steep[n:] / m
        slope = np.append(np.bincount(which, push[owner], len(names)) + DECAY * weight, push.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return {b"": bias} | {f: float(w) for f, w in zip(names, weight, strict=True)}


@dataclass
class Model:
    """Mean weights of the classifiers; few enough for any worker."""

    weights: dict[bytes, float]
    known: bool = True

    def scores(self, texts: list[str | None], hits: dict[bytes, tuple]) -> np.ndarray:
        if not self.known:
            return np.zeros(len(texts))
        weights, out = self.weights, np.empty(len(texts))
        for i, text in enumerate(texts):
            found: set[bytes] = set()
            for word in words_of(text):
                own = hits.get(word)
                if own is None:
                    own = tuple(f for f in features(word) if f in weights)
                    if len(word) < 40:
                        if len(hits) >= WORDS:
                            hits.clear()
                        hits[word] = own
                if own:
                    found.update(own)
            out[i] = weights[b""] + sum(sorted(weights[f] for f in found))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
          models: int = MODELS, seed: int = 7) -> Model:
    own = labels.filter(fold(F.col("doc_id")) != 0).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, ones = own.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not ones:
        return Model({}, known=False)
    prior = min(0.9, ones / n)
    drawn = F.xxhash64(F.col("doc_id"), F.lit(seed))
    confirmed = own.filter("toxic = 1").select("doc_id").orderBy(drawn, "doc_id").limit(positives).withColumn("positive", F.lit(True))
    others = (docs.filter(fold(F.col("doc_id")) != 0).filter("doc_id IS NOT NULL").select("doc_id")
              .orderBy(drawn, "doc_id").limit(unlabelled).withColumn("positive", F.lit(False)))
    chosen = stored(confirmed.unionByName(others).distinct(), "pu-ids")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by the two arguments
    share = F.when(F.col("positive"), F.sequence(F.lit(0), F.lit(models - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(models)).cast("int")))
    dealt = texts.select(F.explode(share).alias("model"), "positive", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, names = feature_rows(group["text"].tolist())
        mark = group["positive"].tolist()
        one = [row for row, yes in zip(rows, mark, strict=True) if yes]
        rest = [row for row, yes in zip(rows, mark, strict=True) if not yes]
        found = fit(one, rest, names, prior) if one and rest else {}
        return pd.DataFrame({"feature": list(found), "weight": list(found.values())})

    trained = dealt.groupBy("model").applyInPandas(run, "feature binary, weight double")
    rows = trained.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()
    if not rows:
        return Model({}, known=False)
    trained_models = max(r["n"] for r in rows if not r["feature"])
    return Model({bytes(r["feature"]): r["weight"] / trained_models for r in sorted(rows, key=lambda r: bytes(r["feature"]))})


def score(model: Model, docs: DataFrame, text: Column) -> Column:
    """Score of a text column of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hits: dict[bytes, tuple] = {}
        for texts in batches:
            slices = text_slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")
            yield pa.array(np.concatenate([np.zeros(0), *[shared.value.scores(some.column(0).to_pylist(), hits) for some in slices]]))

    return scored(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ship_package(docs.sparkSession)
    model = train(docs, labels)
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(model, docs, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` (all columns) whose score is below one half."""
    ship_package(docs.sparkSession)
    return docs.filter(score(train(docs, labels), docs, docs["text"]) < 0.5)
