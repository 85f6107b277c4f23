"""Approximate nearest neighbours by collision counting over single projections.

A block of vectors has PROJECTIONS arrays or PER_NUMBER for each component, if that is more, each sorted by one random projection.  For a query, a window around its own
projection is opened in every array; a vector collides with the query once for each window it lies in.  Vectors with
THRESHOLD of all collisions or more are verified with the exact measure.  While fewer than LEAST x k and a SHARE of the block pass, all
windows grow by one factor (virtual rehashing: the arrays stay as they are).  Once a window covers everything, the
whole block is verified, so there is no cap on candidates.  Blocks of at most LEAST x k entries are verified whole.

Inner products become distances by one more coordinate: vectors are scaled by the largest norm of their block and
lifted to the unit sphere, queries are scaled to norm 1; then the nearest is the one of the largest inner product.
That coordinate would drown the others in a block of many short vectors and few long ones, so a block holds vectors of
one range of norms.

Spark deals vectors to blocks of about BLOCK rows by norm and queries to chunks of about CHUNK rows; each chunk meets each
block once, and only the k best of a block leave it.  In a block equal vectors are one entry with its k + 1 smallest
ids, which is all that a query can need, so a vector that fills the table costs no more than another.

Vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
candidates; nor do rows without vec_id. A vector of another length than the most frequent one takes no part
either. Rows that repeat a vec_id and its vector are one candidate; a query repeated so is answered once.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribemend.llm.common import ship_package, stored

K = 20
PROJECTIONS, PER_NUMBER, THRESHOLD, SHARE, LEAST = 128, 2, 0.87, 0.04, 20
FIRST, GROWTH = 1.9, 1.08
BLOCK, CHUNK = 16_384, 2048
#: Numbers in a block at most, so that long vectors come in smaller blocks, but not below FLOOR rows.
NUMBERS, FLOOR = 1 << 20, 4096
#: Steps of the norm to a doubling of it; norms about 1 are in the middle of a step.
STEPS = 4


class Arrays:
    """The sorted projections of a block of distinct vectors (rows of unit length)."""

    def __init__(self, vectors: np.ndarray, seed: int):
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], max(PROJECTIONS, PER_NUMBER * (vectors.shape[1] - 1))))
        marks = (vectors @ self.directions).T
        self.order = np.argsort(marks, axis=1, kind="stable")
        self.sorted = np.take_along_axis(marks, self.order, axis=1)
        self.size = len(vectors)

    def windows(self, own: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the window of every query (rows of `own`) in every array."""
        low, high = np.empty(own.shape, np.int64), np.empty(own.shape, np.int64)
        for i, array in enumerate(self.sorted):
            low[:, i], high[:, i] = np.searchsorted(array, own[:, i] - half), np.searchsorted(array, own[:, i] + half)
        return low, high

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many of its windows each vector lies in; the smaller side of the windows is counted."""
        if 2 * (high - low).sum() <= self.size * len(self.order):
            inside = [row[a:b] for row, a, b in zip(self.order, low, high, strict=True)]
            return np.bincount(np.concatenate(inside), minlength=self.size)
        outside = [part for row, a, b in zip(self.order, low, high, strict=True) for part in (row[:a], row[b:])]
        return len(self.order) - np.bincount(np.concatenate(outside), minlength=self.size)

    def candidates(self, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query (a row of unit length) the entries of the block that are to be verified."""
        enough, needed = min(self.size, LEAST * k + int(SHARE * self.size)), int(np.ceil(THRESHOLD * len(self.order)))
        if self.size <= LEAST * k:
            for _ in queries:
                yield np.arange(self.size)
            return
        growth = GROWTH ** np.sqrt(PROJECTIONS / len(self.order))  # more arrays tell closer distances apart
        own = queries @ self.directions
        low, high = self.windows(own, FIRST)
        for j in range(len(queries)):
            half, a, b = FIRST, low[j], high[j]
            passed = np.flatnonzero(self.collisions(a, b) >= needed)
            while len(passed) < enough:  # virtual rehashing: wider windows over the same arrays
                half *= growth
                a, b = (x[0] for x in self.windows(own[j:j + 1], half))
                passed = np.flatnonzero(self.collisions(a, b) >= needed)
            yield passed


def dense(values: list) -> np.ndarray:
    """Rows as an array; -0.0 becomes 0.0, so that equal vectors have equal bytes."""
    return np.array([np.asarray(v, np.float64) for v in values]) + 0.0 if values else np.zeros((0, 0))


def block_answers(block: tuple, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
    """(query_id, vec_id, score) of the k best of a prepared block for each query; equal queries are searched once."""
    distinct, members, index = block
    asked: dict[bytes, list[int]] = {}
    for j, query in enumerate(queries):
        asked.setdefault(query.tobytes(), []).append(j)
    first = [own[0] for own in asked.values()]
    lifted = np.column_stack([queries[first] / np.linalg.norm(queries[first], axis=1)[:, None], np.zeros(len(first))])
    rows: list[tuple] = []
    for own, found in zip(asked.values(), index.candidates(lifted, k + 1), strict=True):
        query = queries[own[0]]
        about = distinct[found] @ query
        last = np.partition(about, -(k + 1))[-(k + 1)] if len(about) > k + 1 else -np.inf
        found = found[about >= last - 1e-9 * max(1.0, abs(last))]  # the exact measure decides among these
        scores = (distinct[found] * query).sum(axis=1)
        best = sorted((-score, v) for score, j in zip(scores.tolist(), found) for v in members[j])
        for j in own:
            name = int(query_ids[j])
            rows += [(name, v, -score) for score, v in best if v != name][:k]
    return rows


def norm_ranges(counts: list[tuple[int, int]], k: int) -> list[tuple[list[int], int]]:
    """Steps of the norm (step, rows) as ranges (steps, rows), from the longest vectors down.

    A range is one step with shorter vectors that are no more than it has itself, or as many steps as are verified whole.
    """
    ranges: list[tuple[list[int], int]] = []
    head = 0
    for step, n in sorted(counts, reverse=True):
        if ranges and (ranges[-1][1] + n <= LEAST * k or ranges[-1][1] + n <= 2 * head):
            ranges[-1] = ([*ranges[-1][0], step], ranges[-1][1] + n)
        else:
            head = n
            ranges.append(([step], n))
    return ranges


def prepared(ids: np.ndarray, vectors: np.ndarray, k: int, seed: int) -> tuple:
    """Distinct vectors of a block, the smallest ids of each, and the sorted arrays."""
    places: dict[bytes, int] = {}
    members: list[list[int]] = []
    first = []
    for i in np.argsort(ids, kind="stable"):
        own = places.setdefault(vectors[i].tobytes(), len(members))
        if own == len(members):
            members.append([])
            first.append(i)
        if len(members[own]) <= k and (not members[own] or members[own][-1] != ids[i]):
            members[own].append(int(ids[i]))
    distinct = vectors[first]
    scaled = distinct / (np.sqrt((distinct * distinct).sum(axis=1).max()) * (1 + 1e-12))
    lifted = np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))])
    return distinct, members, Arrays(lifted, seed)


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) that are queries, against all rows."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.filter("vec_id IS NOT NULL").filter(F.coalesce(usable(F.col("v")), F.lit(False)))
    rows = stored(rows.withColumn("d", F.size("v")), "vectors")
    most = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = rows.filter(F.col("d") == most["d"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    asked = rows.agg(F.sum(F.col("asks").cast("long"))).first()[0]
    if not asked:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = rows.withColumn("step", F.when(norm > 0, F.floor(F.log2(norm) * STEPS + 0.5)).otherwise(-(1 << 20)).cast("int"))
    fit = max(1, NUMBERS // max(1, most["d"]))
    chunks, blocks, dealt = -(-asked // min(CHUNK, fit)), 0, []
    for steps, n in norm_ranges([tuple(r) for r in rows.groupBy("step").count().collect()], k + 1):
        parts = -(-n // min(BLOCK, max(FLOOR, fit)))
        dealt += [(step, blocks, parts) for step in steps]
        blocks += parts
    ranges = vectors.sparkSession.createDataFrame(dealt, "step int, base int, parts int")

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        np.savez(held, ids=group["vec_id"].to_numpy(np.int64), v=dense(group["v"].tolist()))
        return pd.DataFrame({"part": [group["part"].iloc[0]], "data": [held.getvalue()]})

    def part(count: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), count).cast("int")

    blocked = rows.join(F.broadcast(ranges), "step").select((F.col("base") + part(F.col("parts"), 1)).alias("part"), "vec_id", "v").groupBy("part").applyInPandas(packed, "part int, data binary")
    asking = rows.filter("asks").select("vec_id", "v").distinct().select(part(F.lit(chunks), 2).alias("part"), "vec_id", "v")
    asking = stored(asking.groupBy("part").applyInPandas(packed, "part int, data binary"), "chunks")
    # one row for each chunk and block; a block's arrays are made once for the chunks that follow one another
    meeting = asking.select(F.col("part").alias("chunk"), F.col("data").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
    meeting = meeting.join(stored(blocked, "blocks"), "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ready = -1, None
        for batch in batches:
            for block, asked_data, data in zip(batch["part"], batch["asked"], batch["data"], strict=True):
                if block != held:
                    with np.load(io.BytesIO(data)) as file:
                        held, ready = block, prepared(file["ids"], file["v"], k, seed)
                with np.load(io.BytesIO(asked_data)) as file:
                    found = block_answers(ready, file["ids"], file["v"], k)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    spread = max(1, min(blocks * chunks, vectors.sparkSession.sparkContext.defaultParallelism * 4))
    found = meeting.repartition(spread, "part", "chunk").sortWithinPartitions("part").mapInPandas(
        run, "query_id long, vec_id long, score double").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
