"""Source divergence audit over run-length columns of term counts.

Every (lang, source) group gives each kept term of its language the smoothed whole-number share
p = 1 + floor(1e9 (count + 1) / (N + V)).  The divergence of a group from another is the sum over all kept terms of
f = floor((p - q)^2 / q).  The vocabulary is put in an order in which terms of equal counts lie together: by the number
of sources that have a term, a digest of which ones, the total, and a digest of all counts.  A group is then a column
over that order, kept as runs of equal p; the column pieces of a block of BLOCK terms meet in one task, where the run
boundaries of each pair are intersected and f counts once a run, times its length.  Digests only decide the order:
runs are made of the counts themselves, so that a collision costs a run and no result.

A piece has at most BLOCK runs; sources are dealt over tiles of about TILE, so that a task holds two tiles of pieces
whatever the number of sources.  Terms are counted inside the tasks before any shuffle.

Null text, lang and source count as empty text.  Rows that repeat a doc_id are documents of their own; doc_id and
other columns are not read.  A language without kept terms has pairs of value 0 and no terms.  Ties of a value are
ordered by the UTF-8 of the item.  Whole-number arithmetic is exact while a language keeps under 2^31 terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribemend.llm.common import attach, ship_package, stored

LEAST_DOCS = 3
TOP_TERMS = 200
BLOCK_BITS = 12
TILE = 64
SCALE = 1_000_000_000
#: Terms that a task holds before it passes its counts on.
HELD = 600_000
#: Letters of A-Z lower-cased, bytes of other characters than ASCII as they are, the rest gaps between terms.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and the documents that have it."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, docs) in groups.items():
                if not n:
                    continue
                yield pd.DataFrame({"lang": [lang] * len(n), "source": [source] * len(n), "term": [t.decode() for t in n],
                                    "n": list(n.values()), "docs": [docs[t] for t in n]})
            groups.clear()

        for frame in frames:
            for lang, source, text in zip(frame["lang"], frame["source"], frame["text"], strict=True):
                words = text.encode().translate(PLAIN).split()
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from out()
        yield from out()

    rows = _named(docs).mapInPandas(counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def ordered_vocabulary(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, place) of the kept terms; by rising place equal counts lie together."""
    terms = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("sources"),
        F.bit_xor(F.xxhash64("source")).alias("which"), F.bit_xor(F.xxhash64("source", "n")).alias("shape"))
    order = ["lang", "sources", "which", "total", "shape", "term"]
    terms = terms.filter(F.col("docs") >= least_docs).repartitionByRange(*order).sortWithinPartitions(*order)
    return terms.select("lang", "term", "total", F.monotonically_increasing_id().alias("place"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (n + v)), exactly: in 64 bits where the product fits, else as decimals."""
    fits = count < (1 << 63) // SCALE - 1
    quick = F.call_function("div", F.lit(SCALE).cast("long") * (F.when(fits, count).otherwise(0) + 1), n + v)
    whole = F.lit(SCALE).cast("decimal(19,0)") * (count + 1).cast("decimal(18,0)")
    wide = F.call_function("div", whole, (n + v).cast("decimal(18,0)")).cast("long")
    return F.when(fits, quick).otherwise(wide) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_facts(docs: DataFrame, entries: DataFrame, vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """(lang, source, n, rows, v, lang_n, tiles, tile) of every group, also of those without a term; stored."""
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    found = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    every = stored(_named(docs).select("lang", "source").distinct(), "sources")
    many = every.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    none = F.lit(0).cast("long")
    return stored(every.join(found, ["lang", "source"], "left").join(langs, "lang", "left").join(many, "lang").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("n", "rows", "v", "lang_n")], "tiles",
        F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")), "groups")


def runs(shares: DataFrame) -> DataFrame:
    """(lang, block, source, p, start, length): the counted terms of each column piece as runs of equal p."""
    piece = ["lang", "block", "source", "tile", "tiles", "p"]
    nth = F.row_number().over(Window.partitionBy(*piece).orderBy("at"))
    return (shares.withColumn("run", F.col("at") - nth).groupBy(*piece, "run")
            .agg(F.min("at").cast("int").alias("start"), F.count("*").cast("int").alias("length")).drop("run"))


def _column(base: int, size: int, empty: int, start: np.ndarray, length: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A whole column piece: run boundaries and values, with runs of `empty` where no count is."""
    order = np.argsort(start)
    start, end, p = start[order], (start + length)[order], p[order]
    edges, at = [base], [empty]
    for s, e, value in zip(start.tolist(), end.tolist(), p.tolist(), strict=True):
        if s == edges[-1]:  # the empty run before it has no length
            edges.pop(), at.pop()
        edges += [s, e]
        at += [value, empty]
    if edges[-1] == base + size:
        edges.pop(), at.pop()
    return np.array(edges, np.int64), np.array(at, np.int64)


def pair_sums(columns: dict[str, tuple[np.ndarray, np.ndarray]], pairs: list[tuple[str, str]], end: int) -> list[tuple[str, str, int]]:
    """(source, other, sum of f) in both directions of each pair, from run boundaries and values up to `end`."""
    out = []
    for one, two in pairs:
        (a, p), (b, q) = columns[one], columns[two]
        edges = np.union1d(a, b)
        length = np.diff(np.append(edges, end))
        p, q = p[np.searchsorted(a, edges, "right") - 1], q[np.searchsorted(b, edges, "right") - 1]
        square = (p - q) ** 2
        out.append((one, two, int((square // q * length).sum())))
        out.append((two, one, int((square // p * length).sum())))
    return out


def divergences(pieces: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs from column pieces; a piece's row of start -1 has its place and size."""

    def met(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        columns, tiles, end = {}, {}, 0
        for source, rows in frame.groupby("source", sort=True):
            head = rows[rows["start"] < 0].iloc[0]
            rest = rows[rows["start"] >= 0]
            columns[source] = _column(int(head["base"]), int(head["length"]), int(head["p"]), rest["start"].to_numpy(np.int64),
                                      rest["length"].to_numpy(np.int64), rest["p"].to_numpy(np.int64))
            tiles[source], end = int(head["tile"]), int(head["base"]) + int(head["length"])
        names = list(columns)
        if key[2] == key[3]:
            pairs = [(one, two) for i, one in enumerate(names) for two in names[i + 1:]]
        else:
            pairs = [(one, two) for one in names if tiles[one] == key[2] for two in names if tiles[two] == key[3]]
        found = pair_sums(columns, pairs, end)
        names = pd.DataFrame([(key[0], one, two) for one, two, _ in found], columns=["lang", "source", "item"], dtype=object)
        return names.assign(value=np.array([x[2] for x in found], np.int64))

    other = F.explode(F.expr("sequence(0, tiles - 1)"))
    dealt = pieces.withColumn("other", other).withColumn("one", F.least("tile", "other")).withColumn("two", F.greatest("tile", "other"))
    sums = dealt.select("lang", "block", "one", "two", "source", "tile", "p", "start", "length", "base").groupBy(
        "lang", "block", "one", "two").applyInPandas(met, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_bits: int = BLOCK_BITS,
          tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group is from each other one, and by which terms."""
    ship_package(docs.sparkSession)
    counts = stored(term_counts(docs), "term-counts")
    vocabulary = stored(ordered_vocabulary(counts, least_docs), "vocabulary")
    entries = stored(counts.drop("docs").join(vocabulary, ["lang", "term"]), "entries")
    groups = group_facts(docs, entries, vocabulary, tile)
    facts = groups.withColumnRenamed("n", "group_n")
    known = attach(entries, facts, ["lang", "source"], "rows", F.col("place"))
    known = known.withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))

    block = F.shiftright("place", block_bits)
    shares = known.select("lang", "source", "tile", "tiles", "p", block.alias("block"),
                          (F.col("place") - F.shiftleft(block, block_bits)).alias("at"))
    blocks = vocabulary.groupBy("lang", block.alias("block")).agg(
        F.min(F.col("place") - F.shiftleft(block, block_bits)).cast("int").alias("base"), F.count("*").cast("int").alias("length"))
    # a language may have most blocks: its groups meet them in parts
    salted = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(32)).cast("int"))
    rosters = (groups.filter("v > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(31)))).join(salted, ["lang", "part"])
               .select("lang", "block", "source", "tile", "tiles", share(F.lit(0).cast("long"), F.col("n"), F.col("v")).alias("p"),
                       F.lit(-1).alias("start"), "length", "base"))
    pieces = rosters.unionByName(runs(shares).withColumn("base", F.lit(None).cast("int")))
    alone = groups.filter("v = 0").select("lang", "source")
    pairs = divergences(pieces).unionByName(
        alone.join(alone.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long")))

    q = share(F.col("total"), F.col("lang_n"), F.col("v"))
    terms = known.withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"),
                                                           _f(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    both = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(
        terms.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
