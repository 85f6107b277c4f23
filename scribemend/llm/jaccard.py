"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are put in one order over the corpus, rare ones first.  If two sets overlap in o shingles, the first
size - o + k of each share at least k.  Every document takes the k of least estimated cost: a longer prefix reads more
postings, but a partner must then share k of them before it is verified.  A pair uses the smaller k of its two and
the overlap that its two sizes need, so nothing is lost.

Frequencies come from a sketch over all documents: counts by WIDTH buckets of the shingle's hash, which has one size
for any corpus.  Its noise only changes the order, never the result.

Groups are kept from growing with their square without losing a link.  Equal sets are one node.  In each posting list
all nodes are first compared with one of them (the star); the links give components.  Then only pairs of
different components are left, made as (rows outside the list's largest component) x (rows of the list), in cells of
CELL x CELL rows and ranges of sizes where a list is long.  So a class of near copies costs about its size, and copies
are never expanded into pairs.  Pairs meet their sets by joins in which a hub is dealt over many tasks.

`linked` needs no more links than its classes do; `all_links` gives every link between different sets, with the
membership of the copies, and `link_counts` the number of links of each document.

Words are runs of anything but space and the characters 9 to 13, with A-Z lower-cased.  Null texts and texts without
words have an empty set and no links; a text of fewer words than a shingle is one shingle.  Rows that share a doc_id
are one document, linked through any of their texts: each different text is a node of its own, named in the order of the
doc_ids, and the nodes of a document are linked at the end.  A row without doc_id takes no part and has no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.llm.common import attach, dealt_join, matching, ship_package, stored, text_slices

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WIDTH = 1 << 20
CHUNK = 1 << 12
MOST_MATCHES = 4
#: Shingles of eight bytes that may be broadcast: about 50 MB.
LIST_ROWS = 3_000_000
WORDS = 150_000
#: Rows of one side of a cell in which the rows of a long posting list meet.
CELL = 4096
ONE = np.uint64(1)


class Shingler:
    """Distinct shingle hashes of texts; remembers word hashes in a bounded table."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def _word(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 24:
            if len(self.known) >= WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        get = self.known.get
        hashes = np.array([get(w) or self._word(w) for w in words], np.uint64)
        size = min(self.n, len(hashes))
        out = np.full(len(hashes) - size + 1, size, np.uint64)
        for i in range(size):
            out = (out ^ hashes[i:i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, unnamed, text): no nulls, because pandas turns numbers beside nulls into floats."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def scan(docs: DataFrame, n: int) -> DataFrame:
    """One pass over all texts, stored: (part -1, doc_id, size, mark) of every row, and (part k, size 0, mark) with
    counts of a run of buckets of the sketch."""
    names = ["part", "doc_id", "unnamed", "size", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(n), np.zeros(WIDTH, np.uint32)
        for batch in batches:
            for some in text_slices(batch, "text"):
                sizes, marks = [], []
                for text in some.column("text").to_pylist():
                    found = shingles(text)
                    sizes.append(len(found))
                    marks.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    np.add.at(counts, (found >> np.uint64(44)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), -1, np.int32)), some.column("doc_id"), some.column("unnamed"),
                                                  pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())], names)
        pieces = counts.reshape(-1, CHUNK)
        some = [k for k in range(len(pieces)) if pieces[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.zeros(len(some), np.int64)), pa.array([True] * len(some), pa.bool_()),
                                          pa.array(np.zeros(len(some), np.int64)), pa.array([pieces[k].tobytes() for k in some], pa.binary())], names)

    rows = texts(docs).mapInArrow(run, "part int, doc_id long, unnamed boolean, size long, mark binary")
    return stored(rows.select("part", F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "size", "mark"), "shingle-scan")


def sketch(scanned: DataFrame) -> np.ndarray:
    """The summed counts: WIDTH numbers, whatever the size of the corpus."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.uint64)
        for piece in group["mark"]:
            total += np.frombuffer(piece, "<u8" if len(piece) == 8 * CHUNK else "<u4")
        return pd.DataFrame({"part": [group["part"].iloc[0]], "salt": 0, "mark": [total.astype("<u8").tobytes()]})

    pieces = scanned.filter("part >= 0").withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(16)).cast("int"))
    some = pieces.groupBy("part", "salt").applyInPandas(add, "part int, salt int, mark binary")
    out = np.zeros(WIDTH, np.uint64)
    for row in some.groupBy("part").applyInPandas(add, "part int, salt int, mark binary").collect():
        out[row["part"] * CHUNK:(row["part"] + 1) * CHUNK] = np.frombuffer(bytes(row["mark"]), "<u8")
    return out


def prefix_length(size: int, k: int, similarity: Fraction) -> int:
    """The longest prefix that a size needs for any partner and k: the smallest partner asks for the least overlap."""
    least = -(-similarity.numerator * size // similarity.denominator)
    return min(size, size - least + k)


def choose_matches(counts: np.ndarray, size: int, similarity: Fraction) -> int:
    """The k of least estimated cost for a document, from the counts of its shingles in order.

    Postings to read are the counts in the prefix.  A partner that shares k shingles lies in k of its lists, so there
    are about as many as the k-th largest list holds; verifying one costs about as much as its size in postings.
    """
    best, least = 1, math.inf
    for k in range(1, MOST_MATCHES + 1):
        prefix = counts[:prefix_length(size, k, similarity)]
        if k > len(prefix):
            break
        cost = float(prefix.sum()) + k + float(np.partition(prefix, len(prefix) - k)[len(prefix) - k]) * (4 + size / 16)
        if cost < least:
            best, least = k, cost
    return best


def prefixes(docs: DataFrame, counts: np.ndarray, n: int, similarity: Fraction) -> DataFrame:
    """(doc_id, size, k, prefix) of every text that has shingles, stored; prefixes in the order of the corpus."""
    noise = counts.sum() / WIDTH
    shared = docs.sparkSession.sparkContext.broadcast(np.maximum(1.0, counts - noise).astype(np.float32))

    def made(batch: pa.RecordBatch, shingles: Shingler, known: np.ndarray) -> pa.RecordBatch:
        rows = []
        for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = shingles(text)
            if not len(found):
                continue
            count = known[(found >> np.uint64(44)).astype(np.int64)]
            order = np.lexsort((found, count))[:prefix_length(len(found), MOST_MATCHES, similarity)]
            k = choose_matches(count[order], len(found), similarity)
            prefix = order[:prefix_length(len(found), k, similarity)]
            rows.append((name, len(found), k, found[prefix].view(np.int64)))
        kinds = {"doc_id": pa.int64(), "size": pa.int32(), "k": pa.int32(), "prefix": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known = Shingler(n), shared.value
        for batch in batches:
            for some in text_slices(batch, "text"):
                yield made(some, shingles, known)

    return stored(texts(docs).filter("NOT unnamed").mapInArrow(
        run, "doc_id long, size int, k int, prefix array<long>"), "prefixes")


def verified(docs: DataFrame, pairs: DataFrame, n: int, similarity: Fraction) -> DataFrame:
    """The stored pairs (a, b) whose whole sets reach the similarity; stored."""
    p, q = similarity.numerator, similarity.denominator
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in batches:
            for some in text_slices(batch, "text"):  # sets are as large as their texts: a few at a time
                found = pa.array([shingles(t).tobytes() for t in some.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), found], ["doc_id", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "x"):
                keep = []
                for x, y in zip(some.column("x").to_pylist(), some.column("y").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    small = min(len(x), len(y))
                    both = len(np.intersect1d(x, y, assume_unique=True)) if q * small >= p * max(len(x), len(y)) else 0
                    keep.append(small > 0 and q * both >= p * (len(x) + len(y) - both))
                yield some.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = stored(matching(texts(docs).filter("NOT unnamed"), wanted, ["doc_id"]).mapInArrow(cut, "doc_id long, found binary"), "sets")
    rows = dealt_join(pairs, pairs, sets.select(F.col("doc_id").alias("a"), F.col("found").alias("x")), "a", F.col("b"))
    rows = dealt_join(rows, pairs, sets.select(F.col("doc_id").alias("b"), F.col("found").alias("y")), "b", F.col("a"))
    return stored(rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct(), "links")


def plausible(pairs: DataFrame, found: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose prefixes share as much as the prefixes of similar sets do; loses none of these.

    A prefix of size - overlap + k shingles must share k; here k is what the lengths of the two prefixes give.  It
    spares the whole sets of most pairs.
    """
    p, q = similarity.numerator, similarity.denominator

    def side(name: str) -> DataFrame:
        return found.select(F.col("doc_id").alias(name), F.col("size").alias(f"{name}_size"), F.col("prefix").alias(f"{name}_prefix"))

    rows = dealt_join(pairs.select("a", "b"), pairs, side("a"), "a", F.col("b"))
    rows = dealt_join(rows, pairs, side("b"), "b", F.col("a"))
    overlap = F.ceil((p * (F.col("a_size") + F.col("b_size"))) / (p + q))
    needed = overlap + F.least(F.size("a_prefix") - F.col("a_size"), F.size("b_prefix") - F.col("b_size"))
    return stored(rows.filter(F.size(F.array_intersect("a_prefix", "b_prefix")) >= needed).select("a", "b").distinct(), "plausible")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b): the smallest node that can be reached; stored.

    Alternating large and small stars: every node hangs its larger neighbours, then its smaller ones, on the smallest
    node that it knows, until each component is one star.
    """
    def star(edges: DataFrame, larger: bool) -> DataFrame:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = stored(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n")), "lowest")
        rows = attach(pairs, lowest, ["a"], "n", F.col("b"))
        if larger:
            hung = rows.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            hung = rows.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        return hung.filter("a <> b").distinct()

    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "edges")
    while True:
        after = stored(star(stored(star(edges, True), "large-star"), False), "small-star")
        # done when every node has one neighbour below it, and no node is both above and below
        state = after.groupBy("a").count().agg(F.max("count")).first()[0] or 1
        if state == 1 and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = after


def text_names(docs: DataFrame) -> DataFrame | None:
    """(doc_id, digest, name, n) of the texts of n rows, stored, if a doc_id has several rows: names from 0, in the order of doc_id."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    if ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return None
    each = with_digest(docs.select("doc_id", "text")).filter("doc_id IS NOT NULL").groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    numbered = stored(each, "texts").orderBy("doc_id", "digest").rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    return stored(docs.sparkSession.createDataFrame(numbered, "doc_id long, digest long, n long, name long"), "text-names")


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))


def by_name(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, text) with the names of the texts as doc_id."""
    rows = attach(with_digest(docs.select("doc_id", "text")), names, ["doc_id", "digest"], "n", F.rand(1))
    return stored(rows.select(F.col("name").alias("doc_id"), "text"), "named")


def linked(docs: DataFrame, n: int = 4, similarity: Fraction = Fraction(85, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text)."""
    ship_package(docs.sparkSession)
    names = text_names(docs)
    if names is None:
        return linked_texts(docs, n, similarity)
    found = stored(linked_texts(by_name(docs, names), n, similarity), "linked-texts")
    # a document joins the components of its texts
    first = stored(names.groupBy("doc_id").agg(F.min("name").alias("first"), F.count("*").alias("n")), "first-texts")
    own = attach(names.select("doc_id", "name"), first, ["doc_id"], "n", F.col("name")).select(F.col("first").alias("a"), F.col("name").alias("b"))
    links = found.filter("doc_id IS NOT NULL").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    labels = components(links.unionByName(own))
    known = names.select("name", "doc_id", "n").join(labels.withColumnRenamed("node", "name"), "name", "left")
    known = known.select("name", "doc_id", "n", F.coalesce("component", "name").alias("component"))
    tops = stored(known.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("top_n")), "tops")
    known = stored(attach(stored(known, "known"), tops, ["component"], "top_n", F.col("name")).select("name", F.col("doc_id").alias("id"), "n", "component_id"), "documents")
    out = attach(found.select(F.col("doc_id").alias("name"), "n_shingles"), known, ["name"], "n", F.rand(2))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def fits(similarity: Fraction, *sides: Column) -> Column:
    """Both places lie in the prefixes of this pair; size, k and place of a, then of b."""
    p, q = similarity.numerator, similarity.denominator
    size_a, k_a, at_a, size_b, k_b, at_b = sides
    overlap = F.ceil((p * (size_a + size_b)) / (p + q))  # exact: whole numbers far below 2^53
    k = F.least(k_a, k_b, overlap)
    return (q * F.least(size_a, size_b) >= p * F.greatest(size_a, size_b)) & (
        at_a < size_a - overlap + k) & (at_b < size_b - overlap + k)


def posting_lists(docs: DataFrame, n: int, similarity: Fraction) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored tables of (doc_id, text): (doc_id, size, mark) of all rows, (mark, node, n) of the different sets,
    their prefixes, and the postings of lists of several nodes with the list's hub and size."""
    scanned = scan(docs, n)
    rows = scanned.filter("part < 0").select("doc_id", "size", "mark")
    sets = stored(rows.filter("mark IS NOT NULL AND doc_id IS NOT NULL").groupBy("mark").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    # equal sets are one node: the other rows of a set make no postings
    copies = attach(rows.filter("mark IS NOT NULL AND doc_id IS NOT NULL"), stored(sets.filter("n > 1"), "copied"), ["mark"], "n", F.col("doc_id"))
    copies = stored(copies.filter("doc_id <> node").select("doc_id").distinct(), "copies")
    found = prefixes(docs, sketch(scanned), n, similarity)
    # shingles that stand in two prefixes; only their postings are dealt out with all that a pair needs
    lists = stored(found.select(F.explode("prefix").alias("shingle")).groupBy("shingle").count().filter("count > 1").select("shingle"), "lists")
    postings = found.select(F.col("doc_id").alias("node"), "size", "k", F.posexplode("prefix").alias("at", "shingle"))
    postings = stored(matching(matching(postings, lists, ["shingle"], rows=LIST_ROWS), copies.withColumnRenamed("doc_id", "node"), ["node"], "left_anti"), "postings")
    lists = postings.groupBy("shingle").agg(F.count("*").alias("n"), F.min(F.struct("node", "size", "k", "at")).alias("hub"))
    lists = stored(lists.filter("n > 1"), "hubs")
    shared = stored(attach(postings, lists, ["shingle"], "n", F.col("node")).filter("n IS NOT NULL"), "shared")
    return rows, sets, found, shared


def crossing(placed: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share k shingles of their prefixes; stored.

    Rows outside the largest component of a list meet all rows of the list.  A list of more than CELL rows on a side is
    cut into cells, and these by steps of the size: sets of a pair are at most one step apart.
    """
    p, q = similarity.numerator, similarity.denominator
    parts = placed.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("shingle").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("list_n"), F.count("*").alias("parts"))
    main = main.filter("parts > 1").select("shingle", F.col("main.component").alias("main"), "list_n",
                                           F.ceil((F.col("list_n") - F.col("main.n")) / CELL).cast("int").alias("down"),
                                           F.ceil(F.col("list_n") / CELL).cast("int").alias("across"))
    main = stored(main, "mixed-lists")
    mixed = attach(placed, main, ["shingle"], "list_n", F.col("node")).filter("main IS NOT NULL")
    width = max(-math.log(similarity), 1e-6) * (1 + 1e-9)
    step = F.when(F.col("across") > 1, F.floor(F.log("size") / width)).otherwise(F.lit(0)).cast("int")
    mixed = stored(mixed.withColumn("step", step), "mixed")

    def cells(count: str) -> Column:
        return F.sequence(F.lit(0), F.col(count) - 1)

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(count)), F.col(count)).cast("int").alias(count)

    def named(side: str) -> list[Column]:
        return [F.col(c).alias(f"{side}_{c}") for c in ("node", "size", "k", "at", "component")]

    one = mixed.filter("component <> main").select("shingle", "step", own("down"), F.explode(cells("across")).alias("across"), *named("a"))
    near = F.when(F.col("across") > 1, F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).otherwise(F.array("step"))
    two = mixed.select("shingle", "main", F.explode(near).alias("step"), "down", own("across"), *named("b"))
    two = two.withColumn("down", F.explode(cells("down")))
    cross = one.join(two, ["shingle", "step", "down", "across"]).filter(
        (F.col("a_component") != F.col("b_component")) & ((F.col("b_component") == F.col("main")) | (F.col("a_node") < F.col("b_node"))))
    cross = cross.filter(fits(similarity, *[F.col(f"{s}_{c}") for s in "ab" for c in ("size", "k", "at")]))
    a, b = F.least("a_node", "b_node"), F.greatest("a_node", "b_node")
    overlap = F.ceil((p * (F.col("a_size") + F.col("b_size"))) / (p + q))
    cross = cross.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"), F.max(F.least("a_k", "b_k", overlap)).alias("k"))
    return stored(cross.filter("n >= k").select("a", "b"), "cross-pairs")


def linked_texts(docs: DataFrame, n: int, similarity: Fraction) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text), in which a doc_id has one text."""
    rows, sets, found, shared = posting_lists(docs, n, similarity)
    hub = [F.col(f"hub.{c}") for c in ("size", "k", "at")]
    star = shared.filter(F.col("node") != F.col("hub.node")).filter(fits(similarity, *hub, F.col("size"), F.col("k"), F.col("at")))
    star = stored(star.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), "star-pairs")
    links = verified(docs, plausible(star, found, similarity), n, similarity)
    labels = stored(components(links), "star-components")
    placed = shared.drop("n", "hub").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    cross = crossing(stored(placed, "placed"), similarity)
    more = verified(docs, plausible(cross, found, similarity), n, similarity)
    if not more.isEmpty():
        labels = stored(components(links.unionByName(more)), "components")
    # every row takes the class of its set
    classes = sets.join(labels.withColumnRenamed("component", "linked"), "node", "left").filter("n > 1 OR linked IS NOT NULL")
    classes = stored(classes.select("mark", F.coalesce("linked", "node").alias("class"), "n"), "classes")
    keyed = rows.withColumn("mark", F.coalesce("mark", F.xxhash64("doc_id").cast("string").cast("binary")))
    out = attach(keyed, classes, ["mark"], "n", F.coalesce("doc_id", F.lit(0)))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def all_links(docs: DataFrame, n: int = 4, similarity: Fraction = Fraction(85, 100)) -> tuple[DataFrame, DataFrame]:
    """All links between different sets of (doc_id, text), stored: pairs (a, b), a < b, of nodes, and (doc_id, node, n)
    of the rows, with the number of rows n of the node.

    A node is the smallest doc_id that has a set, so copies are members and make no pairs.  Rows without doc_id or
    without words are no members.  If a doc_id has several texts, nodes are names of texts, and it has a row for each text.
    """
    ship_package(docs.sparkSession)
    names = text_names(docs)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") if names is None else by_name(docs, names)
    rows, sets, found, shared = posting_lists(named, n, similarity)
    pairs = crossing(stored(shared.drop("n", "hub").withColumn("component", F.col("node")), "single"), similarity)
    pairs = verified(named, plausible(pairs, found, similarity), n, similarity)
    members = attach(rows.filter("mark IS NOT NULL AND doc_id IS NOT NULL"), sets, ["mark"], "n", F.col("doc_id")).select("doc_id", "node", "n")
    if names is not None:
        known = names.select(F.col("name").alias("node_name"), F.col("doc_id").alias("id"), F.col("n").alias("name_n"))
        members = attach(members.withColumnRenamed("doc_id", "node_name"), known, ["node_name"], "name_n", F.rand(3)).select(F.col("id").alias("doc_id"), "node", "n")
    return pairs, stored(members, "members")


def link_counts(docs: DataFrame, n: int = 4, similarity: Fraction = Fraction(85, 100)) -> DataFrame:
    """(doc_id, node, n_links) of the members of `all_links`: other rows that a row's text is linked with, its copies included."""
    pairs, members = all_links(docs, n, similarity)
    weights = stored(members.select("node", "n").distinct(), "node-sizes")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, "both-ways")
    far = dealt_join(both, both, weights.withColumnRenamed("node", "b"), "b", F.col("a"))
    far = far.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    own = stored(weights.join(far, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.col("n").alias("rows")), "counts")
    return attach(members.select("doc_id", "node"), own, ["node"], "rows", F.col("doc_id")).select("doc_id", "node", "n_links")


def one_of_each(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(80, 100)) -> DataFrame:
    """The rows of `docs` (all columns) of which the smallest doc_id of a class of texts stays; rows without doc_id stay."""
    ship_package(docs.sparkSession)
    names = text_names(docs)
    found = linked_texts(docs if names is None else by_name(docs, names), n, similarity)
    found = stored(found.filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    if names is None:
        return matching(packed.select("row", F.col("doc_id").cast("long").alias("doc_id")), found, ["doc_id"], "left_anti").select("row.*")
    # the texts that go, not all rows of their doc_id
    gone = stored(matching(names.withColumnRenamed("doc_id", "id"), found.withColumnRenamed("doc_id", "name"), ["name"]).select(
        F.col("id").alias("doc_id"), "digest"), "near-texts")
    return matching(with_digest(packed), gone, ["doc_id", "digest"], "left_anti").select("row.*")
