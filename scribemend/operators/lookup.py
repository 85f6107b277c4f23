"""Which strings of a large table a text holds, and where.

A table within INDEX_BYTES becomes an index: an automaton of all its strings, which is broadcast as the list of them and
reads a text once, so that the time goes with the text and hardly with the table.  Nothing of it enters the plan.
A larger table is met by joins on keys, the first KEY characters of its strings: a broadcast sieve of bits, bounded for a
table of any size, lets those windows of a text pass that can be a key.  The strings of the most frequent keys, as many as an index may hold, become one, which finds them where the
texts lie; only windows of the others travel, those of a frequent key dealt over PARTS tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.functions.text import in_project, item_rows
from scribemend.session import measured_bytes, ship_package, stored

#: Bytes of a table that may be an index: some hundred thousand strings, under 200 MB in a worker.
INDEX_BYTES = 16 * 1024 * 1024
#: Keys are of this length, or of the string's if that is shorter.
KEY = 24
PARTS = 32
#: Bits of a sieve: so many a key, no more than 2 ** MOST_BITS (32 MB) in all, in pages as long as Spark's bitmaps.
KEY_BITS, MOST_BITS, PAGE_BITS = 32, 28, 15
#: Odd numbers by which hashes are rolled, mixed and turned into places.
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
UNROLL = pow(int(ROLL), -1, 1 << 64)
#: The ends of keys are looked at first, by this many characters.
END, END_BITS = 3, 16
PROBES = [np.uint64(n) for n in (0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)]
#: Bytes of text whose strings, places and lists one step of an Arrow function holds.
SLICE_BYTES = 1 << 20


class StringIndex:
    """Strings by rank; of equal strings the first counts, empty ones are never found."""

    def __init__(self, strings: list[str]) -> None:
        self.strings = strings
        self.longest = max(map(len, strings), default=0)
        self._automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # each worker makes its own

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for rank, string in enumerate(self.strings):
                if string and string not in made:
                    made.add_word(string, (len(string), rank))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(place, rank) of every occurrence, overlapping ones included."""
        if not self.longest:
            return
        for end, (size, rank) in self.automaton.iter(text):
            yield end + 1 - size, rank

    def held(self, text: str) -> list[int]:
        """Ranks of the strings in a text, in order."""
        return sorted({rank for _, rank in self.hits(text)})


class Joined:
    """Values of a shared list and of an own one by the ranks of a MergedIndex."""

    def __init__(self, shared: list, own: list) -> None:
        self.shared, self.own = shared, own

    def __getitem__(self, rank: int):
        place, k = divmod(rank, len(self.own) + 1)
        return self.own[k] if k < len(self.own) else self.shared[place]


class MergedIndex:
    """A shared index and a few strings more, in order; `places` are the ranks of the shared ones that come after each."""

    def __init__(self, shared: StringIndex, own: list[str], places: list[int]) -> None:
        self.shared, self.own, self.places = shared, StringIndex(own), places
        self.strings = Joined(shared.strings, own)
        self.longest = max(shared.longest, self.own.longest)

    def held(self, text: str) -> list[int]:
        """Ranks of the strings in a text, in order."""
        size = len(self.places)
        found = [rank * (size + 1) + size for rank in self.shared.held(text)]
        return sorted(found + [self.places[k] * (size + 1) + k for k in self.own.held(text)])


def by_slices(work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """An Arrow function's result made of slices of about SLICE_BYTES, so that Python holds the strings and places of one only."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(columns[0]), 0).cast(pa.int64())).to_numpy()
    if not len(ends):
        return work(*columns)
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(ends)]
    return pa.concat_arrays([work(*[c.slice(a, b - a) for c in columns]) for a, b in zip(cuts, cuts[1:], strict=False)])


def indexed(table: DataFrame, columns: list[str], order: list[Column | str], limit: int = INDEX_BYTES, known: bool = False) -> Broadcast | None:
    """A table's columns as lists in the given order, the first one as a StringIndex, or None if it is over the bound.

    `known`: the table is stored already.
    """
    kept = table.select(*columns) if known else stored(table.select(*columns), "rules")  # measured and read: worked out once
    return None if measured_bytes(kept) > limit else _index_of(kept, columns, order)


def _index_of(kept: DataFrame, columns: list[str], order: list[Column | str]) -> Broadcast:
    ship_package(kept.sparkSession)
    held = kept.select(*columns).orderBy(*order).toArrow()
    lists = [held[name].to_pylist() for name in columns]
    return kept.sparkSession.sparkContext.broadcast((StringIndex(lists[0]), *lists[1:]))


def rolled(text: str, upto: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hash of the k characters from each place on) for k up to `upto`."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    made = np.ones(len(codes) + 1, np.uint64)
    for k in range(1, min(upto, len(codes)) + 1):
        made = made[:-1] * ROLL + codes[k - 1:]
        yield k, made


def _mixed(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ hashes >> np.uint64(29)) * MIX
    return mixed ^ mixed >> np.uint64(32)


@lru_cache(maxsize=4)
def _powers(factor: int, upto: int) -> np.ndarray:
    made = np.full(upto, factor, np.uint64)
    made[0] = 1
    return np.cumprod(made, dtype=np.uint64)


def _buckets(grams: np.ndarray) -> np.ndarray:
    return (_mixed(grams) >> np.uint64(64 - END_BITS)).astype(np.int64)


class KeySieve:
    """Lets windows of a text pass that can be one of many keys.

    A window's first and last END characters must be those of some keys of its size; then come some bits a key, looked at
    one after the other.
    """

    def __init__(self, bits: int, held: np.ndarray, ends: np.ndarray, sizes: list[int], longest: int) -> None:
        self.bits, self.held, self.ends, self.sizes, self.longest = bits, held, ends, sizes, longest

    def windows(self, rows: list[list[str]]) -> list[dict[str, list[str]]]:
        """For each row of texts the distinct windows that pass, with what follows those of KEY characters."""
        found: list[dict[str, list[str]]] = [{} for _ in rows]
        pieces = [(own, text, at) for own, texts in zip(found, rows, strict=True) for text in texts
                  for at in range(0, len(text), SLICE_BYTES)]  # a window begins in one piece and may end behind it
        while pieces:
            size = taken = 0
            while taken < len(pieces) and size < SLICE_BYTES:
                size += min(len(pieces[taken][1]) - pieces[taken][2], SLICE_BYTES)
                taken += 1
            self._sift(pieces[:taken])
            pieces = pieces[taken:]
        return found

    def _sift(self, pieces: list[tuple[dict[str, list[str]], str, int]]) -> None:
        cuts = [text[at:at + SLICE_BYTES + KEY - 1] for _, text, at in pieces]
        lengths = np.array([len(c) for c in cuts], np.int64)
        ends, whole = np.cumsum(lengths), "".join(cuts)
        starts = (ends - lengths).tolist()
        piece_of = np.repeat(np.arange(len(cuts), dtype=np.int32), lengths)
        for k, at in self._candidates(whole):
            at = at[at + k <= ends[piece_of[at]]]
            for start, piece in zip(at.tolist(), piece_of[at].tolist(), strict=True):
                own, text, offset = pieces[piece]
                rests = own.setdefault(whole[start:start + k], [])
                if k == KEY:
                    behind = offset + start - starts[piece] + KEY
                    rests.append(text[behind:behind + max(self.longest - KEY, 0)])

    def _candidates(self, whole: str) -> Iterator[tuple[int, np.ndarray]]:
        """(size, places of windows that pass)."""
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.uint64)
        grams = codes
        for k, hashes in rolled(whole, END):
            grams = hashes
            if k < END and k in self.sizes:
                yield k, self._passing(np.arange(len(hashes)), hashes)
        if len(codes) < END:
            return
        buckets = _buckets(grams)
        first, last = self.ends[0][buckets], self.ends[1][buckets]
        room = 1 << (len(codes) + KEY).bit_length()
        back, sums = _powers(int(ROLL), room), np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _powers(UNROLL, room)[:len(codes)], out=sums[1:])
        for k in self.sizes:
            count = len(codes) - k + 1
            if k >= END and count > 0:
                at = np.flatnonzero(first[:count] & last[k - END:k - END + count] & np.uint32(1 << k))
                yield k, self._passing(at, back[k] + back[at + (k - 1)] * (sums[at + k] - sums[at]))

    def _passing(self, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        mixed, shift = _mixed(hashes), np.uint64(64 - self.bits)
        for factor in PROBES:
            stay = self._set(mixed * factor >> shift)
            at, mixed = at[stay], mixed[stay]
        return at

    def _set(self, places: np.ndarray) -> np.ndarray:
        return (self.held[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def key_places(keys: list[str], bits: int) -> np.ndarray:
    """(keys, PROBES): the bits of each key of at most KEY characters."""
    lengths = np.array([len(k) for k in keys], np.int64)
    starts, hashes = np.cumsum(lengths) - lengths, np.zeros(len(keys), np.uint64)
    for k, made in rolled("".join(keys), KEY):
        own = lengths == k
        hashes[own] = made[starts[own]]
    mixed = _mixed(hashes)
    return np.stack([(mixed * factor >> np.uint64(64 - bits)).astype(np.int64) for factor in PROBES], axis=1)


def key_ends(keys: list[str]) -> np.ndarray:
    """(keys, 2): numbers of the first and last END characters of each key, of shorter ones of nothing."""
    made = np.zeros((len(keys), 2), np.int64)
    long = np.array([k for k, key in enumerate(keys) if len(key) >= END], np.int64)
    for side, cut in enumerate((slice(None, END), slice(-END, None))):
        grams = [hashes for _, hashes in rolled("".join(keys[k][cut] for k in long), END)][-1][::END] if len(long) else np.zeros(0, np.uint64)
        made[long, side] = _buckets(grams)
        made[:, side] += side << END_BITS
    return made


def keyed_strings(strings: DataFrame) -> tuple[DataFrame, Broadcast]:
    """A table (string, ...) of distinct strings, stored with their keys, and the sieve of all keys; empty strings left out."""
    spark = strings.sparkSession
    ship_package(spark)
    table = stored(strings.filter(F.length("string") > 0).withColumn("key", F.substring("string", 1, KEY)), "strings")
    size = table.agg(F.count("*").alias("n"), F.max(F.length("string")).alias("longest"),
                     F.collect_set(F.length("key")).alias("sizes")).first()  # at most KEY sizes
    bits = min(max((KEY_BITS * size["n"]).bit_length(), PAGE_BITS), MOST_BITS)

    def lists(made: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1]).cast(pa.list_(pa.int64()))

    @in_project("array<bigint>")
    def places(keys: pa.Array) -> pa.Array:
        return lists(key_places(keys.to_pylist(), bits))

    @in_project("array<bigint>")
    def ends(keys: pa.Array) -> pa.Array:
        return lists(key_ends(keys.to_pylist()))

    spots = item_rows(table, [], places(F.col("key")), "spot")
    pages = spots.groupBy(F.shiftright("spot", PAGE_BITS).alias("page")).agg(
        F.bitmap_construct_agg(F.col("spot").bitwiseAND(F.lit((1 << PAGE_BITS) - 1))).alias("set")).collect()  # 32 MB at most
    held = np.zeros(1 << bits - 3, np.uint8)
    for page in pages:
        at = page["page"] << PAGE_BITS - 3
        held[at:at + (1 << PAGE_BITS - 3)] = np.frombuffer(page["set"], np.uint8)
    masks = np.zeros(2 << END_BITS, np.uint32)
    known = item_rows(table, [F.length("key").alias("size")], ends(F.col("key")), "end").groupBy("end").agg(
        F.bit_or(F.expr("shiftleft(1, size)")).alias("mask")).collect()  # 2 ** (END_BITS + 1) rows at most
    for row in known:
        masks[row["end"]] = row["mask"]
    return table, spark.sparkContext.broadcast(KeySieve(bits, held, masks.reshape(2, -1), sorted(size["sizes"]), size["longest"] or 0))


def held_pairs(df: DataFrame, keyed: tuple[DataFrame, Broadcast], id_col: str, texts: Column, besides: Column | None = None) -> DataFrame:
    """(id, string, ...): the strings of a keyed table that the texts (an array) of a row hold, once a row.

    Texts are sieved where they lie and only windows that pass travel, with the row's id, to the strings of that key.
    Strings that the text `besides` holds as well may be left out.
    """
    table, sieve = keyed
    return _met(_windows(df, sieve, id_col, texts, besides), table, id_col)


def held_apart(df: DataFrame, keyed: tuple[DataFrame, Broadcast], id_col: str, text_col: str, columns: list[str],
               order: list[Column | str], limit: int) -> tuple[Broadcast | None, DataFrame, DataFrame]:
    """The strings of the most frequent keys as an index within `limit`, the table of the others, and (id, string, ...)
    of those others that each text holds.

    The index is None if no string fits. Which strings it takes changes what travels and nothing else.
    """
    table, sieve = keyed
    found = _windows(df, sieve, id_col, F.array(text_col))
    if limit <= 0:
        return None, table, _met(found, table, id_col)
    # keys of about the same frequency go together: some hundred steps for any table
    counts = found.groupBy("key").agg(F.count("*").alias("n"))
    used = stored(table.join(counts, "key").withColumn("step", F.floor(F.log2("n") * 8).cast("int")).drop("n"), "used-strings")
    size = F.sum(F.octet_length(F.to_json(F.struct(*columns))))
    least, taken = None, 0
    for row in used.groupBy("step").agg(size.alias("size")).orderBy(F.desc("step")).collect():
        taken += row["size"]
        if taken > limit:
            break
        least = row["step"]
    if least is None:
        return None, table, _met(found, table, id_col)
    frequent = used.filter(F.col("step") >= least)
    keys = F.broadcast(frequent.select("key").distinct())  # no longer than the index
    rest = stored(table.join(keys, "key", "left_anti"), "other-strings")
    return _index_of(frequent, columns, order), rest, _met(found.join(keys, "key", "left_anti"), rest, id_col)


def _windows(df: DataFrame, sieve: Broadcast, id_col: str, texts: Column, besides: Column | None = None) -> DataFrame:
    """(id, key, rests) of the windows that pass the sieve, stored; none that the text `besides` holds with all that follows."""
    rows = df.select(id_col, texts.alias("_texts"), (F.lit(None).cast("string") if besides is None else besides).alias("_besides"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, key string, rests array<string>"

    apart = besides is not None  # a function for the executors holds no Column

    def new(own: dict[str, list[str]], text: str) -> dict[str, list[str]]:
        kept = {key: [rest for rest in rests if key + rest not in text] for key, rests in own.items() if rests or key not in text}
        return {key: rests for key, rests in kept.items() if rests or not own[key]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, some, size = [], [], 0
            for k, item in enumerate(batch.column(1)):
                own = [t for t in item.as_py() or [] if t]
                if own:
                    places.append(k)
                    some.append(own)
                    size += sum(map(len, own))
                if places and (size >= SLICE_BYTES or k + 1 == batch.num_rows):
                    found = sieve.value.windows(some)
                    if apart:
                        found = [new(own, batch.column(2)[p].as_py() or "") for p, own in zip(places, found, strict=True)]
                    ids = batch.column(0).take(pa.array([p for p, own in zip(places, found, strict=True) for _ in own], pa.int64()))
                    keys = pa.array([key for own in found for key in own], pa.string())
                    rests = pa.array([rest or None for own in found for rest in own.values()], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([ids, keys, rests], [id_col, "key", "rests"])
                    places, some, size = [], [], 0

    return stored(rows.mapInArrow(run, schema), "windows")


def _met(found: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """(id, string, ...) of the strings of a keyed table that stand in stored windows."""
    counts = found.groupBy("key").agg(F.count("*").alias("n"))
    frequent = counts.filter(F.col("n") * 1000 >= F.lit(found.count())).select("key", F.lit(True).alias("frequent"))  # 1000 at most
    dealt = F.col("frequent").isNotNull()
    left = found.join(F.broadcast(frequent), "key", "left").withColumn(
        "part", F.when(dealt, F.pmod(F.xxhash64(id_col), F.lit(PARTS)).cast("int")).otherwise(0)).drop("frequent")
    right = table.join(F.broadcast(frequent), "key", "left").withColumn(
        "part", F.explode(F.when(dealt, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))).drop("frequent")
    tail = F.substring("string", KEY + 1, 1 << 30)
    held = (F.length("string") <= KEY) | F.exists("rests", lambda rest: F.startswith(rest, tail))
    return left.join(right, ["key", "part"]).filter(held).select(id_col, *[c for c in table.columns if c != "key"])


def with_held_strings(df: DataFrame, strings: DataFrame, id_col: str = "id", text_col: str = "text", out: str = "held",
                      limit: int = INDEX_BYTES) -> DataFrame:
    """Add the distinct strings of a table (string) that a text holds, in order; no empty strings, none of a null text."""
    index = indexed(strings.filter(F.length("string") > 0).select("string").distinct(), ["string"], ["string"], limit)
    if index is not None:
        @in_project("array<string>")
        def found(texts: pa.Array) -> pa.Array:
            own = index.value[0]
            return by_slices(lambda some: pa.array(
                [[own.strings[k] for k in own.held(t)] if t else [] for t in some.to_pylist()], pa.list_(pa.string())), texts)

        return df.withColumn(out, found(F.col(text_col)))
    near = _by_keys(df, strings, id_col, text_col).groupBy(id_col).agg(F.collect_set("string").alias("_near"))
    held = F.array_sort(F.filter("_near", lambda s: F.contains(F.col(text_col), s)))
    return df.join(near, id_col, "left").withColumn(out, F.coalesce(held, F.expr("CAST(array() AS array<string>)"))).drop("_near")


def _by_keys(df: DataFrame, strings: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return held_pairs(df, keyed_strings(strings.select("string").distinct()), id_col, F.array(text_col))


def held_strings(df: DataFrame, strings: DataFrame, id_col: str = "id", text_col: str = "text",
                 limit: int = INDEX_BYTES) -> DataFrame:
    """(id, string): the strings that each text holds, once a row of `df`."""
    if limit == 0:
        return _by_keys(df.filter(F.col(id_col).isNotNull()), strings, id_col, text_col)
    return item_rows(with_held_strings(df, strings, id_col, text_col, "_held", limit), [id_col], F.col("_held"), "string")
