"""Repair of conversations by a rank-convergence parallel Viterbi search.

The rows of a conversation are to become  s?(ua)+  (system, user, assistant), or nothing, by the cheapest edits: Keep,
Rerole, Delete and Insert.  Costs to the end of the conversation are worked out from its end, as vectors over the four
states of that pattern.  Every CHUNK rows in a row are a chunk that starts from a speculative vector.  Fix-up passes
then run chunks again whose right neighbour came out with another vector, until all differ by constants only; the pass
p runs spans of FAN^p chunks one after the other in one task, so that it ends after log(chunks) passes whatever the
rows.  The stitched vectors lead a trace from the first row on, which takes the ASCII-least letter of all cheapest ones.

Rows are placed by one sort by range, which a long conversation crosses freely; chunks meet their neighbours by joins
on their numbers.  The contract hashes a whole conversation's repaired lines: for that its rows stream through one task
in order, a batch at a time, and that task also traces; it holds one chunk and the audit letters.

Nulls in role and text (and in the key of the damage) count as one space, null turns come first, null conv_ids are one
conversation. Rows of one turn are ordered by role and the MD5 of the text; equal rows are duplicates of the first.
A conversation without rows has zeros, an empty audit and the digest of empty text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribemend.llm.common import attach, ship_package, stored

CHUNK_BITS = 6
FAN_BITS = 4
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: States: nothing yet, after system, after user, after assistant; an inserted or reroled turn leads from one to the next.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
SPOKEN = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
Vector = list[int]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32(conv_id:turn) % 20 chooses."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = (F.crc32(key.cast("binary")) % 20).alias("fate")
    given = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), fate).filter("fate <> 0")
    text = (F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (given.withColumn("copy", copies)
            .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def name_of(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


def placed(rows: DataFrame) -> DataFrame:
    """The rows with `name` and a dense `place` in the order of conversation and turn; stored."""
    order = ["conv_id", "turn", "role", "mark", "row"]
    keyed = rows.withColumn("name", name_of(F.col("conv_id"))).withColumn("mark", F.md5("text"))
    # equal rows need no order, the row number lets a range of them be split
    keyed = keyed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(keyed.select("name", "turn", "role", "text", F.monotonically_increasing_id().alias("id")), "turns")
    part = F.shiftright("id", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0).cast("long")).alias("start"))
    dense = kept.withColumn("part", part).join(F.broadcast(starts), "part")
    return dense.select("name", "turn", "role", "text", (F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def kinds(rows: DataFrame) -> DataFrame:
    """(name, place, kind): the role's initial (x for others), upper case if truncated; b for blank, d for duplicate."""
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    kind = F.when(said == "", "b").when(F.substring(said, -1, 1).isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    narrow = stored(rows.select("name", "place", kind.alias("kind"), mark.alias("mark")), "kinds")
    first = narrow.filter("kind <> 'b'").groupBy("name", "mark").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    known = attach(narrow, stored(first.filter("n > 1"), "repeats"), ["name", "mark"], "n", F.col("place"))
    again = (F.col("kind") != "b") & (F.col("place") > F.col("first"))
    return known.select("name", "place", F.when(again, "d").otherwise(F.col("kind")).alias("kind"))


def closed(vector: Vector) -> Vector:
    """Cheapest with inserts before: one leads to user or assistant, two from system or nothing to assistant."""
    user = min(vector[USER], INSERT + vector[ASSISTANT])
    return [min(vector[NOTHING], INSERT + user), min(vector[SYSTEM], INSERT + user), user, min(vector[ASSISTANT], INSERT + user)]


END = closed([0, FAR, FAR, 0])


def stay_costs(kind: str, after: Vector) -> list[tuple[int, int]]:
    """For each state, the cost of keeping the row and of giving it the role that is due, up to the end."""
    cut = CUT if kind.isupper() else 0
    initial = kind.lower()
    out = []
    for state in range(4):
        due = NEXT[state]
        keep = cut + after[due] if initial == ("u" if due == USER else "a") else FAR
        if state == NOTHING and initial == "s":
            keep = cut + after[SYSTEM]
        out.append((keep, cut + REROLE + after[due]))
    return out


def back(kind: str, after: Vector) -> Vector:
    """The vector before a row from the one after it."""
    if kind in "bd":
        return [DELETE + cost for cost in after]  # closed already
    return closed([min(DELETE + after[state], *costs) for state, costs in enumerate(stay_costs(kind, after))])


def vectors(row_kinds: str, right: Vector) -> list[Vector]:
    out = [list(right)]
    for kind in reversed(row_kinds):
        out.append(back(kind, out[-1]))
    return out[::-1]


def level(vector: Vector) -> Vector:
    """Vectors that differ by a constant only are equal after this."""
    return [cost - vector[0] for cost in vector]


def trace(row_kinds: str, right: Vector, state: int) -> tuple[list[tuple[str, list[int]]], int]:
    """For each row its letters (inserts before it, then its own) and the states after them; and the last state."""
    costs, out = vectors(row_kinds, right), []
    for at, kind in enumerate(row_kinds):
        letters, states = "", []
        while True:
            now, after = costs[at], costs[at + 1]
            keep, rerole = (FAR, FAR) if kind in "bd" else stay_costs(kind, after)[state]
            if DELETE + after[state] == now[state]:
                letters += "D"
            elif INSERT + now[NEXT[state]] == now[state]:
                letters, state = letters + "I", NEXT[state]
                states.append(state)
                continue
            elif keep == now[state]:
                letters, state = letters + "K", SYSTEM if kind.lower() == "s" else NEXT[state]
            else:
                assert rerole == now[state]
                letters, state = letters + "R", NEXT[state]
            states.append(state)
            break
        out.append((letters, states))
    return out, state


def chunks_of(row_kinds: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(name, chunk, kinds): the kinds of up to 2^chunk_bits rows in a row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"])
    return row_kinds.groupBy("name", F.shiftright("place", chunk_bits).alias("chunk")).agg(F.array_join(ordered, "").alias("kinds"))


def _passed(frames: Iterator[pd.DataFrame], spec: Vector) -> Iterator[pd.DataFrame]:
    """Runs chunks, which come span by span from right to left, whose right vector is missing or not the coming one."""
    key, carry = None, None
    for frame in frames:
        rights, lefts, runs = [], [], []
        for name, span, row_kinds, right, left, coming in zip(
                frame["name"], frame["span"], frame["kinds"], frame["right"], frame["left"], frame["coming"], strict=True):
            new = key != (name, span)
            want = coming if new else carry
            key = (name, span)
            want = spec if want is None else [int(x) for x in want]
            run = right is None or want != [int(x) for x in right]
            if run:
                right, left = want, level(vectors(row_kinds, want)[0])
            carry = [int(x) for x in left]
            rights.append([int(x) for x in right])
            lefts.append(carry)
            runs.append(run)
        yield pd.DataFrame({"name": frame["name"], "chunk": frame["chunk"], "kinds": frame["kinds"], "right": rights, "left": lefts, "run": runs})


def converged(chunks: DataFrame, fan_bits: int = FAN_BITS) -> tuple[DataFrame, list[int]]:
    """(name, chunk, kinds, right): chunks with the vector at their right end, up to a constant; chunks run in each pass."""
    kept = "name string, chunk long, kinds string, right array<long>, left array<long>, run boolean"
    chunks = stored(chunks, "chunks")
    no_vector = F.lit(None).cast("array<long>")

    def passed(open_chunks: DataFrame, number: int) -> DataFrame:
        spans = open_chunks.withColumn("span", F.shiftright("chunk", fan_bits * number)).repartition("name", "span")
        return stored(spans.sortWithinPartitions("name", "span", F.desc("chunk")).mapInPandas(lambda fs: _passed(fs, END), kept), "pass")

    last = chunks.select("name", (F.col("chunk") - 1).alias("chunk"), F.lit(True).alias("more"))
    first = chunks.join(last, ["name", "chunk"], "left").withColumn("coming", F.when(
        F.col("more"), no_vector).otherwise(F.array(*[F.lit(x).cast("long") for x in level(END)])))
    # every chunk is a span of its own: those with a neighbour start from a speculative vector
    now = passed(first.select("name", "chunk", "kinds", no_vector.alias("right"), no_vector.alias("left"), "coming"), 0)
    ran, number = [now.count()], 0
    while True:
        coming = now.select("name", (F.col("chunk") - 1).alias("chunk"), F.col("left").alias("coming"))
        met = now.drop("run").join(coming, ["name", "chunk"], "left").withColumn("coming", F.coalesce("coming", "right"))
        if met.filter("right <> coming").isEmpty():
            return now.select("name", "chunk", "kinds", "right"), ran
        number += 1
        now = passed(met, number)
        ran.append(now.filter("run").count())


@dataclass
class Told:
    """What is known of a conversation after some of its rows, taken in order."""

    state: int = NOTHING
    turn: int | None = None
    first_turn: int | None = None
    turns: int = 0
    initial: str | None = None
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0))
    audit: list[str] = field(default_factory=list)
    digest: object = field(default_factory=hashlib.sha256)
    said: bool = False

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.said else "") + role + ":" + text).encode())
        self.said = True

    def add(self, kind: str, turn: int | None, role: str, text: str, letters: str, states: list[int]) -> None:
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        fault = {"b": "blank", "d": "duplicate"}.get(kind, "truncated" if kind.isupper() else None)
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial
        for letter, state in zip(letters[:-1], states, strict=False):
            self.insert(letter, state)
        own = letters[-1]
        self.audit.append(own)
        self.counts["cost"] += {"D": DELETE, "R": REROLE, "K": 0}[own] + (CUT if kind.isupper() and own != "D" else 0)
        if own != "D":
            self.line(SPOKEN[states[-1]] if own == "R" else role, text)

    def insert(self, letter: str, state: int) -> None:
        self.audit.append(letter)
        self.counts["cost"] += INSERT
        self.line(SPOKEN[state], "")

    def end(self, name: str) -> dict:
        while self.state in (SYSTEM, USER):
            self.state = NEXT[self.state]
            self.insert("I", self.state)
        gaps = 0 if self.first_turn is None else self.turn - self.first_turn + 1 - self.turns
        return {"name": name, "gaps": gaps, **self.counts, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation from its chunks and rows in order; each chunk comes before its rows."""
    name, told, row_kinds, letters = None, None, "", iter(())
    for frame in frames:
        out = []
        for own, place, head, right, turn, role, text in zip(
                frame["name"], frame["place"], frame["kinds"], frame["right"], frame["turn"], frame["role"], frame["text"], strict=True):
            if own != name:
                if told:
                    out.append(told.end(name))
                name, told = own, Told()
            if place < 0:
                found, told.state = trace(head, [int(x) for x in right], told.state)
                letters = iter(list(zip(head, found, strict=True)))
            else:
                kind, (edits, states) = next(letters)
                told.add(kind, int(turn) if turn else None, role, text, edits, states)
        if out:
            yield pd.DataFrame(out)
    if told:
        yield pd.DataFrame([told.end(name)])


def repaired(rows: DataFrame, every: DataFrame, chunk_bits: int = CHUNK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row for each conv_id of `every`: faults, costs, edits and digest of the conversations in `rows`."""
    ship_package(rows.sparkSession)
    turns = placed(rows)
    chunks, _ = converged(chunks_of(kinds(turns), chunk_bits), fan_bits)
    nothing = F.lit(None).cast("string")
    heads = chunks.select("name", "chunk", F.lit(-1).cast("long").alias("place"), "kinds", "right", nothing.alias("turn"),
                          nothing.alias("role"), nothing.alias("text"))
    # a turn travels as text: pandas turns numbers beside nulls into floats
    lines = turns.select("name", F.shiftright("place", chunk_bits).alias("chunk"), "place", nothing.alias("kinds"),
                         F.lit(None).cast("array<long>").alias("right"), F.col("turn").cast("string").alias("turn"), "role", "text")
    streams = heads.unionByName(lines).repartition("name").sortWithinPartitions("name", "chunk", "place")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = streams.mapInPandas(_told, "name string, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")
    names = every.select("conv_id").distinct().withColumn("name", name_of(F.col("conv_id")))
    return names.join(found, "name", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    return repaired(damaged(rows), rows)
