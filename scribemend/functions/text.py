"""Column functions on text: tokens, offsets, rebuilding, edit distance."""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemend.session import ship_package

# Private-use working characters.
CUT, PART, SHIELD = "\ue050", "\ue051", "\ue052"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chained(df: DataFrame, text_col: str, steps: list[Callable[[Column], Column]], out: str = "_states") -> DataFrame:
    """Add ARRAY<STRING> of the text before and after every step.

    A step reads the column before it exactly once, so a filter that the optimiser pushes
    through all steps grows with their number and not with its power.
    """
    df = df.withColumn(out, F.array(text_col))
    for k, step in enumerate(steps):
        df = df.withColumn(f"{out}{k}", let(F.col(out if k == 0 else f"{out}{k - 1}"), _appended(step)))
    if not steps:
        return df
    return df.withColumn(out, F.col(f"{out}{len(steps) - 1}")).drop(*[f"{out}{k}" for k in range(len(steps))])


def _appended(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda states: F.concat(states, F.array(let(F.element_at(states, -1), lambda text: step(text))))


def in_project(kind: str) -> Callable[[Callable[..., pa.Array]], Callable[..., Column]]:
    """An Arrow function that stays a column of its own: Spark cannot evaluate one that is inlined into a lambda."""
    return lambda function: F.arrow_udf(function, kind).asNondeterministic()


def tokens(text: Column) -> Column:
    """Words and single punctuation marks; blank tokens never arise."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def running_starts(lengths: Column) -> Column:
    """Exclusive running sum of an int array, in blocks of about sqrt(n).

    Blocks keep the array copies of the fold at n * sqrt(n) instead of n * n.
    """

    def totals(items: Column) -> Column:
        return F.aggregate(items, F.array(F.lit(0)),
                           lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def build(items: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(items))).cast("int")
        last = F.ceil(F.size(items) / width).cast("int") - 1
        local = F.transform(F.sequence(F.lit(0), last),
                            lambda b: totals(F.slice(items, b * width + 1, width)))
        return let(local, lambda parts: F.flatten(F.zip_with(
            parts, F.slice(totals(F.transform(parts, lambda p: F.element_at(p, -1))), F.lit(1), F.size(parts)),
            lambda p, base: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda v: v + base))))

    empty = F.expr("CAST(array() AS array<int>)")
    return let(lengths, lambda items: F.when(F.size(items) > 0, build(items)).otherwise(empty))


def located_tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """ARRAY<STRUCT<token, start>>; starts are counted from 0 in characters."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                     gaps_between(text, pattern).alias("gaps"))

    def build(p: Column) -> Column:
        lengths = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["found"])), p["found"],
                             lambda g, t: F.length(g) + F.length(t))
        return F.zip_with(p["found"], F.zip_with(running_starts(lengths), p["gaps"],
                                                 lambda s, g: s + F.length(g)),
                          lambda t, s: F.struct(t.alias("token"), s.alias("start")))

    return let(parts, lambda p: F.filter(build(p), lambda x: x["token"].isNotNull()))


def contains_any(text: Column, words: list[str]) -> Column:
    """Cheap byte search, used to keep regular expressions away from texts they cannot match."""
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def gaps_between(text: Column, pattern: str) -> Column:
    """Text pieces around the matches of a pattern: one more than there are matches.

    Splitting at one character needs no pattern; the replacement compiles its own once.
    """
    cut = F.split(F.regexp_replace(text, pattern, CUT), CUT, -1)
    return F.when(F.contains(text, F.lit(CUT)), F.split(text, pattern, -1)).otherwise(cut)


def _shield(text: Column) -> Column:
    """Spell the working characters, should a text hold any, with others."""
    return F.when(text.rlike(f"[{CUT}{PART}{SHIELD}]"), F.regexp_replace(F.regexp_replace(F.regexp_replace(
        text, SHIELD, f"{SHIELD}\ue053"), CUT, f"{SHIELD}\ue054"), PART, f"{SHIELD}\ue055")).otherwise(text)


def _unshield(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(SHIELD)), F.regexp_replace(F.regexp_replace(F.regexp_replace(
        text, f"{SHIELD}\ue055", PART), f"{SHIELD}\ue054", CUT), f"{SHIELD}\ue053", SHIELD)).otherwise(text)


def rewrite_matches(text: Column, pattern: str, groups: int,
                    convert: Callable[[Column, list[Column]], Column],
                    needs: list[str] | None = None) -> Column:
    """Replace every match of a pattern by a Column computed from the match and its groups.

    One pass of the pattern frames every match with its groups; splitting at the frame
    gives text and matches in turn.  `needs` lists literal strings of which every match
    holds at least one.
    """
    payload = CUT + PART.join(f"${k}" for k in range(groups + 1)) + CUT

    def converted(piece: Column) -> Column:
        return let(F.split(piece, PART, -1), lambda g: convert(g[0], [g[k] for k in range(1, groups + 1)]))

    def build(framed: Column) -> Column:
        pieces = F.transform(F.split(framed, CUT, -1),
                             lambda piece, i: F.when(i % 2 == 1, converted(piece)).otherwise(piece))
        return F.array_join(pieces, "")

    framed = F.regexp_replace(_shield(text), pattern, payload)
    out = let(framed, lambda f: F.when(F.contains(f, F.lit(CUT)), let(build(f), _unshield)).otherwise(text))
    return F.when(contains_any(text, needs), out).otherwise(text) if needs else out


def item_rows(df: DataFrame, keep: list[str | Column], items: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per item of a computed array; arrays hold no nulls.

    A plain explode makes the optimiser test the array for null and size below it, which
    works a costly array out three times; the outer form does not.
    """
    made = F.posexplode_outer(items).alias(pos, name) if pos else F.explode_outer(items).alias(name)
    return df.select(*keep, made).filter(F.col(name).isNotNull())


def replace_first(text: Column, wrong: Column, right: Column) -> Column:
    """Replace the first occurrence only; text without it stays as it is."""
    at = F.position(wrong, text)
    return F.when(F.contains(text, wrong), F.concat(
        F.substring(text, F.lit(1), at - 1), right,
        F.substring(text, at + F.length(wrong), F.length(text)))).otherwise(text)


def occurrences(text: Column, word: Column) -> Column:
    """All start positions (from 0) of a word, overlapping ones included, in order."""
    pieces = F.split(text, F.concat(F.lit(r"(?=\Q"), word, F.lit(r"\E)")), -1)
    # every piece but the first starts at an occurrence; the first one starts with the text
    return F.filter(let(pieces, lambda ps: running_starts(F.transform(ps, F.length))),
                    lambda start: (start > 0) | F.startswith(text, word))


def strip(text: Column) -> Column:
    ends = text.rlike(r"(?U)^\s") | F.substring(text, -1, 1).rlike(r"(?U)\s")
    return F.when(ends, F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")).otherwise(text)


#: Longer texts than this are compared a word of bits at a time.
SHORT = 64


def bit_distance(a: str, b: str) -> int:
    """Edit distance by columns of bits (Myers, Hyyrö): the differences down a column are two numbers of len(a) bits."""
    ends = 0
    while ends < min(len(a), len(b)) and a[ends] == b[ends]:
        ends += 1
    a, b, ends = a[ends:], b[ends:], 0
    while ends < min(len(a), len(b)) and a[-1 - ends] == b[-1 - ends]:
        ends += 1
    a, b = a[:len(a) - ends], b[:len(b) - ends]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, char in enumerate(a):
        places.setdefault(char, bytearray(len(a) // 8 + 1))[k >> 3] |= 1 << (k & 7)
    places = {char: int.from_bytes(bits, "little") for char, bits in places.items()}
    top, full, distance = len(a) - 1, (1 << len(a)) - 1, len(a)
    up, down = full, 0
    for char in b:
        same = places.get(char, 0)
        level = (((same & up) + up) ^ up) | same
        right, left = down | (full & ~(level | up)), up & level
        distance += (right >> top) - (left >> top)
        right, left, same = (right << 1 | 1) & full, left << 1 & full, same | down
        up, down = left | (full & ~(same | right)), right & same
    return distance


def _same_upto(a: str, b: str, at: int, shift: int) -> int:
    """Where a, from a place on, and b, from a place `shift` further, first differ, as a place of a."""
    end, width = min(len(a), len(b) - shift), 16
    while at + width <= end and a[at:at + width] == b[at + shift:at + shift + width]:
        at, width = at + width, 2 * width
    while width > 1:
        width //= 2
        if at + width <= end and a[at:at + width] == b[at + shift:at + shift + width]:
            at += width
    return at


def near_distance(a: str, b: str, most: int) -> int | None:
    """Edit distance if it is at most `most`, else None: how far each number of edits gets on each diagonal (Ukkonen)."""
    size, other, middle = len(a), len(b), most + 2
    goal = middle + other - size
    if abs(other - size) > most:
        return None
    far = [-2] * (2 * middle + 1)
    far[middle] = _same_upto(a, b, 0, 0)
    for edits in range(most):
        if far[goal] >= size:
            return edits
        further = far[:]
        for k in range(middle - edits - 1, middle + edits + 2):
            at, add, put = far[k], far[k + 1], far[k - 1]
            at = 1 + (at if at > add else add)
            at = min(put if put > at else at, size, other - k + middle)
            to = at + k - middle
            if at >= 0 and to >= 0:
                further[k] = _same_upto(a, b, at, k - middle) if at < size and to < other and a[at] == b[to] else at
        far = further
    return most if far[goal] >= size else None


def text_distance(a: str, b: str) -> int:
    """Edit distance: by diagonals while that takes no longer than reading the texts, else by columns of bits."""
    near = near_distance(a, b, isqrt(min(len(a), len(b))))
    return bit_distance(a, b) if near is None else near


def edit_distance(a: Column, b: Column) -> Column:
    """Exact edit distance; not for use inside of a lambda, since texts over SHORT are compared by an Arrow function."""
    ship_package(SparkSession.active())

    @in_project("int")
    def by_bits(one: pa.Array, other: pa.Array) -> pa.Array:
        pairs = ((x.as_py(), y.as_py()) for x, y in zip(one, other, strict=True))  # a row at a time: texts may be long
        return pa.array([None if x is None else text_distance(x, y) for x, y in pairs], pa.int32())

    long = (a != b) & (F.greatest(F.length(a), F.length(b)) > SHORT)
    return F.when(a == b, 0).when(long, by_bits(F.when(long, a), F.when(long, b))).otherwise(F.levenshtein(a, b))


def character_error_rate(wrong: Column, right: Column) -> Column:
    """Edit distance over the longer length; 0 when both are empty."""
    longer = F.greatest(F.length(wrong), F.length(right))
    return F.when(longer == 0, F.lit(0.0)).otherwise(edit_distance(wrong, right) / longer)


def numbers(text: Column) -> Column:
    """Sorted distinct digit runs."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0))))
