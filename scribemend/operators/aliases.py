"""Alias matching, greedy resolution and rewriting of texts by an alias lexicon.

A lexicon is a table (alias, canonical, lex_order).  Greedy resolution takes the longest alias first, then lexicon
order, then position, without overlaps; an alias of one character counts only as a word of its own.  The lexicon is
a broadcast index that reads a text once: no shuffle, the same on streams, and the time hardly
goes with the number of aliases.  A lexicon over the bound of an index goes through a join that finds the aliases each
text can hold; both give the same rows.  A null text stays null and has no spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribemend.functions.text import item_rows
from scribemend.operators.lookup import INDEX_BYTES, StringIndex, by_slices, held_apart, in_project, indexed, keyed_strings
from scribemend.session import ship_package, stored

ENTRY = "struct<alias:string,canonical:string,lex_order:bigint>"
SPAN = "struct<pos:int,alias:string,canonical:string,lex_order:bigint>"
RESOLVED = f"struct<text:string,spans:array<{SPAN}>>"


def usable(lexicon: DataFrame) -> DataFrame:
    """Without empty and identity aliases; one row per alias, the last one wins (of equals the greatest canonical)."""
    w = W.partitionBy("alias").orderBy(F.desc("lex_order"), F.desc("canonical"))
    return (lexicon.filter((F.length("alias") > 0) & (F.col("alias") != F.col("canonical")))
            .withColumn("_n", F.row_number().over(w)).filter("_n = 1")
            .select("alias", "canonical", F.col("lex_order").cast("long").alias("lex_order")))


def _rules(lexicon: DataFrame) -> DataFrame:
    """The usable rows, stored."""
    return stored(usable(lexicon), "rules")


def _index(rules: DataFrame, limit: int):
    """Longest alias first, then lexicon order."""
    return indexed(rules, ["alias", "canonical", "lex_order"], [F.desc(F.length("alias")), "lex_order", "alias"], limit, known=True)


@lru_cache(maxsize=4096)
def _is_word(char: str) -> bool:
    return char == "_" or unicodedata.category(char)[0] in "LN"


def kept_hits(text: str, index: StringIndex) -> list[tuple[int, int]]:
    """(place, rank) of the aliases that stay, in text order; ranks go by falling length."""
    wide, found = len(text) + 1, []
    for at, rank in index.hits(text):
        if len(index.strings[rank]) == 1 and (at > 0 and _is_word(text[at - 1]) or at + 1 < len(text) and _is_word(text[at + 1])):
            continue
        found.append(rank * wide + at)
    found.sort()
    covered, kept = bytearray(len(text)), []
    for number in found:
        rank, at = divmod(number, wide)
        size = len(index.strings[rank])
        # what is covered already is no shorter: it holds one of the ends, if anything
        if not (covered[at] or covered[at + size - 1]):
            covered[at:at + size] = b"\x01" * size
            kept.append((at, rank))
    kept.sort()
    return kept


def _spans(places: list[list[tuple[int, int]]], index: StringIndex, canonical: list[str], order: list[int]) -> pa.Array:
    """ARRAY<STRUCT<pos, ...>> of (place, rank) lists."""
    offsets = [0]
    for found in places:
        offsets.append(offsets[-1] + len(found))
    at = pa.array([p for found in places for p, _ in found], pa.int32())
    ranks = [r for found in places for _, r in found]
    columns = [pa.array([held[r] for r in ranks], kind) for held, kind in (
        (index.strings, pa.string()), (canonical, pa.string()), (order, pa.int64()))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [at, *columns], ["pos", "alias", "canonical", "lex_order"]))


def _rewritten(text: str, kept: list[tuple[int, int]], strings: list[str], canonical: list[str]) -> str:
    pieces, end = [], 0
    for at, rank in kept:
        pieces += [text[end:at], canonical[rank] or ""]
        end = at + len(strings[rank])
    return "".join(pieces) + text[end:]


def _resolved(texts: list[str | None], lexicons) -> pa.Array:
    """STRUCT<text, spans> of texts, each with its (index, canonical, lex_order)."""
    out, places, parts, last = [], [], [], None

    def close() -> None:
        if last is not None:
            parts.append(_spans(places, *last))
            places.clear()

    for text, lexicon in zip(texts, lexicons, strict=True):
        if lexicon is not last:
            close()
            last = lexicon
        index, canonical, _ = lexicon
        kept = kept_hits(text, index) if text else []
        places.append(kept)
        out.append(_rewritten(text, kept, index.strings, canonical) if kept else text)
    close()
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("alias", pa.string()), ("canonical", pa.string()), ("lex_order", pa.int64())]))
    spans = pa.concat_arrays(parts) if parts else pa.array([], kind)
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), spans], ["text", "spans"])


def resolver(lexicon: DataFrame, limit: int = INDEX_BYTES) -> Callable[[Column], Column] | None:
    """Column function text -> STRUCT<text, spans> with no shuffle, also for streams; None over the bound of an index."""
    return _resolver(_index(_rules(lexicon), limit))


def _resolver(shared: Broadcast | None) -> Callable[[Column], Column] | None:
    if shared is None:
        return None

    @in_project(RESOLVED)
    def resolve(texts: pa.Array) -> pa.Array:
        return by_slices(lambda some: _resolved(some.to_pylist(), [shared.value] * len(some)), texts)

    return resolve


def _with_entries(df: DataFrame, rules: DataFrame, id_col: str, text_col: str, limit: int) -> tuple[DataFrame, Broadcast | None]:
    """`df` with _entries: for each text the aliases that it can hold, longest first, but for those of the index that comes along.

    Rows without id have none and take no part.
    """
    shared, _, held = held_apart(df, keyed_strings(rules.withColumnRenamed("alias", "string")), id_col, text_col,
                                 ["string", "canonical", "lex_order"], [F.desc(F.length("string")), "lex_order", "string"], limit)
    entry = F.struct((-F.length("string")).alias("size"), "lex_order", F.col("string").alias("alias"), "canonical")
    found = held.groupBy(id_col).agg(F.array_sort(F.collect_set(entry)).alias("_found"))
    held = F.transform(F.filter("_found", lambda e: F.contains(F.col(text_col), e["alias"])), lambda e: F.struct(
        e["alias"].alias("alias"), e["canonical"].alias("canonical"), e["lex_order"].alias("lex_order")))
    none = F.expr(f"CAST(array() AS array<{ENTRY}>)")
    entries = F.when(F.col(id_col).isNotNull(), F.coalesce(held, none))
    return df.join(found, id_col, "left").withColumn("_entries", entries).drop("_found"), shared


def _own_lexicons(texts: list[str | None], entries: pa.Array, shared: Broadcast | None) -> Iterator[tuple[StringIndex, list[str], list[int]]]:
    """One at a time: an automaton takes far more than its strings. A text that has entries adds what it holds of the index."""
    for text, item in zip(texts, entries, strict=True):
        own = item.as_py()
        if own == [] and shared is not None:
            yield shared.value
            continue
        own = [(e["alias"], e["canonical"], e["lex_order"]) for e in own or []]
        if own and shared is not None:
            index, canonical, order = shared.value
            own += [(index.strings[r], canonical[r], order[r]) for r in index.held(text)]
            own.sort(key=lambda e: (-len(e[0]), e[2] is not None, e[2], e[0]))
        yield StringIndex([e[0] for e in own]), [e[1] for e in own], [e[2] for e in own]


def resolve_aliases(df: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text",
                    limit: int = INDEX_BYTES) -> DataFrame:
    """Add `resolved` STRUCT<text, spans> to every text."""
    rules = _rules(lexicon)
    resolve = _resolver(_index(rules, limit))
    if resolve is not None:
        return df.withColumn("resolved", resolve(F.col(text_col)))
    ship_package(df.sparkSession)
    joined, shared = _with_entries(df, rules, id_col, text_col, limit)

    @in_project(RESOLVED)
    def by_entries(texts: pa.Array, entries: pa.Array) -> pa.Array:
        def done(some: pa.Array, own: pa.Array) -> pa.Array:
            rows = some.to_pylist()
            return _resolved(rows, _own_lexicons(rows, own, shared))

        return by_slices(done, texts, entries)

    return joined.withColumn("resolved", by_entries(F.col(text_col), F.col("_entries"))).drop("_entries")


def alias_occurrences(df: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text",
                      limit: int = INDEX_BYTES) -> DataFrame:
    """Every occurrence of every alias, overlapping ones included: (id, alias, canonical, lex_order, pos)."""
    rules = _rules(lexicon)
    whole = _index(rules, limit)
    if whole is not None:
        @in_project(f"array<{SPAN}>")
        def found(texts: pa.Array) -> pa.Array:
            index = whole.value[0]
            return by_slices(lambda some: _spans([list(index.hits(t)) if t else [] for t in some.to_pylist()], *whole.value), texts)

        spans = found(F.col(text_col))
    else:
        ship_package(df.sparkSession)
        df, shared = _with_entries(df, rules, id_col, text_col, limit)

        @in_project(f"array<{SPAN}>")
        def found_by_entries(texts: pa.Array, entries: pa.Array) -> pa.Array:
            rows = texts.to_pylist()
            parts = [_spans([list(own[0].hits(t)) if t else []], *own)
                     for t, own in zip(rows, _own_lexicons(rows, entries, shared), strict=True)]
            return pa.concat_arrays(parts)

        spans = found_by_entries(F.col(text_col), F.col("_entries"))
    return item_rows(df.withColumn("_spans", spans), [id_col], F.col("_spans"), "_s").select(id_col, "_s.alias", "_s.canonical", "_s.lex_order", "_s.pos")


def kept_spans(df: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Greedy non-overlapping spans: (id, pos, alias, canonical, lex_order)."""
    resolved = resolve_aliases(df, lexicon, id_col, text_col)
    return item_rows(resolved, [id_col], F.col("resolved.spans"), "_s").select(id_col, "_s.*")


def span_changes(spans: Column) -> Column:
    """Kept spans as change records."""
    return F.transform(spans, lambda s: F.struct(
        F.lit("dictionary").alias("layer"), F.lit("alias_replace").alias("type"),
        s["alias"].alias("before"), s["canonical"].alias("after"),
        F.lit(None).cast("string").alias("reason"), s["pos"].cast("int").alias("pos")))
