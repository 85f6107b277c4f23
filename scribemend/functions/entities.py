"""Protected entities of a text: train, switch, track, kilometre post, speed, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scribemend.functions.text import gaps_between, let, running_starts

# Pattern of each kind and of its value.
ENTITY_PATTERNS = {
    "train": (r"(?U)[GDKTZC]\d+次", r"(?U)[GDKTZC](\d+)次"),
    "switch": (r"(?U)\d+号道岔", r"(?U)(\d+)号道岔"),
    "track": (r"(?U)\d+道(?![岔路])", r"(?U)(\d+)道"),
    "kilometer": (r"(?U)[Kk]\d+\+\d{3}", r"(?U)[Kk](\d+)\+(\d{3})"),
    "speed": (r"(?U)限速\d+km/h", r"(?U)限速(\d+)km/h"),
    "time": (r"(?U)\d+[点时:：]\d+(?:分)?", r"(?U)(\d+[点时:：]\d+)"),
}


def entity_value(kind: str, text: Column) -> Column:
    """Joined groups of the value pattern of a kind, else the whole text."""
    pattern = ENTITY_PATTERNS[kind][1]
    groups = pattern.count("(") - pattern.count("(?")
    value = F.concat(*[F.regexp_extract(text, pattern, k) for k in range(1, groups + 1)])
    return F.when(value != "", value).otherwise(text)


def entities(text: Column) -> Column:
    """ARRAY<STRUCT<type, text, value, start, end>>, kind after kind in the order of the table."""

    def of_kind(kind: str, pattern: str) -> Column:
        parts = F.struct(gaps_between(text, pattern).alias("gaps"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

        def build(p: Column) -> Column:
            lengths = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["found"])), p["found"],
                                 lambda g, m: F.length(g) + F.length(m))
            ends = F.zip_with(running_starts(lengths), lengths, lambda s, n: s + n)
            return F.zip_with(p["found"], ends, lambda m, e: F.struct(
                F.lit(kind).alias("type"), m.alias("text"), entity_value(kind, m).alias("value"),
                (e - F.length(m)).alias("start"), e.alias("end")))

        none = F.expr("CAST(array() AS array<struct<type:string,text:string,value:string,start:int,end:int>>)")
        return F.when(text.rlike(pattern), let(parts, build)).otherwise(none)

    return F.concat(*[of_kind(kind, pattern) for kind, (pattern, _) in ENTITY_PATTERNS.items()])


def entity_keys(text: Column) -> Column:
    """Distinct kind:value keys of a text."""
    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                           lambda m: F.concat(F.lit(kind + ":"), entity_value(kind, m)))

    return F.array_distinct(F.concat(*[of_kind(k, p) for k, (p, _) in ENTITY_PATTERNS.items()]))
