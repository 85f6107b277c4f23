"""Personal data: fixed rules give seed entities, their contexts lead to identifiers that no rule knows.

The base spans are found by rules (email, ip, card, phone) in one pass over whole texts, in time linear in the
text.  Values that are assigned to the name of a credential are seeds of a fifth kind, secret.  The same pass notes
candidates that no seed touches: tokens with four digits or more, or with an @, and the beginning of a run of numbers
that is a phone number with something behind it.  Each mention has lexical patterns: the word before it, the two words
before, the word after, the words on both sides, and the shape of the value (digits as 9, letters as a).

Spark scores the graph of patterns and instances.  A pattern belongs to the kind of most of its seeds, of which SUPPORT
have to differ; its score is the share of its mentions that are believed.  Seeds are believed fully in patterns of
their kind and not at all in others; a candidate as far as its best pattern of another view (left, right, both sides,
shape), so that no pattern confirms itself; what fails the check of a rule (card numbers, parts of an ip) is never
believed to be of its kind.  After ROUNDS rounds a pattern with the score CONFIDENT, at least half of whose mentions are
seeds, is believed; one of a single word only if SELECTIVE of all places of that word in the texts are mentions.  A
candidate becomes a span of the kind of its best believed pattern, of equals of the first kind.

Null and empty texts have no spans.  Rows that repeat a doc_id are kept apart.  Offsets are code points.  Words and
values of any length count whole: beyond SHORT characters their digest stands for them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribemend.llm.common import as_text, attach, keyed_as, matching, ship_package, stored

# The kinds in their order, the characters and patterns of the rules.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

CREDENTIAL = re.compile(r"(?<![a-z])(?:password|passwd|secret|token|(?:api|access|private)[ _-]?key)[\"']?\s*[:=]\s*[\"']?"
                        r"([a-z0-9+/_.=-]{12,})", re.IGNORECASE)
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")

DIGIT, LETTER, TOKEN, WORD = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+"), re.compile(r"\S+"), re.compile(r"\w+")
HEX, NUMBER, QUAD = re.compile(r"[0-9a-fA-F]{16,}"), re.compile(r"[0-9](?:-?[0-9]){13,18}"), re.compile(r"[0-9]+(?:\.[0-9]+){3}")
RIM = "!?,;:\"'()[]{}<>|*#%&$."
#: Views of a mention by the first letter of a pattern, and those that say something new to each of them.
VIEWS = {"l": "rs", "r": "ls", "b": "s", "s": "lrb"}
SUPPORT, CONFIDENT, SELECTIVE, ROUNDS, SHORT = 3, 0.8, 0.2, 3, 64


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match around an @ begins where the run of local characters begins, or the match before ends."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def digits_in(text: str) -> int:
    return sum(map(text.count, "0123456789"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in the order of start and kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= digits_in(m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def short(text: str) -> str:
    return text if len(text) <= SHORT else "#" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def plain(word: str) -> str:
    return DIGIT.sub("0", short(word.lower()))


def shape(value: str) -> str:
    """Digits as 9, runs of letters as a; a hexadecimal code by its length."""
    if HEX.fullmatch(value) and not value.isdigit() and DIGIT.search(value):
        return f"code of {len(value)}"
    return short(LETTER.sub("a", DIGIT.sub("9", value)))


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a mention; words are lower-cased, with digits as 0."""
    width = 32
    while True:  # whole words however long they are: the first one in the window may be cut
        before = WORD.findall(text, max(0, start - width), start)
        if len(before) > 2 or width >= start:
            break
        width *= 2
    left = [plain(word) for word in before[-2:]]
    found = WORD.search(text, end)
    right = plain(found[0]) if found else ""
    out = ["s:" + shape(text[start:end])]
    if left:
        out.append("l:" + left[-1])
    if len(left) > 1:
        out.append("l:" + " ".join(left))
    if right:
        out.append("r:" + right)
    if left and right:
        out.append(f"b:{left[-1]} _ {right}")
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    """Values assigned to the name of a credential that hold both letters and digits."""
    if "=" not in text and ":" not in text:
        return []
    return [m.span(1) for m in CREDENTIAL.finditer(text) if DIGIT.search(m[1]) and not m[1].isdigit()]


def phone_with_more(text: str, ends: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Whole words at the beginning of a dropped run of numbers that have the digits of a phone number."""
    for m in PHONE.finditer(text):
        if digits_in(m[0]) <= 15:
            continue
        last, digits = None, 0
        for word in TOKEN.finditer(text, m.start(), m.end()):
            digits += digits_in(word[0])
            if digits > 15:
                break
            if digits >= 10:
                last = word.end()
        if last and not any(x < last and m.start() < y for x, y in ends):
            yield m.start(), last


def mentions(text: str) -> list[tuple]:
    """(start, end, kind, base, never, value, patterns) of seeds and, without a kind, of candidates."""
    base = base_spans(text)
    ends = [(a, b) for a, _, b in base]
    known = [(a, b) for a, b in secrets(text) if not any(x < b and a < y for x, y in ends)]
    found = [(a, b, kind, True) for a, kind, b in base] + [(a, b, SECRET, False) for a, b in known]
    taken = sorted(ends + known)
    if "@" in text or DIGIT.search(text):
        if "+" in text:
            others = list(phone_with_more(text, taken))
            found += [(a, b, None, False) for a, b in others]
            taken = sorted(taken + others)
        k = 0
        for m in TOKEN.finditer(text):
            token = m[0].strip(RIM)
            if not token or "@" not in token and digits_in(token) < 4:
                continue
            a = m.start() + len(m[0]) - len(m[0].lstrip(RIM))
            b = a + len(token)
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if not any(x < b and a < y for x, y in taken[k:k + len(NAMES)]):
                found.append((a, b, None, False))
    out = []
    for a, b, kind, own in sorted(found, key=lambda x: x[:2]):
        value = text[a:b]
        never = None if kind is not None else 1 if QUAD.fullmatch(value) else 2 if NUMBER.fullmatch(value) else None
        out.append((a, b, kind, own, never, short(value), patterns(text, a, b)))
    return out


MENTION = "array<struct<start:long,end:long,kind:int,base:boolean,never:int,value:string,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, mentions) of every row, stored; texts are read once and not kept."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "mentions": [mentions(text) for text in batch["text"]]})

    rows = keyed_as(docs, as_text(docs).mapInPandas(run, f"doc_id string, mentions {MENTION}"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "mentions")  # fixed once it is written


def scored_patterns(found: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, n, seeds, score) of the patterns with enough different seeds, stored; n and seeds count mentions."""
    each = found.select(F.explode("mentions").alias("m")).select("m.value", "m.kind", "m.never", F.explode("m.patterns").alias("pattern"))
    edges = stored(each.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.max("never").alias("never"), F.count("*").alias("n")), "edges")
    # patterns that enough different seeds of one kind share; the others can never be believed
    seen = edges.filter("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("different"), F.sum("n").alias("seeds"))
    own = seen.filter(F.col("different") >= support).groupBy("pattern").agg(F.max(F.struct("different", (-F.col("kind")).alias("k"), "seeds")).alias("best"))
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("pattern_n"))
    own = stored(own.join(totals, "pattern").select("pattern", (-F.col("best.k")).alias("own_kind"), F.col("best.seeds").alias("seeds"), "pattern_n"), "patterns")
    named = own.select("pattern", F.col("own_kind").alias("kind"), F.col("pattern_n").alias("n"), "seeds")
    if own.isEmpty():
        return named.withColumn("score", F.lit(0.0))
    edges = attach(edges, own.drop("seeds"), ["pattern"], "pattern_n", F.col("value")).filter("own_kind IS NOT NULL").drop("pattern_n")
    edges = stored(edges.withColumn("view", F.substring("pattern", 1, 1)), "graph")
    belief, scores = edges.withColumn("belief", (F.col("kind") == F.col("own_kind")).cast("double")).fillna(0.0, ["belief"]), None
    for step in range(rounds + 1):
        scores = stored(belief.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("belief")) / F.sum("n")).alias("score"), F.sum("n").alias("score_n")), "scores")
        if step == rounds:
            break
        # an instance is believed as far as its best pattern of that kind in another view
        rated = attach(edges, scores, ["pattern"], "score_n", F.col("value"))
        bests = [F.max(F.when(F.col("view") == view, F.col("score"))).alias(f"best_{view}") for view in VIEWS]
        best = stored(rated.groupBy("value", "own_kind").agg(*bests, F.count("*").alias("value_n")), "instances")
        heard = F.coalesce(*[F.when(F.col("view") == view, F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(f"best_{v}", F.lit(0.0)) for v in others]))
                             for view, others in VIEWS.items()])
        open_ = F.col("kind").isNull() & (F.coalesce("never", F.lit(-1)) != F.col("own_kind"))
        belief = attach(edges, best, ["value", "own_kind"], "value_n", F.col("pattern")).withColumn(
            "belief", F.when(F.col("kind") == F.col("own_kind"), 1.0).when(open_, heard).otherwise(0.0))
        belief = stored(belief.select("pattern", "n", "belief"), "beliefs")
    return stored(named.join(scores.select("pattern", "score"), "pattern"), "scored-patterns")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, places): how often each word occurs in all texts, as patterns spell it; counted by batch first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said, out = Counter(), Counter()
            for text in batch["text"]:
                said.update(WORD.findall(text))
            for word, n in said.items():
                out[plain(word)] += n
            yield pd.DataFrame({"word": list(out), "places": list(out.values())})

    return as_text(docs).select("text").mapInPandas(run, "word string, places long")


def believed_patterns(found: DataFrame, docs: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT,
                      selective: float = SELECTIVE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, n, seeds, score) of the patterns that are believed, stored."""
    good = scored_patterns(found, support, rounds).filter((F.col("score") >= confident) & (F.col("seeds") * 2 >= F.col("n")))
    one_word = F.col("pattern").rlike("^[lr]:[^ ]+$")
    single = stored(good.filter(one_word).withColumn("word", F.substring("pattern", 3, 1 << 20)), "single-words")
    words = stored(single.select("word").distinct(), "words")
    places = matching(word_counts(docs), words, ["word"]).groupBy("word").agg(F.sum("places").alias("places"))
    single = single.join(places, "word").filter(F.col("n") >= selective * F.col("places")).select(good.columns)
    return stored(good.filter(~one_word).unionByName(single), "believed")


def _is(kind: int):
    return lambda own: own == kind


def _is_secret(mention):
    return F.coalesce(mention["kind"] == SECRET, F.lit(False))


def _joined(spans):
    """kind:start:end of an array of (start, kind, end), by start and kind."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_found) of every row.

    The counts and the digest are those of the base spans; `spans` also holds the n_secret values of credentials and the
    n_found spans that patterns discovered.
    """
    ship_package(docs.sparkSession)
    found = scan(docs)
    good = believed_patterns(found, docs)
    rows = found.select("row", F.explode(F.filter("mentions", lambda m: m["kind"].isNull())).alias("m")).select(
        "row", "m.start", "m.end", "m.never", F.explode("m.patterns").alias("pattern"))
    more = attach(rows, good, ["pattern"], "n", F.col("row")).filter(F.col("kind").isNotNull() & (F.coalesce("never", F.lit(-1)) != F.col("kind")))
    more = more.groupBy("row", "start", "end").agg((-F.max(F.struct("score", (-F.col("kind")).alias("k")))["k"]).alias("kind"))
    more = more.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))  # candidates of one text

    def spans(keep):
        return F.transform(F.filter("mentions", keep), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))

    both = found.select("row", "doc_id", spans(lambda m: m["base"]).alias("base"), spans(_is_secret).alias("secrets")).join(more, "row", "left")
    more = F.coalesce("more", F.expr("cast(array() as array<struct<start:long,kind:int,end:long>>)"))
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return both.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                       _joined(F.concat("base", "secrets", more)).alias("spans"),
                       F.size("secrets").cast("long").alias("n_secret"), F.size(more).cast("long").alias("n_found"))
