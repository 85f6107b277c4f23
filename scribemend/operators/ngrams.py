"""N-gram language model held as tables: training, scoring, perplexity.

A gram is an ARRAY<STRING>.  Tables: grams(n, gram, cnt), contexts(context, cnt) and
one row of meta(n, vocab, total).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemend.functions.text import item_rows
from scribemend.operators.gains import ESCAPE, JOINT, shared_gains, summed_gains
from scribemend.operators.lookup import INDEX_BYTES
from scribemend.operators.tokens import gram_arrays
from scribemend.session import measured_bytes, skew_safe_join, stored

SEPARATOR = "\u0001"
SINGLES_BYTES = 16 * 1024 * 1024  # tokens with their counts up to this size go to every task when gains are worked out
HOT_SHARE = 10_000  # a gram is hot from 1/10000 of all tokens on: at most 10000 per order


@dataclass(frozen=True)
class NgramModel:
    grams: DataFrame
    contexts: DataFrame
    meta: DataFrame


def _spelled(token: Column) -> Column:
    """A token without the character that joins tokens; a null one has a spelling of its own."""
    safe = F.replace(F.replace(token, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(JOINT), F.lit(ESCAPE + "1"))
    return F.when(token.isNull(), ESCAPE + "2").when(F.contains(token, F.lit(ESCAPE)) | F.contains(token, F.lit(JOINT)), safe).otherwise(token)


def _read(token: Column) -> Column:
    """The token that `_spelled` has spelled."""
    plain = F.replace(F.replace(token, F.lit(ESCAPE + "1"), F.lit(JOINT)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))
    return F.when(token == ESCAPE + "2", None).when(F.contains(token, F.lit(ESCAPE)), plain).otherwise(token)


def train(df: DataFrame, n: int = 2, token_col: str = "tokens") -> NgramModel:
    """Count 1..n-grams of token arrays; one pass, partial counts before the shuffle."""
    if not 1 <= n <= 3:
        raise ValueError("n must be 1, 2 or 3")
    spelled = df.select(F.transform(token_col, _spelled).alias("_spelled"))
    tokens = F.col("_spelled")
    every = F.flatten(F.array(*[F.transform(gram_arrays(tokens, k), lambda g: F.array_join(g, JOINT)) for k in range(1, n + 1)]))
    # a gram travels as one string: an array takes several times as much
    read = F.transform(F.split("_gram", JOINT, -1), _read)
    grams = (item_rows(spelled, [], every, "_gram").groupBy("_gram").agg(F.count("*").alias("cnt"))
             .select(read.alias("gram"), "cnt").select(F.size("gram").alias("n"), "gram", "cnt"))
    return model_of(grams, n)


def model_of(grams: DataFrame, n: int) -> NgramModel:
    """The model of a table of grams: its contexts and totals follow from it."""
    contexts = (grams.filter("n >= 2")
                .groupBy(F.slice("gram", F.lit(1), F.col("n") - 1).alias("context"))
                .agg(F.sum("cnt").alias("cnt")))
    meta = (grams.filter("n = 1")
            .agg(F.count("*").alias("vocab"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))
            .select(F.lit(n).alias("n"), "vocab", "total"))
    return NgramModel(grams, contexts, meta)


def laplace(count: Column, context: Column, vocab: Column) -> Column:
    return (count + 1) / (context + vocab)


def gram_probabilities(model: NgramModel) -> DataFrame:
    """Laplace probability of every gram: (n, gram, cnt, prob); contexts as stored at training."""
    ones = model.grams.filter("n = 1")
    more = model.grams.filter("n >= 2").withColumn("context", F.slice("gram", F.lit(1), F.col("n") - 1))
    vocab, total = _meta_values(model)
    left = ones.select("n", "gram", "cnt", laplace(F.col("cnt"), F.lit(total), F.lit(vocab)).alias("prob"))
    right = (more.join(model.contexts.withColumnRenamed("cnt", "context_cnt"), "context")
             .select("n", "gram", "cnt", laplace(F.col("cnt"), F.col("context_cnt"), F.lit(vocab)).alias("prob")))
    return left.unionByName(right)


def _meta_values(model: NgramModel) -> tuple[int, int]:
    row = model.meta.first()
    return int(row["vocab"]), int(row["total"])


def lookup_counts(grams: DataFrame, model: NgramModel, total: int, spread: Column) -> DataFrame:
    """Add `cnt` (null when unseen) to rows with a `gram`; frequent grams never meet in one task."""
    known = model.grams.select("gram", "cnt")
    hot = known.filter(F.col("cnt") * HOT_SHARE >= max(total, 1))
    return skew_safe_join(grams, known, ["gram"], hot, spread)


def _log_probability(place: Column, c1: Column, c2: Column, c3: Column, prev: Column, prev2: Column,
                     n: int, vocab: int, total: int) -> Column:
    """Log probability of a token at a place (0, 1, 2 = third or later) from gram counts.

    The denominator is the count of the shorter gram itself, not the stored context count.
    With n = 2 an unseen pair backs off to the single token at the second place only.
    """
    v = F.lit(vocab)
    one = laplace(c1, F.lit(total), v)
    if n == 1:
        return F.log(one)
    second = F.when(c2 > 0, laplace(c2, prev, v)).otherwise(one)
    later = (F.when(c3 > 0, laplace(c3, prev2, v)).otherwise(second) if n >= 3 else laplace(c2, prev, v))
    return F.log(F.when(place == 0, one).when(place == 1, second).otherwise(later))


def score_tokens(df: DataFrame, model: NgramModel, n: int = 2, id_col: str = "id",
                 token_col: str = "tokens", limit: int = INDEX_BYTES) -> DataFrame:
    """Log-probability of every token array: (id, log_prob, n_tokens); empty or null text scores 0.

    A token counts as one that no gram knows; each gram of the model that ends there adds what it changes.  The
    gains of frequent grams (within `limit` bytes) are added where the texts lie; only windows that can be another gram travel.
    """
    vocab, total = _meta_values(model)
    shared, others = shared_gains(stored(gram_gains(model, n, vocab, total), "windows-gains", "zstd"), limit)
    rows = df.select(id_col, F.monotonically_increasing_id().alias("_row"), said_tokens(F.col(token_col)).alias("_said"))
    made = summed_gains(rows, n, shared, (total + vocab, vocab))
    log_p = F.coalesce("known", F.lit(0.0))
    if others is not None:
        gains = others.select("gram", F.col("opening").alias("_opening"), F.col("later").alias("_later"))
        made = made.join(gains, "gram", "left")
        log_p = (log_p + F.coalesce(F.col("opening") * F.col("_opening"), F.lit(0.0))
                 + F.coalesce(F.col("later") * F.col("_later"), F.lit(0.0)))
    return (made.groupBy(id_col, "empty").agg(F.sum(log_p).alias("log_prob"), F.sum("n_tokens").alias("n_tokens"))
            .select(id_col, "log_prob", "n_tokens"))


def said_tokens(tokens: Column) -> Column:
    """Tokens as one string, spelled and joined as `train` counts them; null without tokens."""
    odd = F.exists(tokens, lambda t: t.isNull() | F.contains(t, F.lit(ESCAPE)) | F.contains(t, F.lit(JOINT)))
    return F.when(F.size(tokens) > 0, F.when(odd, F.array_join(F.transform(tokens, _spelled), JOINT)).otherwise(
        F.array_join(tokens, JOINT)))


def gram_gains(model: NgramModel, n: int, vocab: int, total: int) -> DataFrame:
    """(gram, cnt, opening, later): what each gram adds to the log-probability of a token as the shorter grams give it.

    With n = 2 a pair behind the second place counts from `later`: a single token then tells what an unseen pair that
    begins with it adds to one of two unknown tokens.
    """
    v, none = F.lit(vocab), F.lit(None).cast("double")
    kept = model.grams.filter((F.col("n") <= n) & (F.col("cnt") > 0)).select("n", F.transform("gram", _spelled).alias("g"), "cnt")

    def of(size: int, *parts: Column) -> DataFrame:
        return kept.filter(F.col("n") == size).select(F.array_join("g", JOINT).alias("gram"), "cnt", *parts)

    def alone(count: Column) -> Column:
        return F.log(laplace(count, F.lit(total), v))

    def looked_up(rows: DataFrame, key: str, known: DataFrame, value: str = "cnt") -> DataFrame:
        """Rows with `_<key>`: a value of the gram that a column names; frequent ones never meet in one task."""
        held = known.select(F.col("gram").alias(key), F.col(value).alias(f"_{key}"))
        if known is singles and small:
            return rows.join(F.broadcast(held), key, "left")
        hot = known.filter(F.col("cnt") * HOT_SHARE >= max(total, 1)).select(F.col("gram").alias(key), F.col(value).alias(f"_{key}"))
        return skew_safe_join(rows, held, [key], hot, F.xxhash64("gram"))

    singles = of(1)
    small = n > 1 and measured_bytes(singles) <= SINGLES_BYTES
    after = F.log(v / (F.col("cnt") + v)) if n == 2 else none
    out = singles.select("gram", "cnt", F.log(F.col("cnt") + 1).alias("opening"), after.alias("later"))
    if n == 1:
        return out
    first, last, start = (F.coalesce(f"_{key}", F.lit(0)) for key in ("first", "last", "start"))
    pairs = looked_up(looked_up(of(2, F.col("g")[0].alias("first"), F.col("g")[1].alias("last")), "first", singles), "last", singles)
    pairs = pairs.select("gram", "cnt", F.log(laplace(F.col("cnt"), first, v)).alias("log_p"), alone(last).alias("alone"))
    later = F.log(F.col("cnt") + 1) if n == 2 else none
    out = out.unionByName(pairs.select("gram", "cnt", (F.col("log_p") - F.col("alone")).alias("opening"), later.alias("later")))
    if n == 2:
        return out
    parts = [F.array_join(F.slice("g", k, 2), JOINT).alias(name) for k, name in ((1, "start"), (2, "end"))]
    triples = looked_up(of(3, *parts, F.col("g")[2].alias("last")), "start", pairs)
    triples = looked_up(looked_up(triples, "end", pairs, "log_p"), "last", singles)
    shorter = F.coalesce("_end", alone(last))
    return out.unionByName(triples.select("gram", "cnt", (F.log(laplace(F.col("cnt"), start, v)) - shorter).alias("opening"),
                                          none.alias("later")))


def text_gram_counts(grams: DataFrame, model: NgramModel, id_col: str = "id") -> DataFrame:
    """(id, counts MAP<STRING, BIGINT>) for rows (id, gram): the model counts one text needs.

    The map holds no more grams than its text asked for and only those that the model has seen; the key joins the
    tokens with a separator.  A text without such grams has no row.
    """
    _, total = _meta_values(model)
    found = lookup_counts(grams.select(id_col, "gram"), model, total, F.col(id_col)).filter(F.col("cnt").isNotNull())
    return found.groupBy(id_col).agg(F.map_from_entries(F.collect_set(F.struct(
        F.array_join("gram", SEPARATOR), "cnt"))).alias("counts"))


def place_log_probability(token_array: Column, at: Column, counts: Column, n: int, vocab: int, total: int,
                          before: Column | int = 0) -> Column:
    """Log probability of the token at position `at` (from 0) from a map of counts, in the row.

    `before` tokens of the text stand before the array; then at least n - 1 of the array must stand before `at`.
    """

    def count(length: int, shift: int = 0) -> Column:
        start = at - shift - (length - 1)
        key = F.array_join(F.slice(token_array, F.greatest(start, F.lit(0)) + 1, F.lit(length)), SEPARATOR)
        return F.when(start >= 0, F.coalesce(counts[key], F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))

    return _log_probability(F.least(at + before, F.lit(2)), count(1), count(2), count(3), count(1, 1), count(2, 1),
                            n, vocab, total)


def sequence_log_probability(token_array: Column, counts: Column, n: int, vocab: int, total: int) -> Column:
    """Log probability of a short token array from a map of counts, in the row."""
    size = F.size(token_array)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), F.lit(0.0),
        lambda acc, i: acc + place_log_probability(token_array, i, counts, n, vocab, total)))


def perplexity(scores: DataFrame) -> DataFrame:
    """One row: exp of the mean negative log-probability over all tokens of a scored corpus."""
    return scores.agg(F.exp(-F.sum("log_prob") / F.sum("n_tokens")).alias("perplexity"))
