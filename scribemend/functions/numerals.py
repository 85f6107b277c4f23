"""Chinese numerals: value of a well-formed numeral, digit-by-digit reading, spelling out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and units.
DIGITS = "一二三四五六七八九"
READ_CHARS = "零〇一二三四五六七八九幺"
READ_DIGITS = "001234567891"
TEN, HUNDRED, THOUSAND, MYRIAD = "十", "百", "千", "万"


def _well_formed() -> str:
    """Pattern of a positional numeral up to ten-thousands of ten-thousands."""
    one = f"[{DIGITS}]"
    below_100 = f"(?:{one}?{TEN}{one}?|{one})"
    hundreds = f"{one}{HUNDRED}(?:零{one}|{one}?{TEN}{one}?)?"
    below_1000 = f"(?:{hundreds}|{below_100})"
    thousands = f"{one}{THOUSAND}(?:零{below_100}|{hundreds})?"
    below_10000 = f"(?:{thousands}|{below_1000})"
    return f"^(?:零|{below_10000}{MYRIAD}(?:零{below_1000}|{thousands})?|{below_10000})$"


WELL_FORMED = _well_formed()


def numeral_value(text: Column) -> Column:
    """Value of a well-formed positional numeral, null for anything else."""

    zero = F.lit(0).cast("long")

    def state(total: Column, section: Column, digit: Column) -> Column:
        return F.struct(F.coalesce(total, zero).alias("total"), F.coalesce(section, zero).alias("section"),
                        F.coalesce(digit, zero).alias("digit"))

    def step(acc: Column, ch: Column) -> Column:
        digit = F.position(ch, F.lit(DIGITS)).cast("long")
        unit = F.when(ch == TEN, 10).when(ch == HUNDRED, 100).when(ch == THOUSAND, 1000).cast("long")
        added = F.greatest(acc["digit"], F.lit(1).cast("long")) * unit
        return (F.when(ch == MYRIAD, state((acc["section"] + acc["digit"]) * 10000, zero, zero))
                .when(unit.isNotNull(), state(acc["total"], acc["section"] + added, zero))
                .otherwise(state(acc["total"], acc["section"], digit)))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = F.aggregate(chars, state(zero, zero, zero), step,
                        lambda acc: acc["total"] + acc["section"] + acc["digit"])
    return F.when(text.rlike(WELL_FORMED), value)


def read_digits(text: Column) -> Column:
    """Digits read one by one (the radio reading of one included)."""
    return F.translate(text, READ_CHARS, READ_DIGITS)


def spell_digits(number: Column) -> Column:
    """Digits of a number spelled one by one."""
    return F.translate(number.cast("string"), "0123456789", "零一二三四五六七八九")


def spell_number(number: Column) -> Column:
    """Positional numeral of 0 .. 99 999 999."""

    def digit(value: Column, power: int) -> Column:
        return (F.floor(value / power) % 10).cast("int")

    def below_myriad(value: Column) -> Column:
        raw = F.concat(*[
            F.when(digit(value, p) > 0, F.concat(F.substring(F.lit(DIGITS), digit(value, p), F.lit(1)), F.lit(u)))
            .otherwise("零") for p, u in ((1000, THOUSAND), (100, HUNDRED), (10, TEN), (1, ""))])
        return F.regexp_replace(F.regexp_replace(raw, "零+", "零"), "零$", "")

    high, low = F.floor(number / 10000), number % 10000
    whole = F.concat(F.when(high > 0, F.concat(F.regexp_replace(below_myriad(high), "^零", ""), F.lit(MYRIAD)))
                     .otherwise(""), below_myriad(low))
    trimmed = F.regexp_replace(F.regexp_replace(whole, "^零", ""), "^一十", TEN)
    return F.when(number == 0, F.lit("零")).otherwise(trimmed)
