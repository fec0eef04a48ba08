"""Amounts, dates and integral numbers out of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

DIGITS = r"[0-9]+(?:\.[0-9]+)?"
#: Korean units of ten thousands, and those within a section.
LARGE = {"조": 10**12, "억": 10**8, "만": 10**4}
SMALL = {"천": 1000, "백": 100, "십": 10}
SECTION = "".join(f"(?:(?:{DIGITS})?{unit})?" for unit in SMALL) + f"(?:{DIGITS})?"
AMOUNT = "^" + "".join(f"(?:{SECTION}{unit})?" for unit in LARGE) + SECTION + "$"


def decimal(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("decimal(30,4)")


def section_value(text: Column) -> Column:
    """The value of a section such as 2천5백: a unit without a number counts once."""
    units = [F.when(text.contains(unit), F.coalesce(decimal(F.regexp_extract(text, f"({DIGITS}){unit}", 1)), F.lit(1)) * n).otherwise(0) for unit, n in SMALL.items()]
    return sum(units, F.coalesce(decimal(F.regexp_extract(text, f"({DIGITS})$", 1)), F.lit(0)))


def korean_won(text: Column) -> Column:
    """A written Korean amount in won: digits with units in falling order, a bare unit once. Spoken short forms: after 억, a rest below
    ten thousand without 원 counts ten thousands. Null for anything else, fractions of a won included."""

    def step(state: Column, unit: str, n: int) -> Column:
        """The state with a unit's value added, and what follows the unit as its rest."""
        value = let(F.substring_index(state["rest"], unit, 1), lambda head: F.when(head == "", F.lit(1)).otherwise(section_value(head)) * n)
        more = F.struct((state["total"] + F.coalesce(value, F.lit(0))).cast("decimal(38,4)").alias("total"), F.substring_index(state["rest"], unit, -1).alias("rest"))
        return F.when(state["rest"].contains(unit), more).otherwise(state)

    def read(squeezed: Column, s: Column) -> Column:
        state = F.struct(F.lit(0).cast("decimal(38,4)").alias("total"), s.alias("rest"))
        for unit, n in LARGE.items():
            state = let(state, lambda x: step(x, unit, n))  # noqa: B023  called at once

        def end(total: Column, tail: Column) -> Column:
            spoken = s.contains("억") & ~s.contains("만") & (s == squeezed) & (tail > 0) & (tail < 10**4)
            return let(total + tail * F.when(spoken, 10**4).otherwise(1), lambda won: F.when(won == F.floor(won), won.cast("long")))

        return let(state, lambda x: let(section_value(x["rest"]), lambda tail: end(x["total"], tail)))

    def checked(squeezed: Column) -> Column:
        return let(F.regexp_replace(squeezed, "(원|KRW)$", ""), lambda s: F.when((s != "") & s.rlike(AMOUNT), read(squeezed, s)))

    return let(F.regexp_replace(text, r"[\s,]", ""), checked)


def integral(text: Column) -> Column:
    """struct(value long, flag): null with a flag if the text is no number or has a fraction."""
    number = F.regexp_replace(F.trim(text), ",", "").try_cast("decimal(30,6)")
    flag = F.when(text.isNull() | (F.trim(text) == ""), "missing").when(number.isNull(), "unparsed").when(number != F.floor(number), "fractional")
    return F.struct(F.when(flag.isNull(), number.cast("long")).alias("value"), flag.alias("flag"))


def moment(text: Column) -> Column:
    """struct(value string, precision): a date, or a date with a time; both null for anything else."""
    day = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    stamp = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")))
    date = F.when(text.rlike(day), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    value = F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
    return F.struct(value.alias("value"), F.when(date.isNotNull(), "date").when(stamp.isNotNull(), "timestamp").alias("precision"))


def micro_cost(tokens: dict[str, Column], rates: dict[str, float]) -> Column:
    """Tokens at rates for a million each, rounded up to a whole micro-unit."""
    return F.ceil(sum((F.coalesce(n, F.lit(0)).cast("decimal(20,0)") * F.lit(rates[k]).cast("decimal(12,6)") for k, n in tokens.items()), F.lit(0).cast("decimal(20,6)"))).cast("long")
