"""Dates, times and amounts that texts state, a check of claims against passages, and mutants of texts that such a check must find.

All are column expressions. Amounts have four digits after the point at most (more are rounded). Strings in the shape of a date whose day does
not exist are no dates. A null text states nothing and has no mutant. Where a mutation may choose, it takes the smallest stated value, so equal
rows have equal mutants. Each text is read once: as its written dates or amounts with their values, from which the rest is taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import grams, let

#: What stands between the parts of a date and of a time, and the names of the halves of a day.
DAY = r"(20[0-9]{2})\s*(?:[.\-/]|년)\s*([0-9]{1,2})\s*(?:[.\-/]|월)\s*([0-9]{1,2})(?:\s*일)?\.?(?:\s*\([^)]{0,4}\))?"
CLOCK = r"(?:\s*(오전|오후)?\s*([0-9]{1,2})\s*(?::|시)(?:\s*([0-9]{2}))?(?:\s*분)?)?"
DATE = DAY + CLOCK
#: Units of amounts.
UNITS = {"조": 10**12, "억": 10**8, "천만": 10**7, "백만": 10**6, "십만": 10**5, "만": 10**4, "천": 10**3}
NUMBER = r"[0-9][0-9,]*+(?:\.[0-9]+)?+"
#: Where a number may begin; most letters fail at the first test.
BEGIN = r"(?=[0-9])(?<![0-9.,])"
#: A number without a unit, or parts with falling units, then one without a unit: `5,000`, `130백만`, `1억 3천만`.
WITHOUT_UNIT = rf"{NUMBER}(?!\s*(?:[조억만천]|[백십]만))"
AMOUNT = rf"{BEGIN}(?:{WITHOUT_UNIT}|" + "".join(rf"(?:{NUMBER}\s*{u}\s*)?+" for u in UNITS) + rf"(?:{WITHOUT_UNIT})?+)"
#: Units of stated numbers, and what each is exchanged for.
SWAPS = {"개월": "년", "년": "개월", "주": "일", "일": "주", "시간": "분", "분": "시간", "원": "달러", "%": "배"}
#: Qualifiers and their opposites; comparisons count right after a number or its unit only.
FLIPS = {
    "부가세 포함": "부가세 별도", "부가세 별도": "부가세 포함", "부가가치세 포함": "부가가치세 별도", "부가가치세 별도": "부가가치세 포함", "VAT 포함": "VAT 별도", "VAT 별도": "VAT 포함",
    "이상": "이하", "이하": "이상", "이내": "초과", "초과": "이내", "미만": "초과", "필수": "선택", "의무": "권장", "이전": "이후", "이후": "이전", "사전": "사후",
    "최소": "최대", "최대": "최소", "포함": "제외", "제외": "포함",
}
COMPARISONS, BEFORE_COMPARISON = ("이상", "이하", "이내", "초과", "미만"), "0-9%일주월년간분명개회건원"
#: Predicates at the end of sentences and their negations.
NEGATIONS = {
    "하여야 합니다": "하지 않아도 됩니다", "해야 합니다": "하지 않아도 됩니다", "해야 하며": "하지 않아도 되며", "할 수 있습니다": "할 수 없습니다", "필요합니다": "필요하지 않습니다",
    "있습니다": "없습니다", "됩니다": "되지 않습니다", "합니다": "하지 않습니다",
}


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def holds(values: Column, value: Column) -> Column:
    """Whether an array holds a value; array_contains throws at each hit when it is interpreted, as it is beside these functions of arrays."""
    return F.exists(values, lambda v: v == value)


def day_of(written: Column) -> Column:
    """The day of one written date, null if there is no such day."""
    return F.regexp_replace(written, DATE, "$1-$2-$3").try_cast("date").cast("string")


def time_of(written: Column) -> Column:
    """The time of one written date as HH:mm, null if it has none or an impossible one."""

    def read(p: Column) -> Column:
        half, hour, minute = p[0], F.nullif(p[1], F.lit("")).try_cast("int"), F.coalesce(F.nullif(p[2], F.lit("")).try_cast("int"), F.lit(0))
        hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "오후", 12).otherwise(0))
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        return let(F.struct(hour.alias("h"), minute.alias("m")), lambda x: F.when((x["h"] < 24) & (x["m"] < 60), F.concat_ws(":", two(x["h"]), two(x["m"]))))

    return let(F.split(F.regexp_replace(written, DATE, "$4;$5;$6"), ";", -1), read)


def read_dates(text: Column) -> Column:
    """array<struct(w, day)>: the dates as written and their days, in the order of the text."""
    return F.transform(found(text, DATE), lambda w: F.struct(w.alias("w"), day_of(w).alias("day")))


def dates(text: Column) -> Column:
    """The days that a text states, and days with times (2024-06-11T17:00), each once and in order."""
    both = lambda x: F.array(x["day"], F.concat(x["day"], F.lit("T"), time_of(x["w"])))
    return F.sort_array(F.array_distinct(F.array_compact(F.flatten(F.transform(read_dates(text), both)))))


def value_of(amount: Column) -> Column:
    """The value of one written amount."""
    plain = lambda number: F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(30,4)")
    read = lambda pattern: plain(F.regexp_extract(amount, pattern, 1))
    part = lambda u, n: F.coalesce(read(rf"({NUMBER})\s*{u}" + ("(?!만)" if u == "천" else "")) * n, F.lit(0))
    parts = [F.when(amount.contains(u), part(u, n)).otherwise(0) for u, n in UNITS.items()]
    united = sum(parts, F.coalesce(read(rf"(?:^|[^0-9.,])({NUMBER})\s*$"), F.lit(0))).cast("decimal(38,4)")
    # all but units are single bytes
    return F.when(F.octet_length(amount) > F.length(amount), united).otherwise(F.coalesce(plain(amount).cast("decimal(38,4)"), F.lit(0).cast("decimal(38,4)")))


def read_amounts(text: Column) -> Column:
    """array<struct(w, v)>: the amounts as written and their values, in the order of the text."""
    return F.transform(found(text, AMOUNT), lambda w: F.struct(w.alias("w"), value_of(w).alias("v")))


def values(read: Column) -> Column:
    """The values of read amounts."""
    return read["v"]


def large_values(read: Column) -> Column:
    """Those of ten thousand and more, or written with such a unit."""
    return values(F.filter(read, lambda x: x["w"].contains("억") | x["w"].contains("만") | (x["v"] >= 10_000)))


def amounts(text: Column) -> Column:
    """The values of all numbers that a text states, each once."""
    return F.array_distinct(values(read_amounts(text)))


def large_amounts(text: Column) -> Column:
    """Those of ten thousand and more, or written with such a unit."""
    return F.array_distinct(large_values(read_amounts(text)))


def value_check(claim: Column, passages: Column) -> Column:
    """`unsupported` if a claim states a date or a large amount that its passages (one text) don't; null otherwise."""
    foreign = F.size(F.array_except(dates(claim), dates(passages))) + F.size(F.array_except(large_amounts(claim), amounts(passages)))
    return F.when(foreign > 0, "unsupported")


def replaced(text: Column, pattern: str, own: Column, new: Callable[[Column], Column]) -> Column:
    """text with every match of a pattern replaced by new(match); null stands for the match itself. own: the matches in order, as structs with their
    strings as `w`; none may be empty."""
    # split() would compile the pattern for each row; after a text that ends without a match one more rest is empty
    rest = F.regexp_extract_all(text, F.lit(rf"((?s:.*?))(?:{pattern}|\z)"), F.lit(1))
    pieces = F.zip_with(rest, own, lambda r, x: F.concat(r, F.coalesce(new(x), x["w"], F.lit(""))))
    return F.array_join(pieces, "")


def mutant(text: Column, before: Column, after: Column) -> Column:
    """struct(text, before, after), null where nothing was changed."""
    made = F.struct(text.alias("text"), before.alias("before"), after.alias("after"))
    return let(made, lambda m: F.when(m["text"].isNotNull() & m["before"].isNotNull() & m["after"].isNotNull(), m))


def stated(kind: str, text: Column) -> Column:
    """The amounts, or else the days, that a text states, in its order and with repeats."""
    return values(read_amounts(text)) if kind == "amount" else F.filter(read_dates(text)["day"], lambda day: day.isNotNull())


def with_other_date(text: Column, passages: Column, theirs: Column | None = None) -> Column:
    """The first day that both state moves by a week, by two if the passages state that day too. theirs: what the passages state, if it is at hand."""

    def moved(x: Column) -> Column:
        later = lambda n: F.date_add(x["day"].cast("date"), n).cast("string")
        new = let(later(7), lambda week: F.when(holds(x["theirs"], week), later(14)).otherwise(week))
        return F.when(x["day"].isNotNull(), let(new, lambda n: rewritten(x["own"], x["day"], n)))

    def rewritten(own: Column, day: Column, new: Column) -> Column:
        written = lambda x: F.concat_ws(" ", F.date_format(new.cast("date"), "yyyy년 M월 d일"), time_of(x["w"]))
        return mutant(replaced(text, DATE, own, lambda x: F.when(x["day"] == day, written(x))), day, new)

    def chosen(x: Column) -> Column:
        both = F.filter(x["own"], lambda o: holds(x["theirs"], o["day"]))
        return let(F.struct(x["own"].alias("own"), x["theirs"].alias("theirs"), F.try_element_at(both, F.lit(1))["day"].alias("day")), moved)

    return let(F.struct(read_dates(text).alias("own"), (stated("date", passages) if theirs is None else theirs).alias("theirs")), chosen)


def with_other_amount(text: Column, passages: Column, theirs: Column | None = None) -> Column:
    """The smallest large whole amount that both state becomes one that neither states: its first digit goes up, or it is doubled, or one more.
    theirs: what the passages state, if it is at hand."""

    def chosen(x: Column) -> Column:
        old = F.array_min(F.filter(F.array_intersect(large_values(x["own"]), x["theirs"]), lambda v: v == F.floor(v)))
        return let(F.struct(x["own"].alias("own"), x["theirs"].alias("theirs"), old.alias("old")), lambda y: F.when(y["old"].isNotNull(), changed(y)))

    def changed(x: Column) -> Column:
        taken = F.concat(values(x["own"]), x["theirs"])
        step = F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(x["old"].cast("decimal(38,0)").cast("string")) - 1)).cast("decimal(30,0)")
        candidates = F.array(*[c.cast("decimal(38,4)") for c in (x["old"] + step, x["old"] * 2, x["old"] + 1, x["old"] + step * 2)])
        new = let(taken, lambda t: F.try_element_at(F.filter(candidates, lambda c: ~holds(t, c)), F.lit(1)))
        return let(new, lambda n: rewritten(x["own"], x["old"], n))

    def rewritten(own: Column, old: Column, new: Column) -> Column:
        whole = lambda v: v.cast("decimal(38,0)").cast("string")
        # white space after the amount belongs to the text, not to the amount
        written = lambda w: F.concat(F.when(w.rlike("[조억만천,]"), F.format_number(new, 0)).otherwise(whole(new)), F.regexp_extract(w, r"(\s*)$", 1))
        return mutant(replaced(text, AMOUNT, own, lambda x: F.when(x["v"] == old, written(x["w"]))), whole(old), whole(new))

    return let(F.struct(read_amounts(text).alias("own"), (stated("amount", passages) if theirs is None else theirs).alias("theirs")), chosen)


def with_other_unit(text: Column, passages: Column) -> Column:
    """The first number with a unit that both state takes another unit, everywhere. A year (1900년 to 2100년) is no period."""
    units = "|".join(sorted(map(re.escape, SWAPS), key=len, reverse=True))
    pattern = rf"{BEGIN}(?!(?:19|20)[0-9]{{2}}\s?년|2100\s?년){NUMBER}\s?(?:{units})"
    plain = lambda w: F.translate(w, ", \t\n\v\f\r", "")
    periods = lambda t: F.transform(found(t, pattern), plain)
    free = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), DATE, "\u0001")
    table = F.create_map(*[F.lit(x) for pair in SWAPS.items() for x in pair])

    def swapped(old: Column) -> Column:
        unit = F.regexp_extract(old, rf"({units})$", 1)
        exchange = lambda w: F.concat(F.regexp_extract(w, rf"^({NUMBER}\s?)", 1), F.element_at(table, unit))
        outside = rf"(?=[0-9])(?:{DATE}|{pattern})"
        own = F.transform(found(text, outside), lambda w: F.struct(w.alias("w")))
        body = replaced(text, outside, own, lambda x: F.when(plain(x["w"]) == old, exchange(x["w"])))
        return F.when(old.isNotNull(), mutant(body, old, F.concat(F.regexp_extract(old, rf"^({NUMBER})", 1), F.element_at(table, unit))))

    return let(F.try_element_at(F.array_intersect(periods(free(text)), periods(free(passages))), F.lit(1)), swapped)


def with_other_qualifier(text: Column, passages: Column) -> Column:
    """The first qualifier of the list that both state becomes its opposite, everywhere in the text."""
    out = F.lit(None)
    for old, new in reversed(FLIPS.items()):
        pattern = rf"(?<=[{BEFORE_COMPARISON}])(\s*){old}"
        has = (lambda t: t.rlike(pattern)) if old in COMPARISONS else (lambda t: t.contains(old))  # noqa: B023  called at once
        body = F.regexp_replace(text, pattern, f"$1{new}") if old in COMPARISONS else F.replace(text, F.lit(old), F.lit(new))
        out = F.when(has(text) & has(passages), mutant(body, F.lit(old), F.lit(new))).otherwise(out)
    return out


def with_negation(text: Column, passages: Column, least: float = 0.5) -> Column:
    """The sentence whose pairs of letters the passages hold the most of (at least `least`), of those that end in a predicate of the list, says the
    opposite; of equal ones the first."""
    letters = lambda t: grams(F.regexp_replace(t, "[^0-9A-Za-z가-힣]", ""), 2)
    sentences = found(text, r"[^.!?\n]+[.!?]?")

    def negated(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for old, new in reversed(NEGATIONS.items()):
            out = F.when(s.contains(old), F.regexp_replace(s, rf"(?s)^(.*){old}", f"$1{new}")).otherwise(out)
        return out

    def ranked(theirs: Column) -> Column:
        share = lambda s: F.try_divide(F.size(F.array_intersect(letters(s), theirs)), F.size(letters(s)))
        rows = F.transform(sentences, lambda s, k: F.struct((-F.coalesce(share(s), F.lit(0.0))).alias("score"), k.alias("k"), s.alias("s"), negated(s).alias("n")))
        return F.array_min(F.filter(rows, lambda x: x["n"].isNotNull() & (x["score"] <= -least)))

    def placed(x: Column) -> Column:
        body = F.array_join(F.transform(found(text, r"[^.!?\n]+[.!?]?|[.!?\n]"), lambda s: F.when(s == x["s"], x["n"]).otherwise(s)), "")
        return mutant(body, F.trim(x["s"]), F.trim(x["n"]))

    return let(let(letters(F.coalesce(passages, F.lit(""))), ranked), placed)


def stems(condition: str) -> list[str]:
    """What other wordings of a condition have in common: the first two letters of Korean words, Latin words in lower case."""
    words = re.findall("[가-힣]{2,}|[A-Za-z]{2,}", condition)
    own = {w.lower() if w.isascii() else w[:2] for w in words}
    return sorted(own | ({"부가"} if "vat" in own else set()) | ({"vat"} if "부가" in own else set()))


def without_condition(text: Column, conditions: Sequence[str]) -> Column:
    """The text without the first condition that can be taken out whole: spellings are parted by ` / `, and one that the text also states in
    other words stays."""

    def without(condition: str, bare: Column) -> Column:
        words = "|".join(map(re.escape, stems(condition)))
        left = bare.rlike(f"(?iu){words}") & F.lower(bare).rlike(words) if words else F.lit(False)  # few texts come to lower(), which is slow
        return F.when(~left, mutant(bare, F.lit(condition), F.lit("")))

    out = F.lit(None)
    for condition in reversed(conditions):
        spellings = sorted({s.strip() for s in condition.split(" / ")} - {""}, key=lambda s: (-len(s), s))
        if not spellings:
            continue
        bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "|".join(map(re.escape, spellings)), ""), r"\(\s*\)", ""), "[ \t]{2,}", " "))
        dropped = let(bare, lambda b: without(condition, b))  # noqa: B023  called at once
        out = F.coalesce(F.when(text.rlike("|".join(map(re.escape, spellings))), dropped), out)
    return out


MUTATIONS: dict[str, Callable[[Column, Column], Column]] = {"amount": with_other_amount, "unit": with_other_unit, "date": with_other_date, "qualifier": with_other_qualifier, "negation": with_negation}


def unchanged(kind: str, text: Column, made: Column, passages: Column, theirs: Column | None = None) -> Column:
    """Why a mutant does not differ from its source in the respect meant, else null. theirs: what the passages state, if it is at hand."""
    same = F.when(made["text"] == text, "text unchanged")
    if kind not in ("amount", "date"):
        return same
    old, new = (made[k].cast("decimal(38,4)") if kind == "amount" else made[k] for k in ("before", "after"))
    partly = lambda x: holds(x, old) | ~holds(x, new)
    whole = let(stated(kind, made["text"]), lambda x: F.when(partly(x), f"the {kind} was not replaced everywhere"))
    also = F.when(holds(stated(kind, passages) if theirs is None else theirs, new), f"the passages also state the new {kind}")
    return F.when(made.isNotNull(), F.coalesce(same, whole, also))
