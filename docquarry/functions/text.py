"""Text as column expressions: analyzers, shingles, likeness, codes and loops."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Fixed value: characters stripped from both ends of a token.
PUNCTUATION = ".,;:!?()[]{}\"'`|*#%$&"
#: Fixed value: requirement codes such as SFR-001, not as part of longer words or numbers.
CODE = r"(?<![A-Za-z0-9])([A-Z]{1,5}R-[0-9]{1,4})(?![0-9])"


def tokens(text: Column) -> Column:
    """Lower-cased words without punctuation at their ends; an empty text gives one placeholder, so that row counts stay."""
    return F.filter(F.transform(raw_words(text), stripped), lambda w: w != "")


def raw_text(text: Column) -> Column:
    """The lower-cased text; of a text with no word but punctuation, the placeholder."""
    own = F.lower(F.coalesce(text, F.lit("")))
    return F.when(own.rlike("[^ \t\r\n" + re.escape(PUNCTUATION) + "]"), own).otherwise("∅")


def raw_words(text: Column) -> Column:
    """Lower-cased words as they stand; of a text with no word but punctuation, the placeholder."""
    return F.split(raw_text(text), "[ \t\r\n]+")


def stripped(word: Column | str) -> Column:
    return F.btrim(F.col(word) if isinstance(word, str) else word, F.lit(PUNCTUATION))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where body's lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(words: Column, n: int) -> Column:
    """Space-joined runs of n words, repeats included; none for shorter texts."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, F.lit(n)))
    return let(text, lambda t: F.when(F.length(t) >= n, F.array_distinct(runs(t))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def codes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CODE), F.lit(1)))


def squashed(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"[ \t\r\n ]+", "")


def sentences(text: Column) -> Column:
    """Non-empty sentences: cut after a stop and white space, and at line ends."""
    marked = F.regexp_replace(text, "([.!?])[ \t]+|[\r\n]+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def numbers(text: Column) -> Column:
    """Written numbers in order, thousands separators taken out."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", ""))


def looping(lines: Column) -> Column:
    """The last 12 lines are one line, or the last 48 at most 8 different ones."""
    last = lambda n: F.slice(lines, -n, n)
    return F.when(F.size(lines) >= 12, F.size(F.array_distinct(last(12))) == 1).otherwise(False) | F.when(F.size(lines) >= 48, F.size(F.array_distinct(last(48))) <= 8).otherwise(False)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def two_places(number: pd.Series) -> pd.Series:
    """Numbers as C's %.2f writes them: by their exact binary value, halves to even, with the sign of zero; casts and Java's formats round decimal text."""
    return pd.Series([None if pd.isna(x) else "%.2f" % x for x in number], dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def anchor(text: pd.Series, quote: pd.Series) -> pd.Series:
    """[start, end) of the only place where a quote stands in a text, white space apart; null if there is none or several."""

    def find(t: str | None, q: str | None) -> list[int] | None:
        at = [i for i, c in enumerate(t or "") if not c.isspace()]
        hay, needle = "".join(t[i] for i in at) if t else "", "".join((q or "").split())
        first = hay.find(needle) if needle else -1
        if first < 0 or hay.find(needle, first + 1) >= 0:
            return None
        return [at[first], at[first + len(needle) - 1] + 1]

    return pd.Series([find(t, q) for t, q in zip(text, quote, strict=True)])


#: What negates a qualifier shortly after it, and right before it.
NEGATED_AFTER = ("않", "안됨", "아니", "제외", "불포함", "미포함", "별도", "없")
NEGATED_BEFORE = ("미", "불", "비")


def affirmed(text: Column, spelling: str, after: Sequence[str] = NEGATED_AFTER, before: Sequence[str] = NEGATED_BEFORE, window: int = 6) -> Column:
    """Whether a spelling occurs at least once with no negation in the `window` characters after it, and no negating prefix before it.
    An empty spelling is never affirmed; a null text gives null."""
    if not spelling:
        return F.when(text.isNotNull(), F.lit(False))
    prefix = f"(?<!{'|'.join(map(re.escape, before))})" if before else ""
    clear = "".join(f"(?!.{{0,{window - len(n)}}}{re.escape(n)})" for n in after if len(n) <= window)
    return text.rlike(f"(?s){prefix}{re.escape(spelling)}{clear}")
