"""Operator 11: fill-in-middle by repeated capture.

One fullmatch of (unit)* by the regex library keeps every repetition of its group, so ends(1) lists where each unit of a text ends: its
length is the number of units, and both cuts are looked up in it. The unit is a pattern, a code point unless another is given. Where a
document is cut and which form it takes follow from the sha256 of seed and doc_id alone, so a lost task repeats the same rows.

Forms: plain, the text as it is; psm, <P>prefix<S>suffix<M>middle; spm, <S>suffix<P>prefix<M>middle. A text that holds one of the marks is
plain, so the first of each mark in an output is the mark itself and `restored` finds the exact text.

Defined cases: a null text is an empty one; an empty text is plain and has no units; a null doc_id hashes as the empty text after the
seed's colon; repeated rows give repeated rows; a text that the units don't cover (only with a unit of one's own) is plain with null n; an empty
table gives no rows; extra columns are ignored. A match holds some 60 bytes for each unit of one text, and texts are matched one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import in_slices
from .shared import trimming

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Settings:
    seed: int = 1
    unit: str = r"(?s:.)"  # a regex pattern that matches no empty text
    percent: int = 90  # of texts that are cut
    spm_percent: int = 20  # of those, in the form spm


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight hexadecimal digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cut(text: str, ends: list[int], h: list[int], settings: Settings) -> tuple[str, int | None, int | None, str]:
    """(form, prefix_chars, middle_chars, output) of a text whose units end at ends."""
    n = len(ends)
    if not text or h[2] % 100 >= settings.percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < settings.spm_percent:
        return "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars (code points), output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        repeated = regex.compile(f"({settings.unit})*", regex.V1)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                rows = []
                for doc_id, text in zip(ids.slice(a, b - a).to_pylist(), texts[a:b], strict=True):
                    text = text or ""
                    match = repeated.fullmatch(text)
                    if match is None:
                        rows.append((doc_id, None, "plain", None, None, text))
                        continue
                    ends = match.ends(1)
                    rows.append((doc_id, len(ends), *cut(text, ends, draws(doc_id, settings.seed), settings)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(trimming(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def after(text: Column, mark: str) -> Column:
    """What follows the first mark."""
    return F.substring(text, F.instr(text, mark) + len(mark), F.length(text))


def restored(form: Column, output: Column) -> Column:
    """The exact text, from an output and its form alone."""
    body, last = after(output, PREFIX), after(output, SUFFIX)
    psm = F.concat(F.substring_index(body, SUFFIX, 1), after(last, MIDDLE), F.substring_index(last, MIDDLE, 1))
    spm = F.concat(F.substring_index(body, MIDDLE, 1), after(body, MIDDLE), F.substring_index(last, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
