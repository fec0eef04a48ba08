"""Two readings of one document: character edits, and units of one reading laid on pages of the other with what they don't cover."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.edits import applied, code_points, edit_script, undone
from docquarry.sources.intermediate import written

#: Characters of a gram, the share of the most hits that a page needs, and the share of missing characters that is faithful.
GRAM, NEAR, FAITHFUL = 6, 0.8, 0.001
EDITS = "array<struct<op: string, start: long, end: long, old: string, new: string>>"
EDITS_TYPE = pa.list_(pa.struct([("op", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("old", pa.string()), ("new", pa.string())]))


def with_edits(rows: DataFrame, before: str, after: str) -> DataFrame:
    """rows with edits: what makes the text `after` of `before` (null texts are empty), with what was there."""
    position = rows.columns.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(position(before)).to_pylist(), batch.column(position(after)).to_pylist(), strict=True):
                out.append([{"op": op, "start": i, "end": j, "old": (a or "")[i:j], "new": new} for op, i, j, new in edit_script(a or "", b or "")])
            yield pa.record_batch([*batch.columns, pa.array(out, EDITS_TYPE)], [*batch.schema.names, "edits"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", edits {EDITS}")


def remade(rows: DataFrame, text: str, edits: str, forward: bool, name: str) -> DataFrame:
    """rows with `name`: the other text, made of one by the edits, forward or back."""
    position = rows.columns.index

    def other(t: str, script: list[dict]) -> str:
        if forward:
            return applied(t, [(x["op"], x["start"], x["end"], x["new"]) for x in script])
        moved, parts = 0, []
        for x in script:
            start = x["start"] + moved
            parts.append((start, start + len(x["new"]), x["old"]))
            moved += len(x["new"]) - len(x["old"])
        return undone(t, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [other(t or "", x) for t, x in zip(batch.column(position(text)).to_pylist(), batch.column(position(edits)).to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{name}` string")


def lists_of(units: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, units, read): both readings of a document in one row, in order."""
    own = units.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*[c for c in units.columns if c != "doc"]))).alias("units"))
    read = pages.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("read"))
    return own.join(read, "doc", "left").select("doc", "units", "read")


def gram_numbers(points: np.ndarray) -> np.ndarray:
    """A number for the run of GRAM code points from each place; equal runs have equal numbers."""
    if len(points) < GRAM:
        return np.zeros(0, np.int64)
    names, own = np.unique(points, return_inverse=True)
    width = max(1, int(len(names) - 1).bit_length())
    own, n = own.astype(np.int64), len(points) - GRAM + 1
    if width * GRAM > 62:  # three at a time, numbered anew
        threes = (own[:-2] << (2 * width)) | (own[1:-1] << width) | own[2:]
        threes = np.unique(threes, return_inverse=True)[1].astype(np.int64)
        return (threes[:n] << 31) | threes[3 : 3 + n]
    out = np.zeros(n, np.int64)
    for k in range(GRAM):
        out = (out << width) | own[k : k + n]
    return out


def of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number, text) of each run of GRAM characters that lies within one of the texts, by the same numbers for all texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    numbers = gram_numbers(code_points("".join(texts)))
    inside = own[: len(numbers)] == own[GRAM - 1 :] if len(numbers) else np.zeros(0, bool)
    return numbers[inside], own[: len(numbers)][inside]


def best_pages(units: list[str], pages: dict[int, str]) -> list[list[int]]:
    """For each unit the pages with NEAR of the hits of its best one, by distinct runs of GRAM characters."""
    names = list(pages)
    numbers, text = of_texts([*units, *pages.values()])
    kinds, numbers = np.unique(numbers, return_inverse=True)
    keys = np.unique(text * max(1, len(kinds)) + numbers)  # each run of a text once
    text, numbers = keys // max(1, len(kinds)), keys % max(1, len(kinds))
    split = np.searchsorted(text, len(units))
    page, number = text[split:] - len(units), numbers[split:]
    order = np.argsort(number, kind="stable")
    page, number = page[order], number[order]
    low, high = np.searchsorted(number, numbers[:split]), np.searchsorted(number, numbers[:split], side="right")
    many = high - low
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    met, hits = np.unique(np.repeat(text[:split], many) * max(1, len(names)) + page[at], return_counts=True)
    found: list[dict[int, int]] = [{} for _ in units]
    for k, n in zip(met.tolist(), hits.tolist(), strict=True):
        found[k // len(names)][names[k % len(names)]] = n
    out = []
    for text, own in zip(units, found, strict=True):
        if len(text) < GRAM:
            own = {page: 1 for page, t in pages.items() if text in t}
        top = max(own.values(), default=0)
        out.append(sorted(page for page, n in own.items() if n >= NEAR * top))
    return out


def aligned(units: DataFrame, pages: DataFrame) -> DataFrame:
    """units (doc, unit, text) with pages: the pages (doc, page, text) that each may stand on, in order.

    A unit's candidates have NEAR of the hits of its best page, by distinct runs of GRAM characters; a shorter unit's are the pages that hold it.
    A unit with one candidate is an anchor, and others keep candidates no further than a page beyond the anchors before and after
    them, or all if that leaves none. A task indexes one document's pages at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, own, read in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                good = best_pages([u["text"] for u in own], {p["page"]: p["text"] for p in read or ()})
                columns = ([doc] * len(own), [u["unit"] for u in own], [u["text"] for u in own], good)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.int32())), strict=True)], ["doc", "unit", "text", "good"])

    doc = dict(units.dtypes)["doc"]
    found = lists_of(units, pages).mapInArrow(run, f"doc {doc}, unit int, text string, good array<int>")
    ends = pages.groupBy("doc").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    laid = found.join(ends, "doc", "left")
    order = Window.partitionBy("doc").orderBy("unit")
    anchor = F.when(F.size("good") == 1, F.col("good")[0])
    before = F.coalesce(F.last(anchor, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("first"))
    after = F.coalesce(F.first(anchor, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), F.col("last"))
    bound = laid.withColumns({"low": F.least(before, after) - 1, "high": F.greatest(before, after) + 1})
    near = F.filter("good", lambda p: p.between(F.col("low"), F.col("high")))
    return bound.withColumn("near", near).select("doc", "unit", "text", F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("good")).alias("pages"))


def longest_unused(piece: np.ndarray, text: np.ndarray, used: np.ndarray, starts: np.ndarray) -> tuple[int, int]:
    """(characters, where) of the longest beginning of piece in what is unused of text, from one of the starts; of equal ones the first."""
    best, where = 0, -1
    for c in starts.tolist():
        n = min(len(piece), len(text) - c)
        if n <= best or used[c + best]:
            continue
        wrong = np.flatnonzero((text[c : c + n] != piece[:n]) | used[c : c + n])
        size = int(wrong[0]) if len(wrong) else n
        if size > best:
            best, where = size, c
    return best, where


def consumed(units: list[tuple[str, int, int]], text: str) -> list[list[tuple[int, int]]]:
    """For each unit (its text, and the bounds of the window in text in which it may stand), in order, the stretches [start, end) that no unused part of
    the window has. From each place the longest match of at least GRAM characters, or all that is left of a shorter rest, is taken
    and used up, so one copy in the text cannot stand for two units."""
    hay, used = code_points(text), np.zeros(len(text), bool)
    # runs of the units and of the text by one numbering, and where each number stands in the text
    joined = "".join(unit for unit, _, _ in units)
    numbers = gram_numbers(np.concatenate([hay, code_points(joined)]))
    kinds, numbers = np.unique(numbers, return_inverse=True)
    own_hay = numbers[: max(0, len(text) - GRAM + 1)]
    order = np.argsort(own_hay, kind="stable")
    ends = np.searchsorted(own_hay[order], np.arange(len(kinds) + 1))
    begin = len(text)
    out = []
    for unit, low, high in units:
        own, missing, i = code_points(unit), [], 0
        while i < len(unit):
            rest = len(unit) - i
            if rest >= GRAM:
                number = numbers[begin + i]
                starts = order[ends[number] : ends[number + 1]]
                starts = starts[np.searchsorted(starts, low) : np.searchsorted(starts, high - GRAM, side="right")]
            else:
                found, k = [], text.find(unit[i:], low, high)
                while k >= 0:
                    found.append(k)
                    k = text.find(unit[i:], k + 1, high)
                starts = np.array(found, np.int64)
            size, where = longest_unused(own[i:], hay[:high], used, starts)
            if size >= min(GRAM, rest) and size:
                used[where : where + size] = True
                i += size
                continue
            if missing and missing[-1][1] == i:
                missing[-1] = (missing[-1][0], i + 1)
            else:
                missing.append((i, i + 1))
            i += 1
        out.append(missing)
        begin += len(unit)
    return out


def fidelity(units: DataFrame, pages: DataFrame) -> DataFrame:
    """Per doc of units (doc, unit, text) against pages (doc, page, text): n_units, chars, missing (characters), stretches, digits (stretches that
    hold one), verdict: faithful (few characters missing and no digit), edges (missing only where units begin or end, no digit), or review.
    A unit may stand on its pages and the ones beside them. Texts are compared without white space; a task holds single documents."""
    squash = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    own = units.select("doc", "unit", squash("text").alias("text")).where("text <> ''")
    read = written(pages.select("doc", F.col("page").cast("int").alias("page"), squash("text").alias("text")))  # read three times
    placed = lists_of(aligned(own, read), read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, units, read in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start, at = {}, 0
                for p in read or ():
                    start[p["page"]] = at
                    at += len(p["text"])
                numbers = sorted(start)
                ends = {p: start[q] for p, q in zip(numbers, numbers[1:], strict=False)} | ({numbers[-1]: at} if numbers else {})
                wanted = []
                for u in units:
                    around = [q for p in u["pages"] for q in (p - 1, p, p + 1) if q in start]
                    wanted.append((u["text"], start[min(around)], ends[max(around)]) if around else (u["text"], 0, 0))
                found = consumed(wanted, "".join(p["text"] for p in read or ()))
                stretches = [(t, a, b) for (t, _, _), own in zip(wanted, found, strict=True) for a, b in own]
                missing, chars = sum(b - a for _, a, b in stretches), sum(len(t) for t, _, _ in wanted)
                digits = sum(any(c.isdigit() for c in t[a:b]) for t, a, b in stretches)
                edges = all(a == 0 or b == len(t) for t, a, b in stretches)
                verdict = "review" if digits else "faithful" if missing <= FAITHFUL * chars else "edges" if edges else "review"
                rows.append((doc, len(wanted), chars, missing, len(stretches), digits, verdict))
            kinds = (batch.schema.field(0).type, *[pa.int64()] * 5, pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc", "n_units", "chars", "missing", "stretches", "digits", "verdict"])

    kind = dict(units.dtypes)["doc"]
    return placed.mapInArrow(run, f"doc {kind}, n_units long, chars long, missing long, stretches long, digits long, verdict string")
