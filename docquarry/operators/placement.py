"""Where fragments and quotes stand in a text: fragments by anchors that occur once, quotes by their rows and pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.edits import ANCHORS, code_points, rising

#: White space that quotes are compared without.
SPACES = [9, 10, 13, 32]
NO_SPACE = dict.fromkeys(SPACES)
PLACED = "array<struct<at: int, size: int, place: long, kept: boolean>>"
PLACED_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("place", pa.int64()), ("kept", pa.bool_())]))


def heads_once(text: str, fragments: list[str], sizes: tuple[int, ...] = ANCHORS) -> list[tuple[int, int] | None]:
    """For each fragment (size, place): the longest head of one of the sizes that the text has exactly once, and where; None if none is, or the fragment is
    shorter than all sizes. Heads of a size are looked up in one pass over the text."""
    out: list[tuple[int, int] | None] = [None] * len(fragments)
    for size in sizes:
        wanted = {f[:size] for f, known in zip(fragments, out, strict=True) if known is None and len(f) >= size}
        if not wanted:
            continue
        seen: dict[str, int] = {}
        for k in range(len(text) - size + 1):
            if (run := text[k : k + size]) in wanted:
                seen[run] = -1 if run in seen else k
        for i, f in enumerate(fragments):
            if out[i] is None and len(f) >= size and seen.get(f[:size], -1) >= 0:
                out[i] = (size, seen[f[:size]])
    return out


def placed(rows: DataFrame, text: str, fragments: str) -> DataFrame:
    """rows with placed: for each fragment of a list that has an anchor, its number, the anchor's size, its place in the text, and whether it is
    kept: places that don't rise with the fragments' order, but for the longest rising part, are mistakes or moves."""
    position = rows.columns.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, own in zip(batch.column(position(text)).to_pylist(), batch.column(position(fragments)).to_pylist(), strict=True):
                found = [(k, *x) for k, x in enumerate(heads_once(t or "", [f or "" for f in own or ()])) if x]
                kept = {k for k, _ in rising([(k, place) for k, _, place in found])}
                out.append([{"at": k, "size": size, "place": place, "kept": k in kept} for k, size, place in found])
            yield pa.record_batch([*batch.columns, pa.array(out, PLACED_TYPE)], [*batch.schema.names, "placed"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", placed {PLACED}")


def quote_places(rows: DataFrame, text: str, quote: str, page: int) -> DataFrame:
    """rows with verdict, start, end, first_row, last_row, first_page, last_page: where a quote stands in its text, white space apart.

    One place within a row (a line) is row, one that crosses line ends is across; several give the first one and the verdict repeated; no place is missing, a
    quote of white space is empty. start and end count the text's own characters; pages hold `page` characters."""
    position = rows.columns.index
    names = ("start", "end", "first_row", "last_row", "first_page", "last_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, numbers = [], []
            for t, q in zip(batch.column(position(text)).to_pylist(), batch.column(position(quote)).to_pylist(), strict=True):
                t, needle = t or "", (q or "").translate(NO_SPACE)
                hay = t.translate(NO_SPACE)
                first = hay.find(needle) if needle else -1
                if first < 0:
                    verdicts.append("missing" if needle else "empty")
                    numbers.append((None,) * 6)
                    continue
                own = np.flatnonzero(~np.isin(code_points(t), SPACES))  # where each character of hay stands in t
                start, end = int(own[first]), int(own[first + len(needle) - 1]) + 1
                above = t.count("\n", 0, start)
                below = above + t.count("\n", start, end)
                verdicts.append("repeated" if hay.find(needle, first + 1) >= 0 else "row" if above == below else "across")
                numbers.append((start, end, above, below, start // page, (end - 1) // page))
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)] if numbers else [pa.array([], pa.int64())] * 6
            yield pa.record_batch([*batch.columns, pa.array(verdicts, pa.string()), *columns], [*batch.schema.names, "verdict", *names])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", verdict string, " + ", ".join(f"{n} long" for n in names))
