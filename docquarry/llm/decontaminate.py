"""Operator 13: benchmark decontamination by an FM-index of each training shard.

A shard is a slice of whole documents that one task holds at a time; its words become symbols and its FM-index (`fmindex.py`) is searched
for all test phrases at once, backward through wavelet ranks. Occurrences are located by sampled suffix positions, their words are marked, and
runs of marked words are the spans to remove. A phrase is each window of consecutive words of an item; an item with fewer words is one
phrase. The alphabet is the words of the phrases; runs of other words, which no phrase can hold, are one terminator each, and so are ends
of documents.

Items with the same words are one class, so copies of an item cost a phrase only once. Phrases travel to the tasks in groups of some
GROUP_WORDS words, a bound of what is broadcast; where the items have more, each group is searched in a pass of its own, and hits of a document are merged.

Defined cases: null and empty texts have no words, and such items occur nowhere; a null item_id is shown as an empty text; rows with
the same item_id count as one item; rows of documents with the same doc_id, or none, are each a row of the result; empty tables give no rows, or
rows without hits; extra columns are ignored. A text is never cut, so a shard holds one text at least, and a group one item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import in_slices
from .fmindex import FMIndex
from .shared import give_back, written

WINDOW = 10
#: Characters of a shard, about, and words of a group of phrases, about.
SHARD_CHARS, GROUP_WORDS = 3_000_000, 500_000
#: Bytes of words, lower-cased; all others become a space. Bytes of characters beyond ASCII are bytes of words.
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile("[^\\x00-/:-@\\[-`{-\\x7f]+")
SPANS = "array<struct<word: long, words: long, start: long, end: long>>"
SPANS_TYPE = pa.list_(pa.struct([(x, pa.int64()) for x in ("word", "words", "start", "end")]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()


@dataclass(frozen=True)
class Phrases:
    """Windows of items: symbols of words, windows (padded with zeros) and their sizes, and the classes of each window."""

    symbols: dict[bytes, int]
    windows: np.ndarray
    sizes: np.ndarray
    classes: np.ndarray  # of all windows, one after another
    begin: np.ndarray  # where those of a window begin
    items: list[tuple[str, ...]]  # ids of a class


def phrases_of(rows: list[tuple[str, str]], window: int) -> Phrases:
    """rows: (item_id as text, text)."""
    symbols: dict[bytes, int] = {}
    items: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in rows:
        own = tuple(symbols.setdefault(w, len(symbols) + 1) for w in words_of(text))
        if own:
            items.setdefault(own, set()).add(item_id)
    found: dict[tuple[int, ...], dict[int, None]] = {}
    for k, own in enumerate(items):
        for a in range(max(1, len(own) - window + 1)):
            found.setdefault(own[a : a + window], {})[k] = None
    windows = np.zeros((len(found), window), np.int32)
    for k, own in enumerate(found):
        windows[k, : len(own)] = own
    held = [np.fromiter(x, np.int32, len(x)) for x in found.values()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    classes = np.concatenate(held) if held else np.zeros(0, np.int32)
    return Phrases(symbols, windows, sizes, classes, np.append(0, np.cumsum([len(x) for x in held])).astype(np.int64), [tuple(sorted(x)) for x in items.values()])


def repeated(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (counts[i] numbers) for each i."""
    ends = np.cumsum(counts)
    return np.repeat(first - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def searched(texts: list[str | None], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n_words of each text; text and class of each pair found; first word and number of words of each run of hit words, over all texts)."""
    symbols, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = words_of(text)
        counts[k] = len(own)
        symbols.append(np.fromiter(map(phrases.symbols.get, own, repeat(0)), np.int32, len(own)))
    word = np.concatenate(symbols) if symbols else np.zeros(0, np.int32)
    ends = np.cumsum(counts)
    none = np.zeros(0, np.int64)
    if not len(phrases.sizes) or not word.any():
        return counts, none, none, none, none
    known = np.flatnonzero(word)
    owner = np.repeat(np.arange(len(texts)), counts)[known]
    cut = np.append(np.diff(known) > 1, True) | np.append(owner[1:] != owner[:-1], True)  # a terminator follows
    at = np.arange(len(known)) + np.append(0, np.cumsum(cut)[:-1])
    text = np.zeros(len(known) + int(cut.sum()), np.int32)
    text[at] = word[known]
    where = np.zeros(len(text), np.int64)
    where[at] = known
    index = FMIndex(text, len(phrases.symbols))
    low, high = index.find(phrases.windows, phrases.sizes)
    met = np.flatnonzero(low < high)
    if not len(met):
        return counts, none, none, none, none
    phrase = np.repeat(met, high[met] - low[met])
    start = where[index.locate(repeated(low[met], high[met] - low[met]))]
    change = np.bincount(start, minlength=len(word) + 1) - np.bincount(start + phrases.sizes[phrase], minlength=len(word) + 1)
    hit = np.cumsum(change) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    first, last = edge[::2], edge[1::2]
    for e in ends[:-1][hit[ends[:-1]] & hit[np.maximum(ends[:-1] - 1, 0)] & (ends[:-1] > 0)] if len(ends) > 1 else ():
        first, last = np.append(first, e), np.append(last, e)  # runs of two texts that touch
    first, last = np.unique(first), np.unique(last)
    pair = np.unique(np.searchsorted(ends, start, side="right") * len(phrases.sizes) + phrase)
    doc, phrase = pair // len(phrases.sizes), pair % len(phrases.sizes)
    each = phrases.begin[phrase + 1] - phrases.begin[phrase]
    pair = np.unique(np.repeat(doc, each) * len(phrases.items) + phrases.classes[repeated(phrases.begin[phrase], each)])
    return counts, pair // len(phrases.items), pair % len(phrases.items), first, last - first


def marked(rows: DataFrame, phrases: Phrases) -> DataFrame:
    """rows (doc_id, text, ...) with n_words, spans and items for the text."""
    sent = rows.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for batch in batches:
            for a, b in in_slices(batch.column(1).to_pylist(), SHARD_CHARS):
                part = batch.slice(a, b - a)
                texts = part.column(1).to_pylist()
                counts, doc, own, first, size = searched(texts, phrases)
                spans, items = [[] for _ in texts], [set() for _ in texts]
                for k, c in zip(doc.tolist(), own.tolist(), strict=True):
                    items[k].update(phrases.items[c])
                ends = np.cumsum(counts)
                holder = np.searchsorted(ends, first, side="right")
                for k in np.unique(holder).tolist():
                    at = [m.span() for m in WORD.finditer(texts[k])]
                    for i in np.flatnonzero(holder == k).tolist():
                        w, n = int(first[i] - ends[k] + counts[k]), int(size[i])
                        spans[k].append({"word": w, "words": n, "start": at[w][0], "end": at[w + n - 1][1]})
                yield pa.record_batch(
                    [*part.columns, pa.array(counts), pa.array(spans, SPANS_TYPE), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    [*part.schema.names, "n_words", "spans", "items"],
                )
            give_back()

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + f", n_words long, spans {SPANS}, items array<string>")


def joined(spans: list[dict]) -> list[dict]:
    """Spans of several passes, those that overlap or follow one another word by word as one."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: x["word"]):
        if out and x["word"] <= (end := out[-1]["word"] + out[-1]["words"]):
            out[-1] = out[-1] | {"words": max(end, x["word"] + x["words"]) - out[-1]["word"], "end": max(out[-1]["end"], x["end"])}
        else:
            out.append(x)
    return out


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_words, spans, items) from the lists of several passes."""
    for batch in batches:
        row, n_words, spans, items = batch.columns
        yield pa.record_batch([row, n_words, pa.array([joined(x) for x in spans.to_pylist()], SPANS_TYPE), pa.array([sorted(set(x)) for x in items.to_pylist()], pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text, n_words, spans (first word, number of words, start and end in code points) and items (ids as
    sorted text). items: (item_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rough = F.coalesce(F.floor(F.length("text") / 4), F.lit(0))  # words, about
    known = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    groups = max(1, -(-(known.agg(F.sum(rough)).first()[0] or 0) // group_words))
    in_group = lambda k: phrases_of([tuple(r) for r in known.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == k).collect()], window)
    if groups == 1:
        return marked(own, in_group(0))
    rows = written(own.withColumn("row", F.monotonically_increasing_id()))
    found = None
    for k in range(groups):
        hits = written(marked(rows, in_group(k)).select("row", "n_words", "spans", "items").where(F.lit(k == 0) | (F.size("spans") > 0)))
        found = hits if found is None else found.unionByName(hits)
    by_row = found.groupBy("row").agg(F.max("n_words"), F.flatten(F.collect_list("spans")), F.flatten(F.collect_list("items")))
    by_row = by_row.mapInArrow(merged, f"row long, n_words long, spans {SPANS}, items array<string>")
    return rows.join(by_row, "row").select("doc_id", "text", "n_words", "spans", "items")


def without_spans(marked_rows: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of `contamination` without their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, spans in enumerate(batch.column(2).to_pylist()):
                if spans:
                    bounds = zip([0, *(x["end"] for x in spans)], [*(x["start"] for x in spans), None], strict=True)
                    texts[k] = "".join(texts[k][a:b] for a, b in bounds)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return marked_rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")
