"""Operator 5: document fingerprints by winnowing.

Every run of GRAM characters has a rolling hash. Of each window of WINDOW consecutive hashes the smallest is selected, the rightmost
of equal ones, and its position is kept. So two texts that share a passage of GRAM + WINDOW - 1 characters share a selected hash,
and positions of selections are at most WINDOW apart. A fingerprint is the base64 text of all selections of the whole document: 4 bytes
of hash and one byte of distance from the selection before. Likeness is the Dice coefficient of the two sets of selected hashes.

To set each document beside the next one by doc_id, rows are dealt into ranges of ids; the first document of a range is also sent to
the range before, so the text moves once and no task sees more than some ranges, as a stream.

Defined cases: a null or empty text has an empty fingerprint, and two of them are fully alike (1.0), an empty and another not at all;
a text shorter than GRAM is one gram; rows without doc_id come first; rows with the same doc_id follow one another by text; a lone
document is its own next one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import in_slices
from .shared import trimming

GRAM, WINDOW = 16, 48  # GRAM is a power of two; a distance fits in a byte
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LOW = np.uint64(0xFFFFFFFF)
#: Rows of a range, at least, and ranges at most, about: the range starts are all that the driver learns of the ids.
RANGE_ROWS, MOST_RANGES = 200, 50_000


def mixed(x: np.ndarray) -> np.ndarray:
    """32 well-mixed bits, in the upper half."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    return (x ^ (x >> np.uint64(29))) * BASE & ~LOW


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """At i, the least of x[i : i + width] (of what is there, near the end)."""
    have, n = 1, len(x)
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: n - step], x[step:]) if step < n else x[:0]
        n, have = len(x), have + step
    return x


def selections(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the selected 32-bit hashes and their positions."""
    empty = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    out = [empty] * len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        for k in np.flatnonzero((size > 0) & (size < GRAM)):
            h = np.uint64(size[k])
            for c in code[first[k] : first[k] + size[k]]:
                h = h * BASE + c
            out[k] = ((mixed(np.array([h])) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64))
        full = np.flatnonzero(size >= GRAM)
        if not len(full):
            return out
        h, have, power = code + np.uint64(1), 1, BASE
        while have < GRAM:  # hashes of twice as many characters from two halves
            h = h[: len(h) - have] * power + h[have:]
            have, power = 2 * have, power * power
        key = mixed(h) | (LOW - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost is least
    grams = size[full] - GRAM + 1
    least = sliding_least(key, WINDOW)
    windows = np.maximum(grams - WINDOW + 1, 0)
    at = np.repeat(first[full] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    chosen, owner = least[at], np.repeat(full, windows)
    short = full[grams < WINDOW]  # all grams are one window
    if len(short):
        spans = np.stack([first[short], first[short] + size[short] - GRAM + 1], axis=1).reshape(-1)
        padded = np.append(key, ~np.uint64(0))
        chosen = np.concatenate([chosen, np.minimum.reduceat(padded, spans)[::2]])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        chosen, owner = chosen[order], owner[order]
    new = np.append(True, chosen[1:] != chosen[:-1])
    chosen, owner = chosen[new], owner[new]
    hashes, places = (chosen >> np.uint64(32)).astype(np.uint32), (LOW - (chosen & LOW)).astype(np.int64) - first[owner]
    ends = np.searchsorted(owner, full, side="right").tolist()
    for k, a, b in zip(full.tolist(), [0, *ends[:-1]], ends, strict=True):
        out[k] = (hashes[a:b], places[a:b])
    return out


def shown(selected: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint as text."""
    hashes, places = selected
    packed = np.zeros((len(hashes), 5), np.uint8)
    packed[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    packed[:, 4] = np.diff(places, prepend=0)
    return base64.b64encode(packed.tobytes()).decode()


def read_fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 5)
    return np.ascontiguousarray(packed[:, :4]).view(">u4")[:, 0].astype(np.uint32), np.cumsum(packed[:, 4].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two sets of hashes, each sorted and distinct."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    return 2 * int((both[1:] == both[:-1]).sum()) / len(both)


def edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_ranges(docs: DataFrame) -> DataFrame:
    """(span, tail, key, text): spans are ranges of ids; rows with tail are copies of the next span's first id."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    stride = max(RANGE_ROWS, keyed.count() // MOST_RANGES)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(range(-seen % stride, batch.num_rows, stride), pa.int64()))
            seen += batch.num_rows

    found = keyed.select("key").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(starts, "key long")
    bounds = spark.sparkContext.broadcast(np.array(sorted({r[0] for r in found.collect()}), np.int64))
    spans = len(bounds.value)

    @F.pandas_udf("long")
    def place(key: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds.value, key.to_numpy(), side="right") - 1
        return pd.Series(2 * at + (bounds.value[at] == key.to_numpy()))

    span = F.shiftright("place", 1)
    here, before = F.struct(span.alias("span"), F.lit(False).alias("tail")), F.struct(F.pmod(span - 1, F.lit(max(spans, 1))).alias("span"), F.lit(True).alias("tail"))
    targets = F.when(F.col("place") % 2 == 1, F.array(here, before)).otherwise(F.array(here))
    return keyed.withColumn("place", place("key")).select(F.explode(targets).alias("to"), "key", "text").select("to.span", "to.tail", "key", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its last
    quarter of characters replaced by the first as many of the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: (span, tail, key, text, selected, sorted hashes)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_slices(texts, 2_000_000):
                part = batch.slice(a, b - a)
                own = selections(texts[a:b])
                rows = list(zip(part.column("span").to_pylist(), part.column("tail").to_pylist(), part.column("key").to_pylist(), texts[a:b], own, [np.unique(s[0]) for s in own], strict=True))
                if held:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if not x[1] and x[0] == y[0]]
                changed = [edited(x[3], y[3]) for x, y in pairs]
                others = selections(changed)
                yield pa.record_batch(
                    [
                        pa.array([x[2] if x[2] > -(1 << 63) else None for x, _ in pairs], pa.int64()),
                        pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                        pa.array([shown(x[4]) for x, _ in pairs], pa.string()),
                        pa.array([shown(s) for s in others], pa.string()),
                        pa.array([likeness(x[5], np.unique(s[0])) for (x, _), s in zip(pairs, others, strict=True)], pa.float64()),
                        pa.array([likeness(x[5], y[5]) for x, y in pairs], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_ranges(docs).repartition("span").sortWithinPartitions("span", "tail", "key", "text").mapInArrow(trimming(run), schema)
