"""Operator 12: vector codes. Each of PARTS consecutive parts of a vector becomes the number of the nearest entry of that part's codebook.

Vectors are dealt into blocks as they are read, and a block has a metric tree (`anchors.py`) over each part. The trees are written once; a
round goes down them with the codebooks, and only sums and counts of entries, some thousand numbers a task, are added up by Spark. The
last pass gives each vector its codes where it lies, without a shuffle.

Numbers: a component x becomes floor(256 * x), exactly. Components beyond a bound that follows the width (over 500,000 at 64) are taken as the
bound, so squared errors fit in 64 bits.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; a length that is no multiple of PARTS is filled up with
zeros, an empty vector to PARTS of them; vectors of each length so filled have codebooks of their own; with fewer vectors than
ENTRIES, codebooks have as many entries as there are vectors; equal entries: only the first is used; rows with the same vec_id are
ordered by their vectors, and null ones come last; labels may be null; a sum of errors beyond 64 bits is null; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Tree, codes, grown, totals
from .shared import trimming, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a block.
BLOCK = 4096


def whole(flat: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """(n, width) whole numbers of vectors that lie one after another."""
    bound = int((2.0**62 / width) ** 0.5) // 2
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = np.clip(np.floor(flat * 256.0), -bound, bound).astype(np.int64)
    return out


def in_blocks(kept: DataFrame, width: int) -> DataFrame:
    """(vec_id, label: lists of the rows of a block; trees: one for each part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                ids, labels, e = batch.slice(a, BLOCK).columns
                own = whole(e.flatten().to_numpy(zero_copy_only=False), np.diff(e.offsets.to_numpy()), width)
                trees = [grown(part).to_bytes() for part in np.split(own, PARTS, axis=1)]
                yield pa.record_batch([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([labels.to_pylist()], pa.list_(pa.string())), pa.array([trees], pa.list_(pa.binary()))], ["vec_id", "label", "trees"])

    return written(kept.where(F.col("width") == width).select("vec_id", "label", "e").mapInArrow(trimming(run), "vec_id array<long>, label array<string>, trees array<binary>"))


def refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, place) after a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, raw in enumerate(trees.as_py()):
                    s, n = totals(Tree.from_bytes(raw), books[p])
                    sums[p] += s
                    counts[p] += n
        both = np.concatenate([sums, counts[:, :, None]], axis=2)
        p, entry, place = np.nonzero(both)
        yield pa.record_batch([pa.array(p), pa.array(entry), pa.array(place), pa.array(both[p, entry, place])], ["part", "entry", "place", "total"])

    found = blocks.select("trees").mapInArrow(trimming(run), "part long, entry long, place long, total long")
    both = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():  # PARTS x ENTRIES x (places + 1) rows at most
        both[r["part"], r["entry"], r["place"]] = r["total"]
    sums, counts = both[:, :, :-1], both[:, :, -1:]
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [codes(Tree.from_bytes(raw), book) for raw, book in zip(batch.column(2)[k].as_py(), books, strict=True)]
                shown = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                text = shown.tobytes().hex()
                error = sum(e for _, e in found)
                step = 2 * PARTS
                yield pa.record_batch([batch.column(0)[k].values, batch.column(1)[k].values, pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.select("vec_id", "label", "trees").mapInArrow(trimming(run), "vec_id long, label string, code string, error long")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Per kept row of vectors (vec_id, label, embedding): vec_id, code, error, label_error, codebooks_sha256."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = vectors.where(F.col("embedding").isNotNull()).where(finite)
    width = F.greatest(F.lit(PARTS), (F.ceil(F.size(e) / PARTS) * PARTS).cast("int"))
    kept = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.alias("e"), width.alias("width"))
    out = None
    for w in sorted(r[0] for r in kept.select("width").distinct().collect()):
        first = kept.where(F.col("width") == w).orderBy(F.asc_nulls_last("vec_id"), "e").limit(ENTRIES).collect()
        start = whole(np.concatenate([r["e"] for r in first]), np.array([len(r["e"]) for r in first]), w)
        books = np.stack(np.split(start, PARTS, axis=1))
        blocks = in_blocks(kept, w)
        for _ in range(ROUNDS):
            books = refined(blocks, books)
        digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
        own = written(coded(blocks, books)).withColumn("codebooks_sha256", F.lit(digest))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    by_label = out.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return out.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
