"""Operator 2: best-fit packing, planned on the histogram of lengths.

Documents become pieces of at most `capacity` tokens. The plan needs only how many pieces have each length: at most `capacity` numbers
reach the driver, which places lengths in falling order, each into the fullest open sequences that still take it. Equal sequences are
kept as one group, so the plan stays at some thousand rows for any number of documents. Pieces then take the planned slots by
joining on their rank within their length. Ranks are counted in blocks of a length, so a very common length is not one task's work.

Defined cases: a null or empty text is its end id alone; repeated rows are each packed; a null doc_id stays null; an empty table gives
no pieces; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import encoder
from .records import encode_documents
from .shared import trimming, written

#: Pieces of one length that a rank block has at most, about; blocks are never fewer than LEAST_BLOCKS.
BLOCK_ROWS, LEAST_BLOCKS = 200_000, 256


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long[, ids binary]); of a longer document the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).dtype
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    own = ids[a:b].tobytes()
                    for column, value in zip(rows, (key, k, a, b - a, zlib.crc32(own), own), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            n = 6 if with_ids else 5
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows[:n], kinds[:n], strict=True)], list(names[:n]))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return encode_documents(docs, tokenizer, end_id).mapInArrow(trimming(run), schema)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, first_sequence, offset): the pieces of a length with ranks from rank_from to before rank_to
    go one each to the sequences from first_sequence on, at offset."""
    plan, rooms, groups, made = [], [], {}, 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(rooms, room)
            groups.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
                m = min(n, left)
                plan.append((length, rank, rank + m, first, capacity - room))
                add(room - length, first, m)
                add(room, first + m, n - m)
                rank, left = rank + m, left - m
            else:  # new sequences, each filled with this length while it fits
                each = capacity // length
                full, rest = divmod(left, each)
                for k in range(min(each, left)):
                    m = full + (k < rest)
                    plan.append((length, rank, rank + m, made, k * length))
                    rank += m
                add(capacity - each * length, made, full)
                add(capacity - rest * length, made + full, 1 if rest else 0)
                made, left = made + full + (rest > 0), 0
    return plan


def pack(pieces: DataFrame, capacity: int, blocks: int | None = None) -> DataFrame:
    """pieces (a written table: it is read more than once) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    blocks = blocks or max(LEAST_BLOCKS, sum(counts.values()) // BLOCK_ROWS)
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), "length long, rank_from long, rank_to long, first_sequence long, at long")
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    slot = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & slot)  # some thousand rows
    return placed.select(*pieces.columns, (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), F.col("at").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of docs with their places: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(written(cut_pieces(docs, tokenizer, capacity, end_id, with_ids)), capacity)
