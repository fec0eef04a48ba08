"""Operator 10: language-model scores by deleted interpolation.

P(w | h) mixes three estimates: count(h, w) / count(h), count(w) / all tokens, and 1 / (distinct tokens + 1). The mixture weights
depend on how often the context h was seen (one bucket for each doubling). They are learned by expectation-maximisation on held-out
counts: each occurrence in the training texts is deleted in turn, so its own count is not there when it is predicted.

Texts are read once and kept as blocks of some thousand documents: token numbers and the hashes of the block's distinct words. For
each key (a word or a pair) that occurs in a block, the block sends its key and its training count to the bucket of the key's hash.
A bucket adds up the counts and answers each block in the order in which it asked; the number of buckets follows the number of tokens, so
that a bucket stays small. Words are told apart by 64 bits of hash and pairs by 48 bits and those of the bucket: two pairs of one
bucket with equal hashes would share a count. So a frequent pair is one row of each block,
nothing grows with the square of anything, and no task holds the model. Blocks and answers lie in tables bucketed by block, so they
meet without a further shuffle. The weights are fitted on a histogram of the estimates, whose size is bounded.

Defined cases: a null or empty text is its end token alone; a row without doc_id is a training text; repeated rows are each learned
from and scored; without any training text every count is zero; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_of_id, shared_folder, trimming, written

BLOCK_CHARS = 4_000_000
END = b"\n"  # no word: the end of a text, and the context of its first word
LEVELS = 40  # context-frequency buckets
STEPS = 4  # histogram steps for each doubling
PAIR_BYTES = 6  # of a pair's hash, besides the bits that chose its bucket
#: Bytes of keys and counts in a bucket, at most, if no block repeats a key.
BUCKET_BYTES = 8_000_000
BLOCK = "block long, doc_ids array<long>, held array<boolean>, ends binary, tokens binary, words binary"


def build_blocks(docs: DataFrame, held_out: F.Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        part, made = TaskContext.get().partitionId(), count()
        ids, held, tokens, ends, chars, index = [], [], [], [], 0, defaultdict()
        index.default_factory = index.__len__

        def flush() -> pa.RecordBatch:
            words = np.array([xxh64_intdigest(w) for w in index], np.uint64)
            row = [[part << 24 | next(made)], [ids], [held], [np.array(ends, np.int64).tobytes()], [np.array(tokens, np.int32).tobytes()], [words.tobytes()]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["block", "doc_ids", "held", "ends", "tokens", "words"])

        for batch in batches:
            for key, text, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
                raw.append(END)
                tokens.extend([index[w] for w in raw])
                ids.append(key)
                held.append(out)
                ends.append(len(tokens))
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(ids) >= 20_000:
                    yield flush()
                    ids, held, tokens, ends, chars = [], [], [], [], 0
                    index.clear()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held")).mapInArrow(trimming(run), BLOCK)


class Block:
    """A block's arrays: for each token its word, its context's word, and the number of its pair."""

    def __init__(self, row: dict):
        self.doc_ids, self.block = row["doc_ids"], row["block"]
        self.held, self.ends = np.array(row["held"], bool), np.frombuffer(row["ends"], np.int64)
        self.word, self.hashes = np.frombuffer(row["tokens"], np.int32), np.frombuffer(row["words"], np.uint64)
        self.sizes = np.diff(self.ends, prepend=0)
        self.train = np.repeat(~self.held, self.sizes)
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]  # the first word of a text follows the end of the one before
        self.context[0] = self.word[-1]
        pairs, self.pair = np.unique(self.context.astype(np.int64) * len(self.hashes) + self.word, return_inverse=True)
        self.pairs = pairs

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.hashes[self.pairs // len(self.hashes)], self.hashes[self.pairs % len(self.hashes)]
        with np.errstate(over="ignore"):
            x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return self.hashes, x ^ (x >> np.uint64(32))

    def parts(self, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, bucket, where its keys are, keys), kind 1 for words and 2 for pairs; a bucket is the top bits of its keys."""
        for kind, key in zip((1, 2), self.keys(), strict=True):
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for own in np.split(order, starts[1:]):
                if len(own):
                    yield kind, int(bucket[own[0]]), own, key[own]


def small(x: np.ndarray) -> bytes:
    """Counts in as few bytes as their largest needs, the width first."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def ask(blocks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                counts = (None, np.bincount(b.word[b.train], minlength=len(b.hashes)), np.bincount(b.pair[b.train], minlength=len(b.pairs)))
                out: list[list] = [[] for _ in range(5)]
                for kind, bucket, own, key in b.parts(bits):
                    width = 8 if kind == 1 else PAIR_BYTES
                    keys = np.ascontiguousarray((key << np.uint64(bits if kind == 2 else 0)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width])
                    for column, value in zip(out, (bucket, b.block, kind, keys.tobytes(), small(counts[kind][own])), strict=True):
                        column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["bucket", "block", "kind", "keys", "counts"])

    return blocks.mapInArrow(run, "bucket int, block long, kind int, keys binary, counts binary")


def answer(asked: DataFrame) -> DataFrame:
    """For each request its keys' total counts; for each bucket of words a row of kind 0 with all and distinct training tokens."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        for kind, width in ((1, 8), (2, PAIR_BYTES)):
            own = [r for r in rows if r["kind"] == kind]
            if not own:
                continue
            wide = np.zeros((sum(len(r["keys"]) for r in own) // width, 8), np.uint8)
            wide[:, :width] = np.frombuffer(b"".join(r["keys"] for r in own), np.uint8).reshape(-1, width)
            distinct, which = np.unique(wide.view(">u8")[:, 0].astype(np.uint64), return_inverse=True)
            total = np.bincount(which, np.concatenate([large(r["counts"]) for r in own]), len(distinct)).astype(np.int64)
            at = 0
            for r in own:
                n = len(r["keys"]) // width
                out.append((r["block"], kind, r["bucket"], small(total[which[at : at + n]])))
                at += n
            if kind == 1:
                out.append((-1, 0, int((total > 0).sum()), int(total.sum()).to_bytes(8, "little")))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "kind", "bucket", "totals"])

    return asked.groupBy("bucket").applyInArrow(run, "block long, kind int, bucket int, totals binary")


def counts_of(b: Block, answers: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: how often its word, its context and its pair were trained."""
    got = {(k, x): t for k, x, t in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "totals")), strict=True)}
    word, pair = np.zeros(len(b.hashes), np.int64), np.zeros(len(b.pairs), np.int64)
    for kind, bucket, own, _ in b.parts(bits):
        (word if kind == 1 else pair)[own] = large(got[kind, bucket])
    return word[b.word], word[b.context], pair[b.pair]


def level(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one for each doubling."""
    return np.where(n > 0, np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64) + 1, LEVELS - 1), 0)


def fit_weights(cells: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Rows (level, n, pair estimate, word estimate, even estimate) to the weights of the three estimates by level. Levels without rows
    get the weights of all rows together."""
    weights = np.full((LEVELS, 3), 1 / 3)

    def em(rows: np.ndarray) -> np.ndarray:
        w, n, p = np.full(3, 1 / 3), rows[:, 1], rows[:, 2:]
        for _ in range(rounds):
            share = p * w
            w = np.maximum((share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum(), 1e-6)
            w /= w.sum()
        return w

    if len(cells):
        weights[:] = em(cells)
        for k in np.unique(cells[:, 0].astype(int)):
            weights[k] = em(cells[cells[:, 0] == k])
    return weights


def totals_of(answers: DataFrame) -> tuple[int, int]:
    """Training tokens, and distinct ones, over all buckets of words: buckets are added up where they lie, and the driver gets one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_all = n_distinct = 0
        for batch in batches:
            n_distinct += sum(batch.column(0).to_pylist())
            n_all += sum(int.from_bytes(x, "little") for x in batch.column(1).to_pylist())
        yield pa.record_batch([pa.array([n_all], pa.int64()), pa.array([n_distinct], pa.int64())], ["n_all", "n_distinct"])

    added = answers.where("kind = 0").select(F.col("bucket").cast("long").alias("bucket"), "totals").mapInArrow(run, "n_all long, n_distinct long")
    return tuple(added.agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first())


def language_scores(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learned from the rows that are not held out."""
    spark = docs.sparkSession
    name = f"docquarry_lm_{uuid.uuid4().hex}"
    try:
        return scored(docs, held_out, name)
    finally:  # the catalog keeps nothing of a run, failed ones too
        for what in ("blocks", "answers"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{what}")


def scored(docs: DataFrame, held_out: F.Column, name: str) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucketed = lambda df, what: df.write.bucketBy(parts, "block").option("path", shared_folder(spark)).option("compression", "zstd").saveAsTable(f"{name}_{what}")
    bucketed(build_blocks(docs, held_out), "blocks")
    blocks = spark.table(f"{name}_blocks")
    tokens = blocks.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0] // 4
    bits = max(2, int(np.ceil(np.log2(max(1, tokens * (PAIR_BYTES + 1) / BUCKET_BYTES)))))  # buckets grow in number, not in size
    bucketed(answer(ask(blocks, bits)).repartition(parts, "block"), "answers")
    answers = spark.table(f"{name}_answers")
    n_all, n_distinct = totals_of(answers)
    even = 1 / (n_distinct + 1)
    met = blocks.groupBy("block").cogroup(answers.where("kind > 0").groupBy("block"))

    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left.to_pylist()[0])
        word, context, pair = (x[b.train] - 1 for x in counts_of(b, right, bits))  # without the occurrence itself
        p1, p2 = word / max(n_all - 1, 1), pair / np.maximum(context, 1)
        step = lambda p: np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-30))).astype(np.int64) + 1000, 0)
        cell, which = np.unique(level(context) << 32 | step(p2) << 16 | step(p1), return_inverse=True)
        sums = [np.bincount(which, x, len(cell)).astype(float) for x in (np.ones(len(which)), p2, p1)]
        return pa.table([pa.array(cell.astype(np.int64)), *map(pa.array, sums)], ["cell", "n", "p2", "p1"])

    cells = met.applyInArrow(histogram, "cell long, n double, p2 double, p1 double")
    cells = cells.groupBy("cell").agg(F.sum("n"), F.sum("p2"), F.sum("p1")).orderBy("cell").collect()  # bounded: levels x steps x steps
    weights = fit_weights(np.array([(c >> 32, n, p2 / n, p1 / n, even) for c, n, p2, p1 in cells]).reshape(-1, 5))

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left.to_pylist()[0])
        word, context, pair = counts_of(b, right, bits)
        w = weights[level(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n_all, 1) + w[:, 2] * even
        starts = b.ends - b.sizes
        added = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has an end token
        base = np.log10((word + 1) / (n_all + n_distinct + 1))
        columns = [pa.array(b.doc_ids, pa.int64()), pa.array(b.held), pa.array(b.sizes), pa.array(added((word > 0).astype(np.int64)))]
        columns += [pa.array(np.full(len(starts), n_all, np.int64)), pa.array(added(base)), pa.array(added(np.log10(p)))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return written(met.applyInArrow(scores, schema))


def is_held_out(doc_id: F.Column, modulus: int = 7, remainder: int = 2) -> F.Column:
    return F.coalesce(crc_of_id(doc_id) % modulus == remainder, F.lit(False))
