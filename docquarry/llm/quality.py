"""Operator 6: a quality classifier of supervised subword embeddings.

Features of a text are its lower-cased words, their character n-grams with word ends marked, and a mark for each word that repeats the
one before (all word pairs of equal words are one feature). Each feature's hash picks a learned vector; a document is the mean of its
vectors, and a softmax over two classes follows. Training is stochastic gradient descent in numpy on a bounded sample of labelled
rows, drawn by hash of doc_id. As the mean and the last layer are linear, scoring needs one number per hash: what the vector adds to
the log-odds; each distinct word of a batch is weighed once.

Defined cases: a null or empty text has the score of no features (the learned bias); rows without doc_id are scored and are not held
out; repeated rows are each scored; an empty table gives no rows; without any label every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .encode import in_slices
from .shared import crc_of_id, give_back, trimming

BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE = 600_000  # characters whose words are weighed at once


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    grams: tuple[int, ...] = (3, 4, 5)
    dimensions: int = 8
    sample_rows: int = 3000  # labelled rows that training sees at most
    epochs: int = 5
    rate: float = 20.0
    seed: int = 7


def word_features(words: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of distinct words, word by word, and where each word's begin (with a last end)."""
    marked = [b"<" + w + b">" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    code = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    first = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max()), BASE, np.uint64))
        hashes = [np.add.reduceat(code * powers[np.arange(len(code)) - np.repeat(first, size)], first)]
        owners = [np.arange(len(words))]
        for n in settings.grams:
            own = np.maximum(size - n + 1, 0)
            at = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            h = np.full(len(at), np.uint64(n))
            for k in range(n):
                h = h * BASE + code[at + k]
            hashes.append(h)
            owners.append(np.repeat(np.arange(len(words)), own))
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        h = (h ^ (h >> np.uint64(32))) * BASE
    order = np.argsort(owner, kind="stable")
    return ((h >> np.uint64(40)) % np.uint64(settings.buckets - 1)).astype(np.int64)[order] + 1, np.searchsorted(owner[order], np.arange(len(words) + 1))


REPEATED = 0  # the bucket of the repeat mark


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts one after another, where each text's begin (with a last end), and the distinct words."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    ends = np.cumsum([0] + [len(w) for w in split])
    coded = pa.array([w for own in split for w in own], pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), ends, coded.dictionary.to_pylist()


def repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for each word that equals the one before in its text."""
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    starts = ends[:-1][ends[:-1] < len(words)]
    same[starts] = 0
    return same


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends[1:]] - total[ends[:-1]]


@dataclass
class Model:
    """weights: what a feature adds to the log-odds of class 1, by bucket."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words, ends, distinct = words_of(texts)
        if not distinct:
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        features, at = word_features(distinct, self.settings)
        value, count = sums(self.weights[features], at), np.diff(at)
        same = repeats(words, ends)
        total = np.maximum(sums(count[words] + same, ends), 1)
        odds = sums(value[words] + same * self.weights[REPEATED], ends) / total + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(texts: list[str | None], classes: list[int], settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent, one document a step, the rate falling to zero."""
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1, 1, (settings.buckets, settings.dimensions)).astype(np.float32) / settings.dimensions
    out, bias = np.zeros((settings.dimensions, 2), np.float32), np.zeros(2, np.float32)
    bags = []
    for a, b in in_slices(texts, SLICE):
        words, ends, distinct = words_of(texts[a:b])
        features, at = word_features(distinct, settings) if distinct else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        same = repeats(words, ends)
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            own, times = np.unique(words[x:y], return_counts=True)
            size = at[own + 1] - at[own]
            index = np.repeat(at[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            ids, which = np.unique(features[index], return_inverse=True)
            count = np.bincount(which, np.repeat(times, size), len(ids))
            if n := int(same[x:y].sum()):
                ids, count = np.append(ids, REPEATED), np.append(count, n)
            bags.append((ids.astype(np.int32), count.astype(np.min_scalar_type(int(count.max(initial=0))))))  # as small as can be
    steps, done = max(1, settings.epochs * len(bags)), 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(bags)):
            ids, count = bags[k]
            share = (count / max(count.sum(dtype=np.int64), 1)).astype(np.float32)
            mean = share @ vectors[ids]
            odds = mean @ out + bias
            odds = np.exp(odds - odds.max())
            error = odds / odds.sum()
            error[classes[k]] -= 1
            rate = settings.rate * (1 - done / steps)
            back = out @ error
            out -= 0.05 * rate * np.outer(mean, error)
            bias -= 0.01 * rate * error
            vectors[ids] -= rate * share[:, None] * back
            done += 1
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]), settings)


def train_on(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from at most settings.sample_rows labelled documents that are not held out."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_rows)
    named = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = named.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()  # of texts with one id the least
    rows.sort(key=lambda r: r["doc_id"])
    model = train([r["text"] for r in rows], [int(r["quality"] == 1) for r in rows], settings)
    del rows
    give_back()  # the driver is needed for longer than the sample
    return model


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(crc_of_id(doc_id) % 5 == 0, F.lit(False))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_slices(texts, SLICE):
                part = batch.slice(a, b - a)
                yield pa.record_batch([*part.columns, pa.array(shared.value.scores(texts[a:b]))], [*batch.schema.names, "score"])

    return docs.mapInArrow(trimming(run), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    scored = score_texts(docs.select("doc_id", "text"), train_on(docs, labels, settings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the model accepts."""
    if "score" in docs.columns:
        return accepted(docs.withColumnRenamed("score", "score of docs"), model, threshold).withColumnRenamed("score of docs", "score")
    return score_texts(docs, model).where(F.col("score") >= threshold).drop("score")
