"""Approximate cosine search: cells of fitted centres, residuals coded by parts, exact scores for a short list.

Centres and part codes are fitted by k-means on a bounded sample; every row is indexed. A query looks into the cells of its nearest
centres, scores their codes by table look-ups, and takes exact scores of its `shortlist` best. How many cells and how long a list
is chosen by measured recall: the cheapest setting that finds `goal` of the exact neighbours of sampled queries, ties with the last
one counted as found; if none does, search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.matching import Best
from docquarry.operators.ranking import top_of_group
from docquarry.sources.intermediate import written

#: Rows that the index is fitted on, and queries that settings are measured on, at most.
SAMPLE, MEASURED = 4096, 100
LANES = 8
#: Rows that are compared with queries at once, and found rows that a task holds before it keeps the best of each query.
ROWS, HELD = 512, 300_000


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def k_means(v: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of the rows of v; an empty one starts anew at the row that is furthest from its own."""
    centres = v[np.random.default_rng(seed).choice(len(v), min(k, len(v)), replace=False)].copy()
    for _ in range(rounds):
        gap = (centres**2).sum(axis=1) - 2 * v @ centres.T
        own = gap.argmin(axis=1)
        far = list(np.argsort(-np.take_along_axis(gap, own[:, None], axis=1)[:, 0] - (v**2).sum(axis=1), kind="stable"))
        for c in range(len(centres)):
            rows = v[own == c]
            centres[c] = rows.mean(axis=0) if len(rows) else v[far.pop(0)]
    return centres


@dataclass(frozen=True)
class Fitted:
    centres: np.ndarray  # (cells, d), in single precision
    books: np.ndarray  # (parts, entries, d / parts): of residuals

    def cells(self, v: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centres of unit vectors."""
        return np.argsort((self.centres**2).sum(axis=1) - 2 * v @ self.centres.T, axis=1, kind="stable")[:, :n]

    def codes(self, v: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = (v - self.centres[cell]).reshape(len(v), len(self.books), -1)
        return np.stack([((b**2).sum(axis=1) - 2 * left[:, p] @ b.T).argmin(axis=1) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Near the cosines of queries and the coded rows of a cell."""
        parts = queries.reshape(len(queries), len(self.books), -1)
        out = np.repeat((queries @ self.centres[cell])[:, None], len(codes), axis=1)
        for p, b in enumerate(self.books):
            out += (parts[:, p] @ b.T)[:, codes[:, p]]
        return out


@dataclass(frozen=True)
class Setting:
    probes: int
    shortlist: int


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, e) of vectors that have a direction."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.where(F.col(vector).isNotNull()).where(good).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("e"))


def matrix(column: pa.ListArray) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def fit(rows: DataFrame, cells: int = 16, parts: int = 16, entries: int = 64, rounds: int = 10, seed: int = 0) -> Fitted | None:
    """rows (key, e). Fitted on SAMPLE rows in hash order; None if there are none, or the length is no multiple of parts."""
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(SAMPLE).select("e").collect()
    if not drawn or len(drawn[0]["e"]) % parts:
        return None
    v = unit(np.array([r["e"] for r in drawn])).astype(np.float32)
    centres = k_means(v, cells, rounds, seed)
    own = ((centres**2).sum(axis=1) - 2 * v @ centres.T).argmin(axis=1)
    left = np.split(v - centres[own], parts, axis=1)
    books = [k_means(x, entries, rounds, seed) for x in left]
    return Fitted(centres.astype(np.float32), np.stack(books).astype(np.float32))


def grouped(rows: DataFrame, fitted: Fitted, probes: int, coded: bool) -> DataFrame:
    """(cell, tile, keys, packed): rows (key, e) of a batch by their `probes` nearest cells, packed as codes or as single-precision vectors."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                keys, v = part.column(0).to_numpy(), matrix(part.column(1)).astype(np.float32)
                near = fitted.cells(v, probes)
                out: list[list] = [[], [], []]
                for cell in np.unique(near).tolist():
                    own = np.flatnonzero((near == cell).any(axis=1))
                    packed = fitted.codes(v[own], np.full(len(own), cell)) if coded else v[own]
                    for column, x in zip(out, (cell, keys[own].tolist(), packed.tobytes()), strict=True):
                        column.append(x)
                yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary())], ["cell", "keys", "packed"])

    return rows.mapInArrow(run, "cell int, keys array<long>, packed binary")


def indexed(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """The index: every row's code in the tile of its cell, dealt into lanes so that a large cell is searched by several tasks."""
    tiles = grouped(rows, fitted, 1, coded=True)
    return written(tiles.withColumn("lane", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(LANES)).cast("int")))


def exact_scores(pairs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """pairs (query, key) with score, the cosine in double precision to six places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = (matrix(batch.column(2)) * matrix(batch.column(3))).sum(axis=1).round(6)
            yield pa.record_batch([*batch.columns[:2], pa.array(score)], ["query", "key", "score"])

    met = pairs.join(rows.withColumnRenamed("e", "row_e"), "key").join(asked.select(F.col("key").alias("query"), F.col("e").alias("query_e")), "query")
    return met.select("query", "key", "query_e", "row_e").mapInArrow(run, "query long, key long, score double")


def firsts(parts: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    """(query, key, near) of the n nearest of each query."""
    query, key, near = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((key, -near, query))
    start = np.flatnonzero(np.append(True, np.diff(query[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    kept = order[place < n]
    return query[kept], key[kept], near[kept]


def searched(index: DataFrame, rows: DataFrame, asked: DataFrame, fitted: Fitted, setting: Setting, k: int) -> DataFrame:
    """(query, key, score, rank): the k best of each query's short list, itself left out."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted)
    lanes = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane")
    blocks = grouped(asked, fitted, setting.probes, coded=False).select("cell", F.col("keys").alias("queries"), F.col("packed").alias("vectors"), lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for cell, queries, vectors, keys, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(vectors, np.float32).reshape(len(queries), -1)
                score = fitted.scores(v, cell, np.frombuffer(packed, np.uint8).reshape(len(keys), -1))
                q, own = np.array(queries), np.array(keys)
                score[q[:, None] == own] = -np.inf
                n = min(setting.shortlist, len(own))
                best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                found = np.take_along_axis(score, best, axis=1).reshape(-1)
                good = np.isfinite(found)
                parts.append((np.repeat(q, n)[good], own[best].reshape(-1)[good], found[good].astype(np.float64)))
                if sum(len(x[0]) for x in parts) >= HELD:
                    parts = [firsts(parts, setting.shortlist)]
                    if len(parts[0][0]) >= HELD // 2:
                        yield pa.record_batch([pa.array(x) for x in parts.pop()], ["query", "key", "near"])
        if parts:
            yield pa.record_batch([pa.array(x) for x in firsts(parts, setting.shortlist)], ["query", "key", "near"])

    found = blocks.join(index, ["cell", "lane"]).select("cell", "queries", "vectors", "keys", "packed").mapInArrow(run, "query long, key long, near double")
    short = top_of_group(found, ["query"], [F.desc("near"), F.asc("key")], setting.shortlist)
    return top_of_group(exact_scores(short.select("query", "key"), rows, asked), ["query"], [F.desc("score"), F.asc("key")], k)


def nearest(rows: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query, key, score, rank): the k nearest of all rows to a bounded list of queries, exactly."""
    ids = np.array([q for q, _ in asked], np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((ids, unit(np.array([e for _, e in asked]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = sent.value
        best = Best(k, ids)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                keys, score = part.column(0).to_numpy(), (matrix(part.column(1)) @ v.T).round(6) + 2  # above zero, as Best takes them
                score[keys[:, None] == ids] = 0
                best.add(score, keys, [None] * len(keys))
        for taken in best.taken():
            yield pa.record_batch([taken.column(0), taken.column(2), pa.array((taken.column(3).to_numpy() - 2).round(6))], ["query", "key", "score"])

    found = rows.mapInArrow(run, "query long, key long, score double")
    return top_of_group(found, ["query"], [F.desc("score"), F.asc("key")], k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(query, n, found, recall): whatever ties with the last exact neighbour counts as found."""
    edges = exact.groupBy("query").agg(F.min("score").alias("edge"), F.count("*").alias("n"))
    hits = edges.join(found.select("query", "score"), "query", "left").groupBy("query", "n").agg(F.count_if(F.col("score") >= F.col("edge")).alias("found"))
    return hits.withColumn("recall", F.round(F.col("found") / F.col("n"), 4))


@dataclass(frozen=True)
class Chosen:
    """An index with the setting that measurement chose (None: exact search), and the measured recall of each setting that was tried."""

    rows: DataFrame
    fitted: Fitted | None
    index: DataFrame | None
    setting: Setting | None
    measured: tuple[tuple[Setting, float], ...]


def built(rows: DataFrame, key: str, vector: str, k: int, goal: float = 0.9, cells: int = 16, seed: int = 0, like: DataFrame | None = None) -> Chosen:
    """Settings are measured on queries drawn from `like`, which should be as those that will be asked; from the rows if it is not given."""
    own = written(usable(rows, key, vector))
    fitted = fit(own, cells, seed=seed)
    if fitted is None:
        return Chosen(own, None, None, None, ())
    index = indexed(own, fitted)
    drawn = written((own if like is None else usable(like, key, vector)).orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key").limit(MEASURED))
    exact = written(nearest(own, [tuple(r) for r in drawn.collect()], k))
    most = len(fitted.centres)
    options = sorted({(max(1, most * p // 8), k * s) for p in (2, 4, 8) for s in (2, 4, 8)}, key=lambda x: (x[0] * 4 + x[1] * most / k / 4, x))
    measured = []
    for setting in (Setting(*x) for x in options):
        share = recall(exact, searched(index, own, drawn, fitted, setting, k)).agg(F.sum("found") / F.sum("n")).first()[0] or 0.0
        measured.append((setting, share))
        if share >= goal + 0.02:  # what is asked may differ from what was measured
            return Chosen(own, fitted, index, setting, tuple(measured))
    return Chosen(own, fitted, index, None, tuple(measured))


def search(chosen: Chosen, asked: DataFrame, key: str, vector: str, k: int, block: int = 2000) -> DataFrame:
    """(query, key, score, rank) of the asked rows."""
    queries = written(usable(asked, key, vector))
    if chosen.setting:
        return searched(chosen.index, chosen.rows, queries, chosen.fitted, chosen.setting, k)
    out, parts = None, -(-queries.count() // block) or 1
    for part in range(parts):  # exact: blocks of queries of a bounded size
        mine = [tuple(r) for r in queries.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).collect()]
        found = nearest(chosen.rows, mine, k) if mine else chosen.rows.limit(0).selectExpr("key AS query", "key", "0D AS score", "1 AS rank")
        out = found if out is None else out.unionByName(found)
    return out
