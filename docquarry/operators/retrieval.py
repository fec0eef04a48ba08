"""Ranking passages: BM25, exact cosine search, fusion, and evidence packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import raw_words, stripped
from docquarry.operators.ranking import top_of_group
from docquarry.sources.intermediate import written

K1, B, FLOOR = 1.5, 0.75, 0.25  # fixed values of the ranking formula
#: Tiles of rows with which a task compares a tile of queries, about.
LANE = 4


def postings(docs: DataFrame, doc: str, words: str) -> DataFrame:
    """(doc, term, tf)."""
    return docs.select(doc, F.explode(words).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))


def text_postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf) of the words that `tokens` gives, without an array of them."""
    return docs.select(doc, F.explode(raw_words(F.col(text))).alias("word")).select(doc, stripped("word").alias("term")).where("term <> ''").groupBy(doc, "term").agg(F.count("*").alias("tf"))


def weighed(counts: DataFrame, asked: DataFrame, doc: str, query: str) -> DataFrame:
    """(query, doc, score above zero) by BM25 over postings: counts (doc, term, tf), a written table, as it is read several times, and asked
    (query, term, tf). Repeated query words count again; weights below zero become a quarter of the mean weight."""
    sizes = counts.groupBy(doc).agg(F.sum("tf").alias("dl"))
    n, mean = sizes.agg(F.count("*"), F.avg("dl")).first()
    weights = counts.groupBy("term").agg(F.log((n - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    floor = weights.agg(F.avg("idf") * FLOOR).first()[0]
    weights = weights.withColumn("idf", F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf")))
    asked = asked.withColumnRenamed("tf", "times")
    met = counts.join(asked.select("term").distinct(), "term", "left_semi")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    scored = met.join(sizes, doc).join(weights, "term").join(asked, "term").groupBy(query, doc).agg(F.round(F.sum(part), 6).alias("score"))
    return scored.where("score > 0")


def bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, words: str, k: int, admitted: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query, from arrays of words. Term weights come from all documents; only admitted
    ones (doc) are ranked."""
    scored = weighed(written(postings(docs, doc, words)), postings(queries, query, words), doc, query)
    if admitted is not None:
        scored = scored.join(admitted.select(doc), doc, "left_semi")
    return top_of_group(scored, [query], [F.desc("score"), F.asc(doc)], k)


def exact_cosine(rows: DataFrame, queries: DataFrame, key: str, vector: str, scope: str, k: int, tile: int = 512) -> DataFrame:
    """(query, key, score, rank): the k rows nearest to each query in its scope, itself left out, in double precision. Rows and queries
    of a scope are laid into tiles, and the tiles of rows into lanes of LANE tiles; queries go to each lane of their scope, so a task compares them
    with so many tiles at most, however large a scope is, and each pair of tiles gives at most k rows a query."""
    e = F.col(vector).cast("array<double>")
    good = F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = lambda df: df.where(F.col(vector).isNotNull() & F.col(scope).isNotNull()).where(good)
    counted = usable(rows).groupBy(scope).agg(F.ceil(F.count("*") / (tile * LANE)).alias("__lanes"))

    def tiles(df: DataFrame, name: str) -> DataFrame:
        sizes = usable(df).groupBy(scope).agg(F.ceil(F.count("*") / tile).alias("__n"))
        dealt = usable(df).join(sizes, scope).withColumn("__t", F.pmod(F.xxhash64(key), F.col("__n")))
        laid = dealt.groupBy(scope, "__t").agg(F.collect_list(F.struct(F.col(key).alias("key"), e.alias("e"))).alias(name))
        return laid.join(counted, scope)

    def read(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, inner = column.offsets.to_numpy(), column.values
        keys, e = inner.field("key").to_numpy(), inner.field("e")
        ends, flat = e.offsets.to_numpy(), e.values.to_numpy()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            v = flat[ends[a] : ends[b]].reshape(b - a, -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square is too large or too small
            yield keys[a:b], v / np.linalg.norm(v, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (q, u), (r, v) in zip(read(batch.column(0)), read(batch.column(1)), strict=True):
                score = np.round(u @ v.T, 6)  # as ranked in the end, so that the cut keeps the same rows of equal scores
                score[q[:, None] == r[None, :]] = -2
                best = np.lexsort((np.broadcast_to(r, score.shape), -score), axis=1)[:, :k]
                flat = [pa.array(np.repeat(q, best.shape[1])), pa.array(r[best].reshape(-1)), pa.array(np.take_along_axis(score, best, axis=1).reshape(-1))]
                yield pa.record_batch(flat, ["query", key, "score"])

    lanes = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__lanes") - 1)).alias("__lane")
    own = tiles(rows, "b").withColumn("__lane", F.pmod(F.col("__t"), F.col("__lanes"))).select(scope, "__lane", "b")
    pairs = tiles(queries, "a").select(scope, lanes, "a").join(own, [scope, "__lane"]).select("a", "b")
    found = pairs.mapInArrow(run, f"query long, {key} long, score double").where("score > -2")
    return top_of_group(found, ["query"], [F.desc("score"), F.asc(key)], k)


def pack_evidence(ranked: DataFrame, query: str, item: str, rank: str, cost: str, group: str, units: int, budget: int) -> DataFrame:
    """(query, item, packed, why): a fold in rank order that takes items while units and tokens last, one of each group; others are
    excluded with the first reason. A query's ranking is bounded by its depth."""
    ordered = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(rank, item, cost, group))).alias("r"))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("groups"), F.array().cast("array<string>").alias("why"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        tokens, name = x[cost].cast("long"), x[group].cast("string")
        why = F.when(acc["n"] >= units, "units").when(F.array_contains(acc["groups"], name), "overlap").when(acc["used"] + tokens > budget, "tokens").otherwise("packed")
        take = why == "packed"
        return F.struct(
            F.when(take, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(take, acc["used"] + tokens).otherwise(acc["used"]).alias("used"),
            F.when(take, F.array_append(acc["groups"], name)).otherwise(acc["groups"]).alias("groups"),
            F.array_append(acc["why"], why).alias("why"),
        )

    folded = ordered.withColumn("why", F.aggregate("r", state, step)["why"])
    rows = folded.select(query, F.explode(F.arrays_zip("r", "why")).alias("x"))
    return rows.select(query, F.col(f"x.r.{item}").alias(item), (F.col("x.why") == "packed").alias("packed"), F.col("x.why").alias("why"))


def probed_cosine(rows: DataFrame, queries: DataFrame, key: str, vector: str, scope: str, k: int, centres: DataFrame, probes: int) -> DataFrame:
    """(query, key, score, rank): approximately the k nearest rows of the same scope. Every row lies in the cell of its nearest centre (centre,
    v: a bounded sample of vectors); a query looks into the cells of its `probes` nearest centres, and scores there are exact."""
    near = [r for r in centres.orderBy("centre").collect()]
    ids, matrix = np.array([r["centre"] for r in near]), np.array([r["v"] for r in near], np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)

    def cells(df: DataFrame, n: int, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                e = batch.column(2)
                v = e.flatten().to_numpy().reshape(batch.num_rows, -1)
                sim = np.round(v @ matrix.T / np.linalg.norm(v, axis=1, keepdims=True), 6)
                best = np.argsort(-sim, axis=1, kind="stable")[:, :n]  # centres are in order of their numbers
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * best.shape[1], pa.int32()), pa.array(ids[best].reshape(-1).astype(np.int64)))
                yield pa.record_batch([*batch.columns, lists], [name, "scope", "e", "cells"])

        good = df.where(F.col(vector).isNotNull() & F.col(scope).isNotNull()).where(F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
        asked = good.select(F.col(key).cast("long").alias(name), F.col(scope).cast("string").alias("scope"), F.col(vector).cast("array<double>").alias("e"))
        placed = asked.mapInArrow(run, f"{name} long, scope string, e array<double>, cells array<long>")
        return placed.select(name, F.explode("cells").alias("cell"), F.concat_ws(":", "scope", "cell").alias("place"), F.col("e").alias(vector))

    own, asked = cells(rows, 1, key), cells(queries, probes, key)
    found = exact_cosine(own, asked, key, vector, "place", k)
    return top_of_group(found.select("query", key, "score"), ["query"], [F.desc("score"), F.asc(key)], k)


def rerank_below_head(ordered: DataFrame, scores: DataFrame, query: str, item: str, head: int, depth: int) -> DataFrame:
    """(query, item, place): the first `head` items of an order (query, item, rank) stay, those below down to `depth` follow by falling score of
    scores (query, item, score), and those beyond keep their places. A query with any item of the pool unscored keeps its whole order."""
    pool = (F.col("rank") > head) & (F.col("rank") <= depth)
    met = ordered.join(scores.select(query, item, F.col("score").alias("__s")), [query, item], "left")
    failed = F.max(F.when(pool & F.col("__s").isNull(), 1).otherwise(0)).over(Window.partitionBy(query)) == 1
    section = F.when(F.col("rank") <= head, 0).when(F.col("rank") <= depth, 1).otherwise(2)
    by = F.when(pool & ~F.col("__f"), -F.col("__s")).otherwise(0.0)
    order = Window.partitionBy(query).orderBy("__section", by, "rank")
    return met.withColumns({"__f": failed, "__section": section}).withColumn("place", F.row_number().over(order)).select(query, item, "place")
