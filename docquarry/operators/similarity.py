"""Similarity join of sets: pairs of classes of equal sets with a Jaccard likeness of at least a threshold, by bits of hashed members."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.sources.intermediate import written

#: Sets of a tile that are compared with another tile at once.
STRIP = 64


def set_classes(rows: DataFrame, members: str) -> DataFrame:
    """rows with class: a digest of the set (an array without repeats); null for an empty one."""
    own = F.array_sort(F.coalesce(members, F.array().cast("array<string>")))
    return rows.withColumn("class", F.when(F.size(own) > 0, F.sha2(F.concat_ws("\0", F.transform(own, lambda g: F.concat(F.length(g).cast("string"), F.lit(":"), g))), 256)))


def similar_classes(classes: DataFrame, members: str, threshold: float, tile: int = 16_384) -> DataFrame:
    """(a, b, likeness), a < b, of classes (class, members) whose sets are alike to at least the threshold, exactly.

    Sets lie in bands of sizes, so that alike ones are in one band or in neighbours, and bands are dealt into tiles of about `tile` sets. Each pair of
    tiles is one group, in which bits of hashed members are compared: two sets share no more members than bits, and as many more as the set with
    fewer collisions has. Pairs that may reach the threshold by that are compared as sets. All pairs of like sizes are looked at, as bits, so time is
    quadratic in them; what is shuffled is a set's bits for each tile of its size, and a group holds two tiles."""
    sized = classes.select("class", F.col(members).alias("own"), F.size(members).alias("n")).where("n > 0")
    sized = written(sized.withColumn("id", F.monotonically_increasing_id()))
    most = sized.agg(F.max("n")).first()[0] or 1
    bits = min(4096, max(512, 1 << (4 * most - 1).bit_length()))
    base = max(1 / threshold * (1 + 1e-9), 1.01)
    banded = sized.select("id", "n", F.floor(F.log("n") / math.log(base)).alias("band"), F.transform("own", lambda g: F.pmod(F.xxhash64(g), F.lit(bits)).cast("int")).alias("at"))
    tiles = written(banded.groupBy("band").agg(F.ceil(F.count("*") / tile).alias("tiles")))
    laid = banded.join(tiles, "band").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")))
    for name, step in (("more", 1), ("fewer", -1)):  # tiles of the band of larger and of smaller sets
        laid = laid.join(tiles.select((F.col("band") - step).alias("band"), F.col("tiles").alias(name)), "band", "left")
    pair = lambda *c: F.struct(*[x.cast("long").alias(k) for k, x in zip(("band", "one", "step", "other", "side"), c, strict=True)])
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)).cast("long") - 1)
    t, band, no = F.col("t"), F.col("band"), F.lit(0)
    own = F.transform(every(F.col("tiles")), lambda u: pair(band, F.least(t, u), no, F.greatest(t, u), (t > u).cast("int")))
    up = F.transform(every(F.col("more")), lambda u: pair(band, t, F.lit(1), u, no))
    down = F.transform(every(F.col("fewer")), lambda u: pair(band - 1, u, F.lit(1), t, F.lit(1)))
    none = F.filter(own, lambda x: F.lit(False))
    pairs = F.concat(own, F.when(F.col("more").isNull(), none).otherwise(up), F.when(F.col("fewer").isNull(), none).otherwise(down))
    dealt = packed(laid.select("id", "n", "at", pairs.alias("pairs")), bits).select("id", "n", "bits", F.explode("pairs").alias("x")).select("id", "n", "bits", "x.*")
    met = dealt.groupBy("band", "one", "step", "other").applyInArrow(compared(threshold), "a_id long, b_id long")
    sets = lambda x: sized.select(*[F.col(c).alias(f"{x}_{c}") for c in ("id", "class", "own", "n")])
    both = F.size(F.array_intersect("a_own", "b_own"))
    likeness = both / (F.col("a_n") + F.col("b_n") - both)
    ends = [f("a_class", "b_class").alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
    return met.join(sets("a"), "a_id").join(sets("b"), "b_id").select(*ends, likeness.alias("likeness")).where(F.col("likeness") >= threshold)


def packed(rows: DataFrame, bits: int) -> DataFrame:
    """rows (id, n, at, pairs) with bits: the places of `at` as a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                own = np.zeros((part.num_rows, bits), bool)
                own[np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy(zero_copy_only=False)), part.column(2).flatten().to_numpy()] = True
                yield pa.record_batch([part.column(0), part.column(1), pa.array([r.tobytes() for r in np.packbits(own, axis=1)], pa.binary()), part.column(3)], ["id", "n", "bits", "pairs"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, n {kinds['n']}, bits binary, pairs {kinds['pairs']}")


def compared(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Pairs of two tiles, or within one, that may be as alike as the threshold by their bits."""

    def run(rows: pa.Table) -> pa.Table:
        ids, n, side = (rows.column(c).to_numpy() for c in ("id", "n", "side"))
        words = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
        same = rows.column("step")[0].as_py() == 0 and rows.column("one")[0].as_py() == rows.column("other")[0].as_py()
        a, b = (np.argsort(n, kind="stable"),) * 2 if same else (np.flatnonzero(side == s)[np.argsort(n[side == s], kind="stable")] for s in (0, 1))
        spare = n - np.bitwise_count(words).sum(axis=1)
        first = words.shape[1] // 2  # words of bits after which most pairs are given up
        rest = np.bitwise_count(words[:, first:]).sum(axis=1).astype(np.int64)
        columns = np.ascontiguousarray(words[b].T)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(0, len(a), STRIP):
            own = a[k : k + STRIP]
            low = k if same else np.searchsorted(n[b], np.ceil(threshold * n[own[0]] - 1e-6))
            high = np.searchsorted(n[b], np.floor(n[own[-1]] / threshold + 1e-6), side="right")
            if high <= low:
                continue
            them = b[low:high]
            needed = np.ceil(threshold / (1 + threshold) * (n[own][:, None] + n[them]) - 1e-6) - np.minimum(spare[own][:, None], spare[them])
            shared = np.zeros(needed.shape, np.uint16)
            for w in range(first):
                shared += np.bitwise_count(words[own, w][:, None] & columns[w, low:high])
            i, j = np.nonzero(shared + np.minimum(rest[own][:, None], rest[them]) >= needed)
            full = shared[i, j] + np.bitwise_count(words[own[i], first:] & words[them[j], first:]).sum(axis=1)
            kept = full >= needed[i, j]
            i, j = i[kept], j[kept]
            if same:
                i, j = i[low + j > k + i], j[low + j > k + i]
            out.append((ids[own[i]], ids[them[j]]))
        flat = [np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in (0, 1)]
        return pa.table({"a_id": pa.array(flat[0], pa.int64()), "b_id": pa.array(flat[1], pa.int64())})

    return run


def across_splits(rows: DataFrame, members: str, split: str, threshold: float) -> DataFrame:
    """rows with class and n_links: rows of another split whose sets are as alike; rows of the class itself in other splits count. Empty
    sets link with nothing. Links are counted by class and split, so copies are never paired."""
    classed = written(set_classes(rows, members))
    counted = written(classed.where("class is not null").groupBy("class", split).agg(F.count("*").alias("n")))
    classes = classed.where("class is not null").groupBy("class").agg(F.first(members).alias("members"))
    pairs = similar_classes(classes, "members", threshold).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(classes.select(F.col("class").alias("a"), F.col("class").alias("b")))
    there = counted.select(F.col("class").alias("b"), F.col(split).alias("of"), "n")
    near = both.join(there, "b").groupBy("a", "of").agg(F.sum("n").alias("n"))
    own = counted.select(F.col("class").alias("a"), split)
    linked = own.join(near, "a").where(~F.col(split).eqNullSafe(F.col("of"))).groupBy("a", split).agg(F.sum("n").alias("n_links"))
    met = classed.join(linked.select(F.col("a").alias("__a"), F.col(split).alias("__s"), "n_links"), (F.col("class") == F.col("__a")) & F.col(split).eqNullSafe(F.col("__s")), "left")
    return met.withColumn("n_links", F.coalesce("n_links", F.lit(0))).drop("__a", "__s")
