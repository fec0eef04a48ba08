"""Top rows, with ties, by group, and by fused rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_with_ties(df: DataFrame, by: str, n: int, descending: bool = False) -> DataFrame:
    """The rows whose `by` is among the first n, and all that tie with the last of them. Only n values meet in one place."""
    first = df.where(F.col(by).isNotNull()).select(by).orderBy(F.desc(by) if descending else F.asc(by)).limit(n)
    edge = first.agg((F.min(by) if descending else F.max(by)).alias("__edge"))
    test = F.col(by) >= F.col("__edge") if descending else F.col(by) <= F.col("__edge")
    return df.join(F.broadcast(edge), test).drop("__edge")


def top_of_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1; order must end in a unique column."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def first_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, without a sort of the groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def fuse_ranks(lists: DataFrame, query: str, item: str, channel: str, rank: str, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: (query, item, score, fused_rank). An item votes once for each channel, by its best rank."""
    best = lists.groupBy(query, item, channel).agg(F.min(rank).alias("__r"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col(channel) == name, F.lit(w)).otherwise(weight)
    fused = best.groupBy(query, item).agg(F.sum(weight / (k + F.col("__r"))).alias("score"))
    return fused.withColumn("fused_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("score", 12)), item)))


def keyword_first(lists: DataFrame, query: str, item: str, channel: str, rank: str, head: int, depth: int, lexical: str = "lexical", k: int = 60) -> DataFrame:
    """The first `head` lexical items in order, then fused order, cut at depth: (query, item, place)."""
    fused = fuse_ranks(lists, query, item, channel, rank, k)
    heads = lists.where((F.col(channel) == lexical) & (F.col(rank) <= head)).groupBy(query, item).agg(F.min(rank).alias("__head"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.asc_nulls_last("__head"), F.desc(F.round("score", 12)), item))
    return fused.join(heads, [query, item], "left").withColumn("place", place).where(F.col("place") <= depth).select(query, item, "place")


def numbered(rows: DataFrame, keys: Sequence[str], order: str, name: str, width: int = 1 << 20) -> DataFrame:
    """rows with their numbers (from 1) within the groups of keys, in the order of a column of whole numbers. Rows are counted by blocks of
    `width` values, and numbered within a block; so a group of any size is spread over its blocks, and only counts of blocks meet in one task.
    Null keys are a group; null values come first; rows with equal values are numbered in any order, and one block holds them all."""
    blocks = rows.withColumn("block of rows", F.floor(F.col(order) / width))
    by = [*keys, "block of rows"]
    counts = blocks.groupBy(*by).agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy(*keys).orderBy("block of rows")) - F.col("held")
    counts = counts.select(*[F.col(c).alias(f"{c} of counts") for c in by], before.alias("rows before"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c} of counts")) for c in by])
    own = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return blocks.join(counts, same).withColumn(name, F.col("rows before") + own).select(*rows.columns, name)
