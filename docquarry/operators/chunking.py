"""Chunks of token arrays and of ordered elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_windows(df: DataFrame, words: str, size: int, overlap: int) -> DataFrame:
    """df exploded to (…, k, window): runs of `size` tokens that begin every size - overlap tokens; the last one may be shorter."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - overlap) / step).cast("int") - 1)
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("window", F.slice(F.col(words), F.col("k") * step + 1, F.lit(size))).drop(words)


def pack_rows(df: DataFrame, keys: Sequence[str], order: str, cost: str, target: int, hard: int) -> DataFrame:
    """(keys, order, chunk): rows in order, a new chunk wherever the sum would pass target; a row over hard is a chunk of its own. A fold
    over the rows of one group, such as a table of one document."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")))).alias("r"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("alone"), F.array().cast("array<struct<o:bigint,chunk:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["used"] > 0) & (acc["alone"] | (acc["used"] + x["c"] > target) | (x["c"] > hard))
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        used = F.when(new, x["c"]).otherwise(acc["used"] + x["c"])
        return F.struct(chunk.alias("chunk"), used.alias("used"), (x["c"] > hard).alias("alone"), F.array_append(acc["out"], F.struct(x["o"].cast("long").alias("o"), chunk.alias("chunk"))).alias("out"))

    folded = rows.select(*keys, F.explode(F.aggregate("r", start, step)["out"]).alias("x"))
    return folded.select(*keys, F.col("x.o").alias(order), F.col("x.chunk").alias("chunk"))


def table_rows(cells: DataFrame, key: str, row: str, col: str, span: str, text: str) -> DataFrame:
    """(key, row, line): the cells of each row joined by bars. A cell stands in all rows that it spans, unless a later cell has the place; a cell that
    repeats the one to its left is left out."""
    wide = cells.select(key, F.explode(F.sequence(F.col(row), F.col(row) + F.col(span) - 1)).alias("__r"), F.col(row).alias("__from"), F.col(col).alias("__c"), F.col(text).alias("__t"))
    placed = wide.groupBy(key, "__r", "__c").agg(F.max(F.struct("__from", "__t")).alias("__x"))
    listed = placed.groupBy(key, F.col("__r").alias(row)).agg(F.transform(F.array_sort(F.collect_list(F.struct("__c", F.col("__x.__t").alias("t")))), lambda x: x["t"]).alias("__l"))
    kept = F.filter("__l", lambda x, k: (k == 0) | (F.get("__l", k - 1) != x))
    return listed.select(key, row, F.array_join(kept, " | ").alias("line"))
