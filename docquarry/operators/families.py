"""Families: rows connected through shared keys of any kind, and splits that never part a family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.sources.intermediate import written


def families(rows: DataFrame, row: str, keys: Sequence[str], most_rounds: int = 60) -> DataFrame:
    """(row, family): the smallest row id reachable through rows that share a value of one of the keys; a null value is shared with nobody.

    A round gives each value the smallest label of its rows and each row the smallest of its values', then follows labels of
    labels. No pair of rows is made, so a value that very many rows share costs a row each; every round is written."""
    own = rows.select(F.col(row).alias("row"), F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)])).alias("value")).where("value is not null")
    member = written(own.distinct())
    label = written(rows.select(F.col(row).alias("row")).distinct().withColumn("family", F.col("row")))
    for _ in range(most_rounds):
        by_value = member.join(label, "row").groupBy("value").agg(F.min("family").alias("family"))
        by_row = member.join(by_value, "value").groupBy("row").agg(F.min("family").alias("least"))
        near = label.join(by_row, "row", "left").select("row", F.col("family").alias("was"), F.least("family", F.coalesce("least", "family")).alias("family"))
        of = label.select(F.col("row").alias("family"), F.col("family").alias("root"))
        now = written(near.join(of, "family", "left").select("row", "was", F.least("family", F.coalesce("root", "family")).alias("family")))
        label = now.select("row", "family")
        if now.where("family <> was").isEmpty():
            return label.withColumnRenamed("row", row)
    raise RuntimeError(f"families not settled after {most_rounds} rounds")
