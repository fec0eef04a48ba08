"""Queries on amounts, dates and costs written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.numbers import integral, korean_won, micro_cost, moment
from docquarry.sources.tables import table

from .registry import query


@query("SELECT o_orderkey, floor(o_totalprice)::BIGINT * 1000 AS won FROM orders")
def number_korean_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written with units and read back."""
    n = F.floor("o_totalprice").cast("long") * 1000
    written = F.concat(F.floor(n / 10**8).cast("string"), F.lit("억 "), (F.floor(n / 10**4) % 10**4).cast("string"), F.lit("만 "), (n % 10**4).cast("string"), F.lit("원"))
    return table(spark, d, "orders").select("o_orderkey", korean_won(written).alias("won"))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity = floor(l_quantity)) AS whole, count(*) FILTER (l_tax <> floor(l_tax)) AS fractional FROM lineitem GROUP BY 1")
def number_integral_flags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", integral(F.col("l_quantity").cast("string")).alias("q"), integral(F.col("l_tax").cast("string")).alias("t"))
    return t.groupBy("l_orderkey").agg(F.count_if(F.col("q.flag").isNull()).alias("whole"), F.count_if(F.col("t.flag") == "fractional").alias("fractional"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value, 'date' AS precision FROM orders")
def number_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", moment(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("m")).select("o_orderkey", "m.*")


@query("SELECT l_orderkey, sum(ceil(l_quantity::BIGINT * 1.25 + l_linenumber * 10))::BIGINT AS micro FROM lineitem GROUP BY 1")
def number_costs(spark: SparkSession, d: str) -> DataFrame:
    cost = micro_cost({"input": F.col("l_quantity"), "output": F.col("l_linenumber")}, {"input": 1.25, "output": 10.0})
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(cost).alias("micro"))
