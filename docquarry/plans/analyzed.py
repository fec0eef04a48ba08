"""Queries by analyzer: whole words against pieces of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.analysis import Analyzer, Pieces, WholeWords, dictionary, entries_of, kept_lists
from docquarry.operators.matching import bm25_of_lists
from docquarry.sources.intermediate import shared_root
from docquarry.sources.tables import table

from .registry import query


def pieces(spark: SparkSession, d: str) -> Pieces:
    """The analyzer with a dictionary of the documents' short words (20,000 at most)."""
    return Pieces(entries_of(dictionary(table(spark, d, "documents"), "text").collect()))


def ranked(spark: SparkSession, d: str, analyzer: Analyzer, k: int = 20) -> DataFrame:
    lists, _ = kept_lists(table(spark, d, "documents"), "doc_id", "text", analyzer, f"{shared_root(spark)}/postings")
    return bm25_of_lists(lists, analyzer.postings(table(spark, d, "benchmark"), "item_id", "text"), "doc_id", "item_id", k).drop("side")


@query(
    r"""WITH w AS (SELECT trim(unnest(string_split_regex(lower(coalesce(text, '')), '[ \t\r\n]+')), '.,;:!?()[]{}"''`|*#%$&') AS term FROM documents),
    c AS (SELECT term, count(*) AS n FROM w WHERE length(term) BETWEEN 2 AND 6 AND regexp_full_match(term, '\p{L}+') GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
    f AS (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS k FROM c WHERE n >= 3)
    SELECT term, CASE WHEN k <= 40 THEN 'function' ELSE 'content' END AS tag, round(1000 * ln(total / n))::INT AS cost FROM f, t WHERE k <= 20000"""
)
def text_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary that the lattice of pieces uses."""
    return dictionary(table(spark, d, "documents"), "text")


@query()
def search_bm25_pieces(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over pieces of words: a compound is found by its parts."""
    return ranked(spark, d, pieces(spark, d))


@query()
def eval_analyzers(spark: SparkSession, d: str) -> DataFrame:
    """What the two analyzers have in common: by item, the documents each finds, and those both find, among their first twenty."""
    one, other = ranked(spark, d, WholeWords()), ranked(spark, d, pieces(spark, d))
    sides = one.select("item_id", "doc_id", F.lit(1).alias("words"), F.lit(0).alias("pieces")).unionByName(other.select("item_id", "doc_id", F.lit(0).alias("words"), F.lit(1).alias("pieces")))
    both = sides.groupBy("item_id", "doc_id").agg(F.max("words").alias("words"), F.max("pieces").alias("pieces"))
    return both.groupBy("item_id").agg(F.sum("words").alias("by_words"), F.sum("pieces").alias("by_pieces"), F.sum(F.col("words") * F.col("pieces")).alias("by_both"))
