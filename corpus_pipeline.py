"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a table that the next one reads as its docs. All but the last return the columns of
documents (and any more that docs have).

Defined cases. quality: a null or empty text has the score of no features and stays or goes by it; a null doc_id is scored like any row; without
labels all stay. near_duplicates: of a group the row with the smallest doc_id stays; rows of one doc_id with unlike texts are different
documents and each stays, unless a near copy has a smaller id; repeated rows become one; texts without a word are one group; a row
without doc_id stays if no row of its group has one. mixing: every row is taken once at least; null sources are a source. packing: a
null text is its end id alone. An empty table gives no rows at any stage; extra columns keep their values whatever their names, but
for mix_block and mix_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.mixing import mix
from docquarry.llm.packing import pack_documents
from docquarry.llm.quality import accepted, train_on
from docquarry.llm.queries import TOKENIZER
from docquarry.llm.shared import documents, written
from docquarry.llm.simhash import without_near_copies

ACCEPTED_SCORE = 0.3
SEQUENCE_TOKENS = 1024
ENTROPY_SHARE, MOST_REPEATS = 0.95, 1.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return accepted(docs, train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ACCEPTED_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: SimHash finds the candidates, and those with four fifths or more of their five-word
    shingles in common are linked."""
    return without_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources: every document once at least, no source more than MOST_REPEATS times."""
    return mix(docs, ENTROPY_SHARE, MOST_REPEATS).drop("mix_block", "mix_key")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all tokens in sequences."""
    return pack_documents(docs, TOKENIZER, SEQUENCE_TOKENS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The tokenizer and the classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
