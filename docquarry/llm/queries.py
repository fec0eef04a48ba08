"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, mixing, sharding
from .decontaminate import contamination
from .lm import is_held_out, language_scores
from .middle import fill_in_middle, restored
from .mixing import mix
from .neighbours import near_vectors
from .packing import pack_documents
from .quality import quality_scores
from .records import token_records
from .shared import documents, written
from .simhash import simhash_groups
from .vectorcodes import vector_codes
from .winnow import edited_fingerprints

ENTROPY_SHARE, MOST_REPEATS = 0.9999, 4.0
SHARD_BYTES = 1 << 20
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = token_records(documents(spark, sf_dir), TOKENIZER)
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), TOKENIZER)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy that a stream as long as the documents takes."""
    docs = written(documents(spark, sf_dir).select("doc_id", "source", mixing.words(F.col("text")).alias("n_tokens")))
    total = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    mixed = mix(docs, ENTROPY_SHARE, MOST_REPEATS, total, tokens=F.col("n_tokens"))
    return mixed.withColumn("mix_key", F.round("mix_key", 9))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    return chat.chat_digests(rows.unionByName(more))


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards and reads them back."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sharding.read_shards(spark, sharding.write_shards(docs, SHARD_BYTES)).select("doc_id", "shard", "depth", "n_bytes", "shard_bytes")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir), is_held_out(F.col("doc_id")))


def middle_digests(docs: DataFrame) -> DataFrame:
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    back = restored(F.col("form"), F.col("output"))
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha(back).alias("restored_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def contamination_digests(marked: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    ids = F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256)
    return marked.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digests(contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_records": op1_token_records, "op2_best_fit_packing": op2_best_fit_packing, "op3_simhash": op3_simhash, "op4_temperature_mixing": op4_temperature_mixing, "op5_winnowing": op5_winnowing, "op6_quality_classifier": op6_quality_classifier, "op7_nn_descent": op7_nn_descent, "op8_reply_trees": op8_reply_trees, "op9_extendible_sharding": op9_extendible_sharding, "op10_lm_scores": op10_lm_scores, "op11_fill_in_middle": op11_fill_in_middle, "op12_vector_codes": op12_vector_codes, "op13_decontamination": op13_decontamination}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_temperature_mixing": mixing.oracle(ENTROPY_SHARE, MOST_REPEATS),
        "op8_reply_trees": chat.ORACLE,
        "op9_extendible_sharding": sharding.oracle(SHARD_BYTES),
    }
