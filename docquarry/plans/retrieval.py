"""Ranking queries: benchmark items ask, documents answer; vectors whose id is divisible by 20 ask all vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.statistics import gain
from docquarry.functions.text import PUNCTUATION, raw_text, tokens
from docquarry.operators.matching import bm25_of_texts, coded_texts, containment, words_by_text
from docquarry.operators.ranking import fuse_ranks, keyword_first, top_of_group
from docquarry.operators.retrieval import exact_cosine, pack_evidence, text_postings
from docquarry.sources.intermediate import written
from docquarry.sources.tables import table

from .registry import query

QUOTED = PUNCTUATION.replace("'", "''")
WORDS = f"""CASE WHEN len(list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '[ \\t\\r\\n]+'), lambda w: trim(w, '{QUOTED}')), lambda w: w <> '')) > 0
  THEN list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '[ \\t\\r\\n]+'), lambda w: trim(w, '{QUOTED}')), lambda w: w <> '') ELSE ['∅'] END"""
BM25 = f"""dw AS (SELECT doc_id, {WORDS} AS w FROM documents), qw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
sz AS (SELECT doc_id, len(w) AS dl FROM dw), st AS (SELECT count(*) AS n, avg(dl) AS mean FROM sz),
po AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM dw) GROUP BY ALL),
df AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM po, st GROUP BY term, n),
wt AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT avg(idf) * 0.25 FROM df) ELSE idf END AS idf FROM df),
qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM qw) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM qt JOIN po USING (term) JOIN wt USING (term) JOIN sz USING (doc_id), st GROUP BY ALL),
lex AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 20)"""
SHINGLES = """sh AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, w || ' ' || lead(w) OVER (PARTITION BY item_id ORDER BY i) AS g FROM (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM qw)) WHERE g IS NOT NULL),
ss AS (SELECT item_id, g, count(*) OVER (PARTITION BY item_id) AS size FROM sh),
ds AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM dw)) WHERE g IS NOT NULL),
co AS (SELECT item_id, doc_id, round(count(*) / max(size), 6) AS score FROM ss JOIN ds USING (g) GROUP BY ALL),
con AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM co) WHERE rank <= 20)"""
FUSED = """li AS (SELECT item_id, doc_id, 'lexical' AS channel, rank FROM lex UNION ALL SELECT item_id, doc_id, 'shingle', rank FROM con),
fu AS (SELECT item_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM li GROUP BY ALL),
rf AS (SELECT item_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS fused_rank FROM fu)"""


def shown(spark: SparkSession, d: str, side: Column | None = None) -> DataFrame:
    return words_by_text(table(spark, d, "documents"), "doc_id", F.array(raw_text(F.col("text"))), side)


def lexical_by(spark: SparkSession, d: str, side: str, k: int) -> DataFrame:
    """(item_id, side, doc_id, score, rank): an item's k best documents of each value of a column of theirs."""
    return bm25_of_texts(shown(spark, d, F.col(side)), text_postings(table(spark, d, "benchmark"), "item_id", "text"), "doc_id", "item_id", k, side)


def lexical(spark: SparkSession, d: str, lang: str | None = None) -> DataFrame:
    """(item_id, doc_id, score, rank): twenty documents an item, of all or of one language; weights come from all."""
    admitted = None if lang is None else F.col("lang").eqNullSafe(F.lit(lang)).cast("string")
    texts = shown(spark, d, admitted)
    if lang is not None:
        texts = texts.withColumn("sides", F.array_distinct("sides"))
    asked = text_postings(table(spark, d, "benchmark"), "item_id", "text")
    found = bm25_of_texts(texts, asked, "doc_id", "item_id", 20, admitted=None if lang is None else F.array_contains("sides", "true"))
    return (found if lang is None else found.where("side = 'true'")).drop("side")


def word_pairs(df: DataFrame, key: str) -> DataFrame:
    """(key, g): the runs of two words of each text."""
    words = df.select(key, tokens(F.col("text")).alias("w")).withColumn("next", F.slice("w", 2, 2**31 - 1))
    pairs = words.select(key, F.explode(F.arrays_zip("w", "next")).alias("p")).where("p.next is not null")
    return pairs.select(key, F.concat_ws(" ", "p.w", "p.next").alias("g"))


def containing(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the share of an item's distinct word pairs that they hold."""
    asked = word_pairs(table(spark, d, "benchmark"), "item_id").distinct().withColumnRenamed("g", "term")
    return containment(shown(spark, d), asked, "doc_id", "item_id", 20, coded_texts)


def channels(spark: SparkSession, d: str) -> DataFrame:
    own = lambda df, name: df.select("item_id", "doc_id", F.lit(name).alias("channel"), "rank")
    return own(lexical(spark, d), "lexical").unionByName(own(containing(spark, d), "shingle"))


@query(f"WITH {BM25} SELECT * FROM lex")
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d)


@query(
    f"""WITH {BM25} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc JOIN documents USING (doc_id) WHERE score > 0 AND lang = 'en' QUALIFY rank <= 20"""
)
def search_bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Term weights of all documents, English ones ranked."""
    return lexical(spark, d, "en")


@query(f"WITH {BM25}, {SHINGLES} SELECT * FROM con")
def search_shingle_containment(spark: SparkSession, d: str) -> DataFrame:
    return containing(spark, d)


@query(f"WITH {BM25}, {SHINGLES}, {FUSED} SELECT * FROM rf WHERE fused_rank <= 5")
def search_hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: two channels, fused, five documents an item."""
    fused = fuse_ranks(channels(spark, d), "item_id", "doc_id", "channel", "rank")
    return fused.where("fused_rank <= 5").withColumn("score", F.round("score", 9))


@query(
    f"""WITH {BM25}, {SHINGLES}, {FUSED} SELECT item_id, doc_id, place FROM (SELECT rf.item_id, rf.doc_id, row_number() OVER (PARTITION BY rf.item_id ORDER BY h.rank NULLS LAST, fused_rank) AS place
    FROM rf LEFT JOIN (SELECT * FROM lex WHERE rank <= 3) h ON h.item_id = rf.item_id AND h.doc_id = rf.doc_id) WHERE place <= 10"""
)
def search_keyword_first(spark: SparkSession, d: str) -> DataFrame:
    """Three lexical hits first, then fused order."""
    return keyword_first(channels(spark, d), "item_id", "doc_id", "channel", "rank", 3, 10)


VECTORS = """ok AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nn AS (SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query, r.vec_id AS vec_id, round(list_cosine_similarity(q.e, r.e), 6) AS score FROM ok q JOIN ok r ON q.label = r.label AND q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0))"""


def nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return exact_cosine(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "label", k)


@query(f"WITH {VECTORS} SELECT * FROM nn WHERE rank <= 20")
def search_exact_cosine_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set (ids divisible by 20) against all vectors of the same label."""
    return nearest(spark, d, 20)


@query(
    f"""WITH {BM25}, {SHINGLES}, {FUSED} SELECT item_id, doc_id, CASE WHEN fused_rank <= 10 THEN why END AS why FROM (
    WITH RECURSIVE o AS (SELECT rf.item_id, rf.doc_id, fused_rank AS k, dl::BIGINT AS c, source AS g FROM rf JOIN sz ON sz.doc_id = rf.doc_id JOIN documents d ON d.doc_id = rf.doc_id WHERE fused_rank <= 10),
    f AS (SELECT item_id, 0::BIGINT AS k, 0 AS n, 0::BIGINT AS used, []::VARCHAR[] AS gs, NULL::BIGINT AS doc_id, NULL::VARCHAR AS why FROM (SELECT DISTINCT item_id FROM o)
      UNION ALL SELECT item_id, k, CASE WHEN w = 'packed' THEN n + 1 ELSE n END, CASE WHEN w = 'packed' THEN used + c ELSE used END, CASE WHEN w = 'packed' THEN list_append(gs, g) ELSE gs END, doc_id, w FROM (
        SELECT f.item_id, o.k, n, used, gs, o.doc_id, o.c, o.g, CASE WHEN n >= 3 THEN 'units' WHEN list_contains(gs, g) THEN 'overlap' WHEN used + c > 3000 THEN 'tokens' ELSE 'packed' END AS w FROM f JOIN o ON o.item_id = f.item_id AND o.k = f.k + 1))
    SELECT item_id, doc_id, k AS fused_rank, why FROM f WHERE k > 0)"""
)
def search_pack_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Ten fused documents an item, packed into three units and 3,000 words, one of a source."""
    fused = written(fuse_ranks(channels(spark, d), "item_id", "doc_id", "channel", "rank").where("fused_rank <= 10"))
    docs = table(spark, d, "documents").join(written(fused.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.size(tokens(F.col("text"))).alias("cost"), "source")
    return pack_evidence(fused.join(docs, "doc_id"), "item_id", "doc_id", "fused_rank", "cost", "source", 3, 3000).select("item_id", "doc_id", "why")


GRADES = """gr AS (SELECT item_id, doc_id, rank, CASE WHEN score >= 1 THEN 2 WHEN score > 0.2 THEN 1 ELSE 0 END AS grade FROM con)"""


@query(
    f"""WITH {BM25}, {SHINGLES}, {GRADES}, j AS (SELECT l.item_id, l.rank, coalesce(g.grade, 0) AS grade FROM lex l LEFT JOIN gr g ON g.item_id = l.item_id AND g.doc_id = l.doc_id),
    i AS (SELECT item_id, sum((2 ** grade - 1) / log2(k + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS k FROM gr) WHERE k <= 5 GROUP BY 1)
    SELECT j.item_id, round(coalesce(sum(CASE WHEN rank <= 5 THEN (2 ** grade - 1) / log2(rank + 1) END) / nullif(max(ideal), 0), 0), 6) AS ndcg5, coalesce(round(1.0 / min(CASE WHEN grade = 2 THEN rank END), 6), 0) AS mrr,
    max(CASE WHEN grade = 2 AND rank <= 1 THEN 1 ELSE 0 END) AS hit1, max(CASE WHEN grade = 2 AND rank <= 5 THEN 1 ELSE 0 END) AS hit5, count(*) FILTER (grade > 0) AS found FROM j JOIN i ON i.item_id = j.item_id GROUP BY 1"""
)
def eval_graded_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The lexical ranking graded by the other channel (2: whole item, 1: part): nDCG@5, reciprocal rank, hits."""
    grade = F.when(F.col("score") >= 1, 2).when(F.col("score") > 0.2, 1).otherwise(0)
    graded = containing(spark, d).select("item_id", "doc_id", grade.alias("grade"))
    best = top_of_group(graded, ["item_id"], [F.desc("grade"), F.asc("doc_id")], 5, "k")
    ideal = best.groupBy("item_id").agg(F.sum(gain(F.col("grade"), F.col("k"))).alias("ideal"))
    judged = lexical(spark, d).join(graded, ["item_id", "doc_id"], "left").na.fill(0, ["grade"]).join(ideal, "item_id")
    ndcg = F.sum(F.when(F.col("rank") <= 5, gain(F.col("grade"), F.col("rank")))) / F.nullif(F.max("ideal"), F.lit(0.0))
    hit = lambda k: F.max(((F.col("grade") == 2) & (F.col("rank") <= k)).cast("int"))
    return judged.groupBy("item_id").agg(
        F.round(F.coalesce(ndcg, F.lit(0.0)), 6).alias("ndcg5"),
        F.coalesce(F.round(1 / F.min(F.when(F.col("grade") == 2, F.col("rank"))), 6), F.lit(0.0)).alias("mrr"),
        hit(1).alias("hit1"),
        hit(5).alias("hit5"),
        F.count_if(F.col("grade") > 0).alias("found"),
    )


@query(
    f"""WITH {BM25}, f AS (SELECT term, count(DISTINCT doc_id) AS df, max(n) AS n FROM po, st GROUP BY term) SELECT item_id, string_agg(term, ' ' ORDER BY term) AS dropped, count(*) AS n
    FROM qt JOIN f USING (term) WHERE df * 2 > f.n GROUP BY 1"""
)
def search_redundant_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of an item that over half of all documents hold."""
    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    common = docs.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") * 2 > F.lit(docs.count()))
    asked = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return asked.join(common, "term").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("dropped"), F.count("*").alias("n"))


@query(
    f"""WITH {VECTORS}, c AS (SELECT query, vec_id, rank FROM nn WHERE rank <= 40) SELECT query, count(*) FILTER (rank <= 20) AS exact, min(CASE WHEN rank = 20 THEN rank END) AS depth, round(avg(rank), 6) AS mean_rank FROM c GROUP BY 1"""
)
def eval_search_depth(spark: SparkSession, d: str) -> DataFrame:
    found = nearest(spark, d, 40)
    return found.groupBy("query").agg(F.count_if(F.col("rank") <= 20).alias("exact"), F.min(F.when(F.col("rank") == 20, F.col("rank"))).alias("depth"), F.round(F.avg("rank"), 6).alias("mean_rank"))


@query(
    f"""WITH {VECTORS}, t AS (SELECT query, vec_id, rank, lead(score) OVER (PARTITION BY query ORDER BY rank) AS following, score FROM nn WHERE rank <= 21) SELECT query, vec_id, round(score - following, 6) AS margin FROM t WHERE rank <= 20"""
)
def search_margins(spark: SparkSession, d: str) -> DataFrame:
    """How far each neighbour is ahead of the next."""
    w = Window.partitionBy("query").orderBy("rank")
    found = nearest(spark, d, 21).withColumn("following", F.lead("score").over(w))
    return found.where("rank <= 20").select("query", "vec_id", F.round(F.col("score") - F.col("following"), 6).alias("margin"))
