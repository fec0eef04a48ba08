"""Queries on links and reuse: near questions across splits, families, a fitted vector index, a band of thresholds, and a store of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.statistics import threshold_band
from docquarry.functions.text import grams, squashed
from docquarry.operators import vectorindex
from docquarry.operators.families import families
from docquarry.operators.governance import hash_parity_split
from docquarry.operators.similarity import across_splits
from docquarry.sources.cache import Store, recomputed
from docquarry.sources.intermediate import shared_root
from docquarry.sources.tables import table

from .events import JUDGED, judged
from .registry import query

PARITY = "CASE WHEN ('0x' || right(sha256({0}::VARCHAR), 1))::INT % 2 = 0 THEN 'dev' ELSE 'test' END"
ALIKE = 0.85  # fixed value: likeness of character pairs from which two questions count as one


@query(
    f"""WITH t AS (SELECT conv_id, turn, {PARITY.format("conv_id")} AS split, regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\x{{A0}}]+', '', 'g') AS s FROM conversations),
    g AS (SELECT *, list_sort(list_distinct(list_transform(range(1, greatest(length(s), 1)), lambda i: substr(s, i, 2)))) AS own FROM t),
    c AS (SELECT own, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test FROM g WHERE len(own) > 0 GROUP BY 1),
    p AS (SELECT a.own, sum(b.dev) AS dev, sum(b.test) AS test FROM c a JOIN c b ON len(list_intersect(a.own, b.own)) >= {ALIKE} * (len(a.own) + len(b.own) - len(list_intersect(a.own, b.own))) GROUP BY a.own)
    SELECT conv_id, turn, split, coalesce(CASE WHEN split = 'dev' THEN test ELSE dev END, 0)::BIGINT AS n_links FROM g LEFT JOIN p USING (own)"""
)
def governance_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each split that repeat or paraphrase turns of the other: for each, how many."""
    rows = hash_parity_split(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id")
    rows = rows.select("conv_id", "turn", "split", grams(squashed(F.coalesce("text", F.lit(""))), 2).alias("own"))
    return across_splits(rows, "own", "split", ALIKE).select("conv_id", "turn", "split", "n_links")


@query(
    f"""WITH RECURSIVE k AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, nullif(trim(split_part(coalesce(text, ''), '.', 1)), '') AS title FROM documents),
    e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY h) AS b FROM k UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY title) FROM k WHERE title IS NOT NULL),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM k UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
    f AS (SELECT a AS doc_id, min(b) AS family FROM r GROUP BY 1)
    SELECT doc_id, family, count(*) OVER (PARTITION BY family) AS members, {PARITY.format("family")} AS split FROM f"""
)
def governance_families(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are connected by equal texts or equal first sentences, and the split of their family."""
    text = F.coalesce("text", F.lit(""))
    title = F.btrim(F.split(text, r"\.")[0], F.lit(" "))
    rows = table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("h"), F.when(title != "", title).alias("title"))
    found = families(rows, "doc_id", ["h", "title"])
    sizes = found.groupBy("family").agg(F.count("*").alias("members"))
    return hash_parity_split(found.join(sizes, "family"), "family").select("doc_id", "family", "members", "split")


def index_and_queries(spark: SparkSession, d: str, k: int) -> tuple[vectorindex.Chosen, DataFrame]:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    return vectorindex.built(rows, "vec_id", "embedding", k, like=asked), asked


@query()
def search_indexed_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set against all vectors through a fitted index, whose setting measured recall has chosen."""
    chosen, asked = index_and_queries(spark, d, 20)
    found = vectorindex.search(chosen, asked, "vec_id", "embedding", 20)
    return found.select("query", F.col("key").alias("vec_id"), "score", "rank")


@query()
def eval_indexed_recall(spark: SparkSession, d: str) -> DataFrame:
    """By query of the stated set, how many of its twenty exact neighbours the index finds."""
    chosen, asked = index_and_queries(spark, d, 20)
    found = vectorindex.search(chosen, asked, "vec_id", "embedding", 20)
    exact = vectorindex.search(vectorindex.Chosen(chosen.rows, None, None, None, ()), asked, "vec_id", "embedding", 20)
    return vectorindex.recall(exact, found)


@query(
    f"""WITH {JUDGED}, t AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) / length(text), 2) END AS s FROM documents),
    p AS (SELECT s, a FROM j LEFT JOIN t USING (doc_id)), n AS (SELECT count(*) AS n, count(s) AS points, count(*) FILTER (a AND s IS NOT NULL) AS pos, count(*) FILTER (NOT a AND s IS NOT NULL) AS neg FROM p),
    c AS (SELECT DISTINCT s AS cut FROM p WHERE s IS NOT NULL UNION SELECT 0.0 UNION SELECT 1.01), b AS (SELECT cut, count(*) FILTER (a AND s < cut) AS pb, count(*) FILTER (NOT a AND s < cut) AS nb FROM c LEFT JOIN p ON s < cut GROUP BY 1),
    x AS (SELECT l.cut AS lo, h.cut AS hi, pos - h.pb AS tp, neg - h.nb AS fa, l.pb AS fr, l.nb AS tn, n, points FROM b l JOIN b h ON l.cut <= h.cut, n),
    y AS (SELECT *, tp + fa + fr + tn AS m, (tp + tn) / (tp + fa + fr + tn) AS po, (tp + fr) / (tp + fa + fr + tn) AS ra, (tp + fa) / (tp + fa + fr + tn) AS ja FROM x),
    z AS (SELECT *, m / n AS coverage, CASE WHEN m > 0 AND ra * ja + (1 - ra) * (1 - ja) < 1 THEN (po - ra * ja - (1 - ra) * (1 - ja)) / (1 - ra * ja - (1 - ra) * (1 - ja)) END AS kappa FROM y)
    SELECT lo, hi, round(kappa, 6) AS kappa, round(coverage, 6) AS coverage, fa AS false_accepts, n, points, coverage >= 0.7 AS meets_floor FROM z
    ORDER BY coverage >= 0.7 DESC, round(coalesce(kappa, -1), 9) DESC, fa, m DESC, round(hi - lo, 6), lo LIMIT 1"""
)
def eval_threshold_band(spark: SparkSession, d: str) -> DataFrame:
    """The best band of two cuts over a document's share of letters (two digits): accept above, reject below, abstain between."""
    letters = F.length(F.regexp_replace("text", "[^A-Za-z ]", "")) / F.length("text")
    scores = table(spark, d, "documents").select("doc_id", F.when(F.length("text") > 0, F.round(letters, 2)).alias("s"))
    return threshold_band(judged(spark, d).join(scores, "doc_id", "left"), "s", "a", floor=0.7, top=1.01)


@query(
    f"""WITH s AS (SELECT doc_id, text, {PARITY.format("doc_id")} AS split FROM documents), f AS (SELECT DISTINCT coalesce(text, chr(0)) AS t FROM s WHERE split = 'dev')
    SELECT doc_id, length(coalesce(text, '')) AS chars, len(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+')) AS pieces, coalesce(text, chr(0)) IN (SELECT t FROM f) AS reused FROM s"""
)
def governance_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Measures of all documents after those of one split are in the store: texts that it has are not measured again."""
    store = Store(f"{shared_root(spark)}/store-{uuid.uuid4().hex}")
    docs = hash_parity_split(table(spark, d, "documents").select("doc_id", "text"), "doc_id")

    def measures(inputs: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        return inputs.select("input_key", F.length(text).alias("chars"), F.size(F.split(text, "[ \t\r\n]+")).alias("pieces"))

    recomputed(docs.where("split = 'dev'"), ["text"], measures, "measures-1", store)
    every, _ = recomputed(docs, ["text"], measures, "measures-1", store)
    return every.select("doc_id", "chars", "pieces", "reused")
