"""Routing, reranking, approximate search and gates over the benchmark's rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.text import tokens
from docquarry.operators.intervals import carried_over
from docquarry.operators.retrieval import exact_cosine, probed_cosine, rerank_below_head
from docquarry.operators.routing import restated_names, route_by_names
from docquarry.sources.intermediate import written
from docquarry.sources.tables import table

from .registry import SQL, query
from .retrieval import BM25, SHINGLES, VECTORS, WORDS, containing, eval_graded_ranking, lexical, lexical_by


@query(
    f"""WITH {BM25}, {SHINGLES}, o AS (SELECT item_id, doc_id, rank FROM lex WHERE rank <= 20), m AS (SELECT o.*, c.score AS s FROM o LEFT JOIN con c ON c.item_id = o.item_id AND c.doc_id = o.doc_id),
    b AS (SELECT item_id, bool_or(s IS NULL AND rank BETWEEN 4 AND 6) AS failed FROM m GROUP BY 1)
    SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN rank <= 3 THEN 0 WHEN rank <= 6 THEN 1 ELSE 2 END, CASE WHEN rank BETWEEN 4 AND 6 AND NOT failed THEN -s ELSE 0 END, rank) AS place
    FROM m JOIN b USING (item_id)"""
)
def search_rerank_protected(spark: SparkSession, d: str) -> DataFrame:
    """Ranks 4 to 6 of the lexical order by the other channel's score; the head of three stays, as does an order with an unscored row."""
    return rerank_below_head(lexical(spark, d), containing(spark, d), "item_id", "doc_id", 3, 6)


@query(
    f"""WITH {BM25} SELECT item_id, source, doc_id, score, snippet FROM (SELECT item_id, source, doc_id, score, substr(text, 1, 240) AS snippet, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS k
    FROM sc JOIN documents USING (doc_id) WHERE score > 0) WHERE k = 1"""
)
def search_best_of_source(spark: SparkSession, d: str) -> DataFrame:
    """The best document of each source for each item, with the beginning of its text."""
    best = lexical_by(spark, d, "source", 1).drop("rank")
    return best.join(table(spark, d, "documents").select("doc_id", F.substring("text", 1, 240).alias("snippet")), "doc_id")


@query(
    f"""WITH {BM25}, r AS (SELECT item_id, lang AS side, doc_id, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id) AS rank FROM sc JOIN documents USING (doc_id) WHERE score > 0 QUALIFY rank <= 3)
    SELECT item_id, side, doc_id, rank, row_number() OVER (PARTITION BY item_id ORDER BY side, rank) AS evidence FROM r"""
)
def search_balanced_sides(spark: SparkSession, d: str) -> DataFrame:
    """Three documents of each language for an item, each side ranked alone, numbered through."""
    best = lexical_by(spark, d, "lang", 3).withColumnRenamed("lang", "side")
    number = F.row_number().over(Window.partitionBy("item_id").orderBy("side", "rank"))
    return best.select("item_id", "side", "doc_id", "rank", number.alias("evidence"))


CENTRES = "ce AS (SELECT vec_id AS centre, e AS v FROM ok WHERE label IS NOT NULL AND vec_id % 7 = 0 ORDER BY vec_id LIMIT 16)"
CELLS = """ca AS (SELECT o.vec_id, o.label, o.e, centre, row_number() OVER (PARTITION BY o.vec_id ORDER BY round(list_cosine_similarity(o.e, v), 6) DESC, centre) AS k FROM ok o, ce),
ap AS (SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query, r.vec_id AS vec_id, round(list_cosine_similarity(q.e, r.e), 6) AS score
  FROM ca q JOIN ca r ON q.centre = r.centre AND q.label = r.label AND q.vec_id <> r.vec_id WHERE q.k <= 15 AND r.k = 1 AND q.vec_id % 20 = 0))"""


def approximate(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    fit = e.where("label is not null and vec_id % 7 = 0 and embedding is not null").orderBy("vec_id").limit(16)  # a bounded sample
    centres = fit.select(F.col("vec_id").alias("centre"), F.col("embedding").cast("array<double>").alias("v"))
    return probed_cosine(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "label", k, centres, 15)


@query(f"WITH {VECTORS}, {CENTRES}, {CELLS} SELECT * FROM ap WHERE rank <= 20")
def search_approximate_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set against all vectors, in the cells of fifteen of sixteen centres."""
    return approximate(spark, d, 20)


@query(
    f"""WITH {VECTORS}, {CENTRES}, {CELLS}, x AS (SELECT query, min(score) AS edge, count(*) AS n FROM nn WHERE rank <= 20 GROUP BY 1)
    SELECT x.query, n, count(*) FILTER (ap.score >= edge) AS found, round(count(*) FILTER (ap.score >= edge) / n, 4) AS recall FROM x LEFT JOIN ap ON ap.query = x.query AND ap.rank <= 20 GROUP BY x.query, n"""
)
def eval_approximate_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the approximate search by query; whatever ties with the last exact neighbour counts as found."""
    e = table(spark, d, "embeddings")
    exact = exact_cosine(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "label", 20).groupBy("query").agg(F.min("score").alias("edge"), F.count("*").alias("n"))
    met = exact.join(approximate(spark, d, 20).select("query", "score"), "query", "left")
    found = F.count_if(F.col("score") >= F.col("edge"))
    return met.groupBy("query", "n").agg(found.alias("found"), F.round(found / F.col("n"), 4).alias("recall"))


@query(
    """WITH s AS (SELECT vec_id, label, embedding[1:16]::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding[1:16], lambda x: x <> 0)) > 0)
    SELECT query, vec_id, score, rank FROM (SELECT q.vec_id AS query, r.vec_id AS vec_id, round(list_cosine_similarity(q.e, r.e), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, r.e), 6) DESC, r.vec_id) AS rank
    FROM s q JOIN s r ON q.label = r.label AND q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 5"""
)
def search_shortened_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first 16 components, normalised anew, searched like whole vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 16).alias("embedding"))
    return exact_cosine(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "label", 5)


NAMED = f"""ti AS (SELECT doc_id, list_sort(list_distinct(list_filter({WORDS.replace("coalesce(text, '')", "coalesce(split_part(text, '.', 1), '')")}, lambda w: NOT regexp_matches(w, '[0-9]')))) AS terms FROM documents)"""


def names(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, terms): the sorted words of a document's first sentence, which stands for its name, but for words with digits."""
    words = tokens(F.split(F.coalesce("text", F.lit("")), r"\.")[0])
    return table(spark, d, "documents").select("doc_id", F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.rlike("[0-9]")))).alias("terms"))


@query(f"WITH {NAMED} SELECT doc_id, len(terms)::INT AS n, md5(array_to_string(terms, ' ')) AS terms_md5 FROM ti")
def search_name_terms(spark: SparkSession, d: str) -> DataFrame:
    """The frozen name terms of each document."""
    return names(spark, d).select("doc_id", F.size("terms").alias("n"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


def asked_terms(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return words.where(~F.col("term").rlike("[0-9]"))


RESTATED = f"""qt2 AS (SELECT item_id, unnest(list_distinct(list_filter({WORDS}, lambda w: NOT regexp_matches(w, '[0-9]')))) AS term FROM benchmark), te AS (SELECT doc_id, unnest(terms) AS term FROM ti),
rs AS (SELECT item_id, doc_id, term FROM qt2 JOIN te USING (term)), fr AS (SELECT item_id, term, count(*) AS df FROM rs GROUP BY 1, 2), wn AS (SELECT count(*) AS n FROM ti),
ma AS (SELECT rs.item_id, rs.doc_id, count(*) AS matched, min(df) AS rarest, round(sum(ln(n / df)), 6) AS weight FROM rs JOIN fr USING (item_id, term), wn GROUP BY 1, 2)"""


@query(f"WITH {NAMED}, {RESTATED} SELECT item_id, doc_id, matched, rarest, weight FROM ma WHERE matched >= 2 AND rarest < 4")
def search_route_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents of whose name an item restates two words or more, one of them rare, with the weight of these words."""
    return restated_names(asked_terms(spark, d), names(spark, d), "item_id", "doc_id").select("item_id", "doc_id", "matched", "rarest", "weight")


@query()
def search_route_cover(spark: SparkSession, d: str) -> DataFrame:
    """Routing: candidates by falling weight, each weighed on the words that none taken before explains; none if more than four are taken."""
    return route_by_names(asked_terms(spark, d), names(spark, d), "item_id", "doc_id")


@query(
    f"""WITH {NAMED}, {RESTATED}, {BM25}, nm AS (SELECT DISTINCT item_id, term FROM rs JOIN ma USING (item_id, doc_id) WHERE matched >= 2),
    cm AS (SELECT term FROM po, st GROUP BY term, n HAVING count(*) * 2 > n AND max(n) >= 8),
    dr AS (SELECT q.item_id, q.term, (c.term IS NOT NULL OR m.term IS NOT NULL) AS dropped, EXISTS (SELECT 1 FROM po WHERE po.term = q.term) AS held FROM qt2 q LEFT JOIN cm c ON c.term = q.term LEFT JOIN nm m ON m.item_id = q.item_id AND m.term = q.term),
    kt AS (SELECT item_id, bool_or(held AND NOT dropped) AS kept FROM dr GROUP BY 1)
    SELECT item_id, count(*) AS n, md5(string_agg(term, ' ' ORDER BY term)) AS dropped_md5 FROM dr JOIN kt USING (item_id) WHERE dropped AND kept GROUP BY 1"""
)
def search_scope_redundant(spark: SparkSession, d: str) -> DataFrame:
    """Words of an item that can't discriminate: in over half of the documents (of eight or more), or of a name that it restates; nothing is
    dropped unless a kept word is in some document. Words with digits are never dropped."""
    asked, own = asked_terms(spark, d), names(spark, d)
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    n = table(spark, d, "documents").count()
    held = docs.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    named = restated_names(asked, own, "item_id", "doc_id", rare=None).select("item_id", F.explode("shared").alias("term")).distinct().withColumn("named", F.lit(True))
    met = asked.join(held, "term", "left").join(named, ["item_id", "term"], "left")
    dropped = F.coalesce("named", F.lit(False)) | ((F.coalesce("df", F.lit(0)) * 2 > n) & F.lit(n >= 8))
    marked = met.select("item_id", "term", dropped.alias("dropped"), F.col("df").isNotNull().alias("held"))
    by = marked.groupBy("item_id").agg(F.bool_or(F.col("held") & ~F.col("dropped")).alias("kept"), F.array_sort(F.collect_list(F.when(F.col("dropped"), F.col("term")))).alias("t"))
    return by.where(F.col("kept") & (F.size("t") > 0)).select("item_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("dropped_md5"))


@query(
    f"""WITH {NAMED}, {RESTATED}, al AS (SELECT item_id, term FROM qt2), tf AS (SELECT term, count(*) AS n FROM te GROUP BY 1),
    un AS (SELECT al.item_id, count(*) FILTER (te.term IS NULL) AS unexplained, count(*) AS words FROM al LEFT JOIN (SELECT DISTINCT term FROM te) te ON te.term = al.term GROUP BY 1)
    SELECT un.item_id, words, unexplained, coalesce(m, 0) >= 2 AND unexplained = 0 AS name_only FROM un LEFT JOIN (SELECT item_id, max(matched) AS m FROM ma GROUP BY 1) ma ON ma.item_id = un.item_id"""
)
def search_name_only(spark: SparkSession, d: str) -> DataFrame:
    """Whether an item restates a name and holds no word beyond names."""
    asked, own = asked_terms(spark, d), names(spark, d)
    words = own.select(F.explode("terms").alias("term")).distinct().withColumn("named", F.lit(True))
    matched = restated_names(asked, own, "item_id", "doc_id", rare=None).groupBy("item_id").agg(F.max("matched").alias("matched"))
    counts = asked.join(words, "term", "left").groupBy("item_id").agg(F.count("*").alias("words"), F.count_if(F.col("named").isNull()).alias("unexplained"))
    return counts.join(matched, "item_id", "left").select("item_id", "words", "unexplained", ((F.coalesce("matched", F.lit(0)) >= 2) & (F.col("unexplained") == 0)).alias("name_only"))


@query(f"SELECT item_id, ndcg5, mrr, hit5 FROM ({SQL['eval_graded_ranking']}) WHERE ndcg5 < 1 OR hit5 = 0")
def eval_missed_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that a ranking missed in part: an imperfect gain or no whole answer in the first five."""
    return eval_graded_ranking(spark, d).where("ndcg5 < 1 OR hit5 = 0").select("item_id", "ndcg5", "mrr", "hit5")


@query(
    f"""WITH {BM25}, {SHINGLES}, t AS (SELECT item_id, doc_id FROM con WHERE rank = 1), h AS (SELECT t.item_id, min(l.rank) AS rank FROM t LEFT JOIN lex l ON l.item_id = t.item_id AND l.doc_id = t.doc_id GROUP BY 1)
    SELECT count(*) AS n, count(*) FILTER (rank <= 5) AS hit5, count(*) FILTER (rank <= 10) AS hit10, md5(coalesce(string_agg(item_id::VARCHAR, ' ' ORDER BY item_id) FILTER (rank IS NULL OR rank > 10), '')) AS missed_md5 FROM h"""
)
def eval_needle_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many items have their needle, the document that holds most of them, among the first 5 and 10, and which have not."""
    needles = containing(spark, d).where("rank = 1").select("item_id", "doc_id")
    met = needles.join(lexical(spark, d).select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left")
    missed = F.array_join(F.array_sort(F.collect_list(F.when(F.coalesce("rank", F.lit(99)) > 10, F.col("item_id")))).cast("array<string>"), " ")
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 5).alias("hit5"), F.count_if(F.col("rank") <= 10).alias("hit10"), F.md5(missed).alias("missed_md5"))


@query(
    f"""WITH {BM25}, {SHINGLES}, g AS (SELECT item_id, doc_id FROM con WHERE score > 0.2),
    m AS (SELECT g.item_id, max((l.rank <= 5)::INT) AS a, max((c.rank <= 5)::INT) AS b FROM g LEFT JOIN lex l USING (item_id, doc_id) LEFT JOIN con c USING (item_id, doc_id) GROUP BY 1)
    SELECT count(*) AS items, round(avg(coalesce(a, 0)), 4) AS baseline, round(avg(coalesce(b, 0)), 4) AS candidate, count(*) FILTER (coalesce(a, 0) = 1 AND coalesce(b, 0) = 0) AS new_critical,
    round(avg(coalesce(b, 0)) - avg(coalesce(a, 0)), 4) >= 0.03 AND count(*) FILTER (coalesce(a, 0) = 1 AND coalesce(b, 0) = 0) = 0 AS passed FROM m"""
)
def eval_channel_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether one channel may replace the other: a gain of 0.03 or more in hits and no item newly lost."""
    graded = containing(spark, d)
    met = graded.where("score > 0.2").select("item_id", "doc_id", F.col("rank").alias("b")).join(lexical(spark, d).select("item_id", "doc_id", F.col("rank").alias("a")), ["item_id", "doc_id"], "left")
    hit = lambda c: F.coalesce(F.max((F.col(c) <= 5).cast("int")), F.lit(0))
    by = met.groupBy("item_id").agg(hit("a").alias("a"), hit("b").alias("b"))
    lost, gain = F.count_if((F.col("a") == 1) & (F.col("b") == 0)), F.round(F.avg("b") - F.avg("a"), 4)
    return by.agg(F.count("*").alias("items"), F.round(F.avg("a"), 4).alias("baseline"), F.round(F.avg("b"), 4).alias("candidate"), lost.alias("new_critical"), ((gain >= 0.03) & (lost == 0)).alias("passed"))


@query(
    f"""WITH {BM25}, {SHINGLES}, g AS (SELECT DISTINCT d.doc_id, s.item_id, s.g FROM (SELECT item_id, g FROM ss) s JOIN ds d USING (g)), r AS (SELECT lex.item_id, lex.doc_id, lex.rank, g.g FROM lex JOIN g ON g.item_id = lex.item_id AND g.doc_id = lex.doc_id),
    f AS (SELECT item_id, g, min(rank) AS first FROM r GROUP BY 1, 2), n AS (SELECT r.item_id, r.doc_id, r.rank, count(*) AS added FROM r JOIN f ON f.item_id = r.item_id AND f.g = r.g AND f.first = r.rank GROUP BY 1, 2, 3)
    SELECT item_id, doc_id, added, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM n"""
)
def search_rank_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The lexical ranking without documents that cover nothing of an item beyond those before them: word pairs count for the first."""
    from .retrieval import word_pairs

    asked = word_pairs(table(spark, d, "benchmark"), "item_id").distinct()
    ranked = written(lexical(spark, d).select("item_id", "doc_id", "rank"))
    held = word_pairs(table(spark, d, "documents").join(ranked.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").join(asked.select("g").distinct(), "g", "left_semi").distinct()
    met = ranked.join(held, "doc_id").join(asked, ["item_id", "g"])
    first = met.groupBy("item_id", "g").agg(F.min_by(F.struct("doc_id", "rank"), "rank").alias("f"))
    new = first.groupBy("item_id", "f.doc_id", "f.rank").agg(F.count("*").alias("added"))
    return new.select("item_id", "doc_id", "added", F.row_number().over(Window.partitionBy("item_id").orderBy("rank")).alias("place"))


@query(
    f"""WITH {BM25}, c AS (SELECT item_id, doc_id, rank FROM lex WHERE rank <= 5), p AS (SELECT item_id + 1 AS item_id, doc_id, rank FROM c),
    x AS (SELECT p.item_id, p.doc_id, 5 + row_number() OVER (PARTITION BY p.item_id ORDER BY p.rank) AS number, true AS carried FROM p ANTI JOIN c ON c.item_id = p.item_id AND c.doc_id = p.doc_id WHERE p.item_id IN (SELECT item_id FROM c))
    SELECT item_id, doc_id, rank AS number, false AS carried FROM c UNION ALL SELECT * FROM x"""
)
def search_carried_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Five documents of an item, then those of the item before it that are not among them, numbered on."""
    own = written(lexical(spark, d).where("rank <= 5").select("item_id", "doc_id", F.col("rank").cast("long").alias("number")))
    before = own.withColumn("item_id", F.col("item_id") + 1)
    return carried_over(own, before, ["item_id"], "doc_id", "number", 5)
