"""Queries on structured answers: their contract, the ids and fields in them, support word for word, and cited segments of texts.

Answers are made from orders as JSON: an order's lines are its claims and its evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.answers import answer_fields, cited_ids, cited_segments, document_text, mentioned, parsed, validated, verbatim
from docquarry.sources.tables import table

from .registry import query

ALLOWED, SIDES = ("d0", "d1", "d2", "d3"), ("d0", "d1")
LINES = """l AS (SELECT l_orderkey AS k, l_linenumber AS n, 'E' || l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) AS pos, l_tax,
    CASE WHEN l_partkey % 20 = 0 THEN 'out' ELSE 'd' || (l_suppkey % 4) END AS doc, l_quantity AS q, NOT (l_returnflag = 'R' AND l_quantity > 45) AS same,
    CASE WHEN l_quantity > 48 THEN 'absence' WHEN l_linenumber % 3 = 0 THEN 'inference' ELSE 'source_fact' END AS kind FROM lineitem),
    o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'answered' WHEN 'O' THEN 'conflicting_evidence' ELSE 'insufficient_evidence' END AS status, o_custkey % 7 = 0 AS silent, o_custkey % 11 > 0 AS summed,
    o_orderpriority = '1-URGENT' AS compared FROM orders),
    e AS (SELECT DISTINCT ON (k, id) k, id, doc, same FROM l WHERE q > 3 ORDER BY k, id, doc, same)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    doc = F.when(F.col("l_partkey") % 20 == 0, "out").otherwise(F.concat(F.lit("d"), (F.col("l_suppkey") % 4).cast("string")))
    kind = F.when(F.col("l_quantity") > 48, "absence").when(F.col("l_linenumber") % 3 == 0, "inference").otherwise("source_fact")
    stale = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    return t.select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("evidence_id"),
        doc.alias("doc_id"), kind.alias("kind"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("quote"), F.when(stale, "changed").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("stored"),
    )


def answers(spark: SparkSession, d: str, own: DataFrame) -> DataFrame:
    """(o_orderkey, answer, allowed, required): the claims of an order in the order of its lines."""
    id_ = F.col("evidence_id")
    ids = F.when(F.col("l_quantity") == 20, F.array().cast("array<string>")).when(F.col("kind") == "inference", F.array(id_, F.lit("E1"))).otherwise(F.array(id_))
    text = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("doc_id"), F.lit(" ["), id_, F.lit("]"))
    claim = F.struct("kind", "doc_id", text.alias("text"), ids.alias("evidence_ids"))
    side = F.struct("doc_id", F.col("quote").alias("value"), F.array(id_).alias("evidence_ids"))
    rows = own.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", claim.alias("claim"), side.alias("side")))).alias("own"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").join(rows, "o_orderkey", "left")
    lists = lambda kind: F.array().cast(f"array<{kind}>")
    part = lambda name, of: F.transform(of, lambda x: x[name])
    claims = F.coalesce(part("claim", F.col("own")), lists("struct<kind: string, doc_id: string, text: string, evidence_ids: array<string>>"))
    sides = F.coalesce(part("side", F.filter("own", lambda x: x["l_tax"] == 0.08)), lists("struct<doc_id: string, value: string, evidence_ids: array<string>>"))
    open_ = F.col("o_orderstatus") == "O"
    status = F.when(F.col("o_orderstatus") == "F", "answered").when(open_, "conflicting_evidence").otherwise("insufficient_evidence")
    answer = F.struct(
        status.alias("status"), F.lit("as stated [E1]").alias("summary"), F.when(F.col("o_custkey") % 11 > 0, F.array(F.lit("E1"))).otherwise(lists("string")).alias("summary_evidence_ids"), claims.alias("claims"),
        F.when(open_, F.array(F.struct(F.lit("tax").alias("topic"), sides.alias("alternatives")))).alias("conflicts"), F.when(F.col("o_custkey") % 7 == 0, "").otherwise("ask").alias("next_action"),
    )
    required = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(*map(F.lit, SIDES)))
    return o.select("o_orderkey", F.to_json(answer).alias("answer"), F.array(*map(F.lit, ALLOWED)).alias("allowed"), required.alias("required"))


@query(
    f"""WITH {LINES},
    c AS (SELECT l.*, o.status, o.compared AND kind = 'inference' AS wide FROM l JOIN o USING (k)),
    r AS (SELECT k, pos, 1 AS i, id, doc, wide FROM c WHERE kind <> 'absence' AND q <> 20 UNION ALL SELECT k, pos, 2, 'E1', doc, wide FROM c WHERE kind = 'inference' AND q <> 20),
    j AS (SELECT r.*, CASE WHEN e.id IS NULL THEN 'unknown_evidence_id: ' WHEN e.doc <> r.doc AND NOT (wide AND e.doc IN {SIDES}) THEN 'evidence_scope_mismatch: ' WHEN NOT e.same THEN 'evidence_quote_mismatch: ' END || r.id AS p, coalesce(e.doc = r.doc, false) AS own
      FROM r LEFT JOIN e ON r.k = e.k AND r.id = e.id),
    s AS (SELECT k, pos, l_tax, doc, id FROM c WHERE l_tax = 0.08 AND status = 'conflicting_evidence'),
    n AS (SELECT o.k, count(s.k) AS sides FROM o LEFT JOIN s ON o.k = s.k GROUP BY 1), m AS (SELECT o.k, count(l.k) FILTER (l.kind <> 'absence') AS stated, count(*) FILTER (l.doc = 'd0') AS a, count(*) FILTER (l.doc = 'd1') AS b FROM o LEFT JOIN l ON o.k = l.k GROUP BY 1),
    p AS (SELECT k, 1 AS rule, pos, 0 AS i, 'claim_outside_scope: ' || doc AS p FROM c WHERE kind = 'absence' AND doc = 'out'
      UNION ALL SELECT k, 2, 0, 0, CASE WHEN sides < 2 THEN 'conflict_with_one_alternative' ELSE 'conflict_without_next_action' END FROM o JOIN n USING (k) WHERE status = 'conflicting_evidence' AND (sides < 2 OR silent)
      UNION ALL SELECT k, 3, pos, -1, 'claim_outside_scope: ' || doc FROM c WHERE kind <> 'absence' AND doc = 'out'
      UNION ALL SELECT k, 3, pos, 0, 'claim_without_evidence' FROM c WHERE kind <> 'absence' AND q = 20
      UNION ALL SELECT k, 3, pos, i, p FROM j WHERE p IS NOT NULL
      UNION ALL SELECT k, 3, pos, 9, 'evidence_scope_mismatch: inference cites nothing of ' || any_value(doc) FROM j WHERE wide GROUP BY k, pos HAVING bool_and(p IS NULL) AND NOT bool_or(own)
      UNION ALL SELECT k, 4, pos, 0, 'conflict_without_evidence' FROM s WHERE doc = 'out'
      UNION ALL SELECT s.k, 4, pos, 1, CASE WHEN e.id IS NULL THEN 'unknown_evidence_id: ' WHEN e.doc <> s.doc THEN 'evidence_scope_mismatch: ' ELSE 'evidence_quote_mismatch: ' END || s.id FROM s LEFT JOIN e ON s.k = e.k AND s.id = e.id WHERE e.id IS NULL OR e.doc <> s.doc OR NOT e.same
      UNION ALL SELECT k, 6, 0, 0, 'answered_without_claims' FROM o JOIN m USING (k) WHERE status = 'answered' AND stated = 0
      UNION ALL SELECT o.k, 7, 0, 0, CASE WHEN e.id IS NULL THEN 'unknown_evidence_id: E1' ELSE 'evidence_quote_mismatch: E1' END FROM o LEFT JOIN e ON o.k = e.k AND e.id = 'E1' WHERE summed AND (e.id IS NULL OR NOT e.same)
      UNION ALL SELECT k, 8, 0, 0, 'comparison_side_missing: ' || concat_ws(',', CASE WHEN a = 0 THEN 'd0' END, CASE WHEN b = 0 THEN 'd1' END) FROM o JOIN m USING (k) WHERE compared AND (a = 0 OR b = 0)
      UNION ALL SELECT k, 9, 0, 0, 'summary_without_evidence' FROM o WHERE status = 'answered' AND NOT summed)
    SELECT o.k AS o_orderkey, arg_min(p.p, (rule, pos, i)) AS problem, count(p.p) AS n_problems, md5(coalesce(string_agg(p.p, '|' ORDER BY rule, pos, i), '')) AS problems_md5 FROM o LEFT JOIN p ON o.k = p.k GROUP BY 1"""
)
def eval_answer_contract(spark: SparkSession, d: str) -> DataFrame:
    """The first breach of each answer's contract, and all of them in order."""
    own = lines(spark, d)
    evidence = own.where("l_quantity > 3").select("o_orderkey", "evidence_id", "doc_id", "quote", "stored")
    checked = validated(answers(spark, d, own), evidence, "o_orderkey", "answer", "allowed", "required")
    return checked.select("o_orderkey", "problem", F.size("problems").cast("long").alias("n_problems"), F.md5(F.array_join("problems", "|")).alias("problems_md5"))


@query(
    f"""WITH {LINES}, f AS (SELECT k, 'summary' AS field, 'as stated [E1]' AS text FROM o UNION ALL SELECT k, 'next_action', 'ask' FROM o WHERE NOT silent UNION ALL SELECT k, 'claim.' || (pos - 1), 'line ' || n || ' of ' || doc || ' [' || id || ']' FROM l JOIN o USING (k)
    UNION ALL SELECT k, 'conflict.0.' || (row_number() OVER (PARTITION BY k ORDER BY pos) - 1), strftime(s, '%Y-%m-%d') FROM (SELECT k, pos, l_tax, s FROM (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) AS pos, l_tax, l_shipdate AS s FROM lineitem) JOIN o USING (k) WHERE l_tax = 0.08 AND status = 'conflicting_evidence'))
    SELECT k AS o_orderkey, field, text FROM f"""
)
def eval_answer_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every text of every answer under the name by which notes address it."""
    a = parsed(F.col("answer"))
    return answers(spark, d, lines(spark, d)).select("o_orderkey", F.explode(answer_fields(a)).alias("f")).select("o_orderkey", "f.*")


@query(
    f"""WITH {LINES}, i AS (SELECT k, -1 AS pos, 0 AS i, 'E1' AS id FROM o WHERE summed UNION ALL SELECT k, pos, 0, id FROM l WHERE q <> 20 UNION ALL SELECT k, pos, 1, 'E1' FROM l WHERE q <> 20 AND kind = 'inference' UNION ALL SELECT k, 1000 + pos, 0, id FROM l JOIN o USING (k) WHERE l_tax = 0.08 AND status = 'conflicting_evidence'),
    g AS (SELECT k, id, min(pos * 10 + i) AS spot FROM i GROUP BY ALL), c AS (SELECT k, string_agg(id, ',' ORDER BY spot) AS cited FROM g GROUP BY 1),
    t AS (SELECT k, string_agg('line ' || n || ' of d1 [' || id || ']', ' ' ORDER BY pos) AS said FROM l WHERE doc = 'd1' GROUP BY 1)
    SELECT o.k AS o_orderkey, coalesce(cited, '') AS cited, coalesce(length(said), 0)::BIGINT AS d1_chars, contains(coalesce(replace(said, ' ', ''), ''), 'line1ofd1') AS d1_line_1 FROM o LEFT JOIN c USING (k) LEFT JOIN t USING (k)"""
)
def eval_cited_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The ids that each answer cites, once each and in order, and what it says of one document: how much, and whether one statement stands there word for word."""
    rows = answers(spark, d, lines(spark, d).where("doc_id is not null")).withColumn("a", parsed(F.col("answer")))
    said = document_text(F.col("a").withField("conflicts", F.lit(None).cast("array<struct<topic: string, alternatives: array<struct<doc_id: string, value: string, evidence_ids: array<string>>>>>")), F.lit("d1"), F.lit(False))
    return rows.select("o_orderkey", F.array_join(cited_ids(F.col("a")), ",").alias("cited"), F.length(said).cast("long").alias("d1_chars"), verbatim(F.lit("line 1 of d1"), said).alias("d1_line_1"))


@query(
    """WITH q AS (SELECT doc_id, coalesce(text, '') AS t, substr(coalesce(text, ''), 1 + length(coalesce(text, '')) // 3, 12) AS quote FROM documents), p AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND quote <> '' THEN length(t) // 3 WHEN quote <> '' THEN strpos(t, quote) - 1 END AS spot FROM q),
    s AS (SELECT doc_id, unnest(CASE WHEN spot IS NULL THEN [{'text': t, 'cited': false}] ELSE [{'text': substr(t, 1, spot), 'cited': false}, {'text': quote, 'cited': true}, {'text': substr(t, spot + length(quote) + 1), 'cited': false}] END) AS s FROM p)
    SELECT doc_id, count(*) AS segments, sum(length(s.text))::BIGINT AS chars, coalesce(sum(length(s.text)) FILTER (s.cited), 0)::BIGINT AS cited_chars, md5(string_agg(s.text, '' ORDER BY s.cited DESC, s.text)) AS parts_md5 FROM s WHERE length(s.text) > 0 GROUP BY 1"""
)
def text_cited_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each document cut at a quote of its own, found by its recorded place or, where that is wrong, by its first one."""
    t = F.coalesce("text", F.lit(""))
    third = F.floor(F.length(t) / 3).cast("int")
    quote = F.substr(t, third + 1, F.lit(12))
    cut = cited_segments(t, quote, F.when(F.col("doc_id") % 2 == 0, third).otherwise(-1))
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda acc, s: acc + F.length(s["text"]))
    ordered = F.array_sort(F.transform("s", lambda s: F.struct((~s["cited"]).alias("later"), s["text"].alias("text"))))
    rows = table(spark, d, "documents").select("doc_id", cut.alias("s")).where(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("long").alias("segments"), total(F.col("s")).alias("chars"), total(F.filter("s", lambda s: s["cited"])).alias("cited_chars"), F.md5(F.array_join(F.transform(ordered, lambda s: s["text"]), "")).alias("parts_md5"))


@query(
    """WITH s AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day, o_orderkey FROM orders) SELECT a.o_custkey, a.day, a.o_orderkey, coalesce(string_agg(b.o_orderkey::VARCHAR, ',' ORDER BY b.o_orderkey), '') AS others
    FROM s a LEFT JOIN s b ON a.o_custkey = b.o_custkey AND a.day = b.day AND a.o_orderkey <> b.o_orderkey GROUP BY ALL"""
)
def join_linked_members(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the other orders of its customer and day."""
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return mentioned(o, ["o_custkey", "day"], "o_orderkey").select("o_custkey", "day", "o_orderkey", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))
