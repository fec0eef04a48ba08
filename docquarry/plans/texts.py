"""Text queries over documents, pages, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.text import codes, looping, shingles, squashed, tokens
from docquarry.operators.chunking import token_windows
from docquarry.operators.governance import hash_parity_split, proportional_sample, pseudonym, redact, stratified_half, table_digest
from docquarry.sources.tables import table

from .registry import query
from .retrieval import WORDS

RUN5 = "w || ' ' || lead(w, 1) OVER v || ' ' || lead(w, 2) OVER v || ' ' || lead(w, 3) OVER v || ' ' || lead(w, 4) OVER v"


def padded(pad: int) -> str:
    """The key of the pseudonyms under a pad, as SQL writes bytes."""
    return "".join(f"\\x{b ^ pad:02X}" for b in b"key".ljust(64, b"\0"))


SPLIT = r"string_split_regex(coalesce(text, ''), '[ \t\r\n]+')"


@query("SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM documents GROUP BY text HAVING count(*) > 1")
def text_exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal texts, by their hash."""
    grouped = table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.countDistinct("source").alias("sources"))
    return grouped.where("n > 1")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS n FROM l WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) >= 3"""
)
def text_running_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that three or more documents hold, such as headers and licences."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 20)
    each = lines.groupBy("line", "doc_id").agg(F.count("*").alias("n"))  # a common line is first counted within documents
    return each.groupBy("line").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where("docs >= 3")


@query(
    f"""WITH q AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, {RUN5} AS g FROM (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT item_id, {WORDS} AS w FROM benchmark)) WINDOW v AS (PARTITION BY item_id ORDER BY i)) WHERE g IS NOT NULL),
    g AS (SELECT item_id, g, count(*) OVER (PARTITION BY item_id) AS size FROM q),
    ds AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, {RUN5} AS g FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents)) WINDOW v AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL)
    SELECT item_id, doc_id, round(count(*) / max(size), 6) AS contained FROM g JOIN ds USING (g) GROUP BY ALL HAVING count(*) >= 0.8 * max(size)"""
)
def text_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold four fifths or more of a benchmark item's five-word shingles."""
    items = table(spark, d, "benchmark").select("item_id", F.array_distinct(shingles(tokens(F.col("text")), 5)).alias("s"))
    grams = items.select("item_id", F.size("s").alias("size"), F.explode("s").alias("g"))
    held = table(spark, d, "documents").select("doc_id", F.explode(shingles(tokens(F.col("text")), 5)).alias("g")).join(grams.select("g").distinct(), "g", "left_semi").distinct()
    met = held.join(grams, "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return met.where(F.col("n") >= 0.8 * F.col("size")).select("item_id", "doc_id", F.round(F.col("n") / F.col("size"), 6).alias("contained"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '[email]', 'g'),
    'https?://[^ \t\r\n]+', '[url]', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[ipv4]', 'g'), '\+?[0-9][0-9() -]{7,}[0-9]', '[phone]', 'g')) AS redacted_md5 FROM documents"""
)
def text_redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(redact(F.col("text"))).alias("redacted_md5"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) SELECT doc_id, (len(x) >= 12 AND len(list_distinct(x[-12:])) = 1) OR (len(x) >= 48 AND len(list_distinct(x[-48:])) <= 8) AS looping, len(x)::INT AS lines FROM l"""
)
def text_looping(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", looping(lines).alias("looping"), F.size(lines).alias("lines"))


@query(
    f"""SELECT doc_id, k::INT AS k, array_to_string(w[k * 448 + 1:k * 448 + 512], ' ').md5() AS body_md5, least(512, len(w) - k * 448)::INT AS n FROM (SELECT doc_id, w, unnest(range(0, greatest(1, ((len(w) - 64) + 447) // 448))) AS k FROM (SELECT doc_id, {SPLIT} AS w FROM documents))"""
)
def chunk_token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 512 words, 64 shared with the next."""
    words = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "[ \t\r\n]+").alias("w"))
    return token_windows(words, "w", 512, 64).select("doc_id", "k", F.md5(F.array_join("window", " ")).alias("body_md5"), F.size("window").alias("n"))


@query(
    r"""SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs, len(regexp_extract_all(html, '<a [^>]*href='))::INT AS links,
    length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS text_chars, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host FROM pages"""
)
def page_elements(spark: SparkSession, d: str) -> DataFrame:
    """What a page holds, by patterns."""
    count = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1).alias("title"),
        count("<p[ >]").alias("paragraphs"),
        count("<a [^>]*href=").alias("links"),
        F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_chars"),
        F.lower(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)).alias("host"),
    )


@query("SELECT doc_id, regexp_replace(text, '[ \\t\\r\\n]+', '', 'g').md5() AS squashed_md5, length(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g'))::BIGINT AS n FROM documents")
def text_squashed(spark: SparkSession, d: str) -> DataFrame:
    s = squashed(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(s).alias("squashed_md5"), F.length(s).cast("long").alias("n"))


@query("SELECT o_orderpriority, list_distinct(list_filter(regexp_extract_all('SFR-' || (o_orderkey % 100)::VARCHAR || ' and SFR-' || o_custkey::VARCHAR, '[A-Z]{1,5}R-[0-9]+'), lambda c: length(split_part(c, '-', 2)) <= 4)).len() AS n, count(*) AS orders FROM orders GROUP BY ALL")
def text_requirement_codes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct codes in built lines; a longer number is not a code."""
    o = table(spark, d, "orders")
    line = F.concat(F.lit("SFR-"), (F.col("o_orderkey") % 100).cast("string"), F.lit(" and SFR-"), F.col("o_custkey").cast("string"))
    return o.select("o_orderpriority", F.size(codes(line)).alias("n")).groupBy("o_orderpriority", "n").agg(F.count("*").alias("orders"))


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, role, length(text) AS n, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations),
    e AS (SELECT conv_id, max(turn) AS turn FROM t GROUP BY 1), w AS (SELECT t.conv_id, t.turn, t.n, t.parent, 1 AS k FROM t JOIN e ON e.conv_id = t.conv_id AND e.turn = t.turn
    UNION ALL SELECT t.conv_id, t.turn, t.n, t.parent, k + 1 FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.parent WHERE k < 6) SELECT conv_id, count(*) AS turns, sum(n)::BIGINT AS chars, min(turn) AS first_turn FROM w GROUP BY 1"""
)
def conversation_last_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last six turns of each conversation."""
    c = table(spark, d, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return c.where("k <= 6").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"), F.min("turn").alias("first_turn"))


@query("SELECT source, CASE WHEN ('0x' || right(sha256(doc_id::VARCHAR), 1))::INT % 2 = 0 THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM documents GROUP BY ALL")
def governance_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return hash_parity_split(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "split").agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, quality, toxic, row_number() OVER w <= ceil(count(*) OVER (PARTITION BY quality, toxic) / 2) AS drawn FROM labels WINDOW w AS (PARTITION BY quality, toxic ORDER BY sha256('7:' || doc_id::VARCHAR), doc_id)"""
)
def governance_stratified_half(spark: SparkSession, d: str) -> DataFrame:
    return stratified_half(table(spark, d, "labels"), ["quality", "toxic"], "doc_id", 7)


@query(
    """WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('3:' || doc_id::VARCHAR), doc_id) AS j FROM documents),
    o AS (SELECT p.source, doc_id, row_number() OVER (ORDER BY CASE WHEN j = 1 THEN 0 ELSE 1 END, CASE WHEN j = 1 THEN size ELSE size / j::DOUBLE END DESC, p.source, j) AS pick FROM p JOIN s ON s.source = p.source)
    SELECT * FROM o WHERE pick <= 50"""
)
def governance_proportional_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents: one of each source, then by the highest quotient."""
    return proportional_sample(table(spark, d, "documents"), "source", "doc_id", 50, 3)


@query(
    """WITH h AS (SELECT sha256(concat_ws('|', coalesce('v' || doc_id::VARCHAR, 'n'), coalesce('v' || lang, 'n'), coalesce('v' || n_chars::VARCHAR, 'n'), coalesce('v' || source, 'n'), coalesce('v' || text, 'n'))) AS h FROM documents)
    SELECT count(*) AS n_rows, concat_ws('-', sum(('0x' || substr(h, 1, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 13, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 25, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 37, 12))::BIGINT)::VARCHAR,
      sum(('0x' || substr(h, 49, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 53, 12))::BIGINT)::VARCHAR) AS digest FROM h"""
)
def governance_table_digest(spark: SparkSession, d: str) -> DataFrame:
    return table_digest(table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source", "text"))


@query(
    f"""WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), h AS (SELECT n, sha256('{padded(0x36)}'::BLOB || encode(user_id::VARCHAR)) AS h FROM e WHERE user_id IS NOT NULL)
    SELECT substr(sha256('{padded(0x5C)}'::BLOB || unhex(h)), 1, 12) AS who, n FROM h UNION ALL SELECT NULL, n FROM e WHERE user_id IS NULL"""
)
def governance_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    """Events by pseudonym of their user."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select(pseudonym("key", F.col("user_id")).alias("who"), "n")


@query(
    """SELECT source, count(DISTINCT CASE WHEN ('0x' || right(sha256(doc_id::VARCHAR), 1))::INT % 2 = 0 THEN 'dev' ELSE 'test' END) AS splits, count(*) AS n FROM documents GROUP BY source HAVING count(DISTINCT ('0x' || right(sha256(doc_id::VARCHAR), 1))::INT % 2) > 1"""
)
def governance_family_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Families (here sources) with documents in both splits."""
    split = hash_parity_split(table(spark, d, "documents"), "doc_id")
    return split.groupBy("source").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")
