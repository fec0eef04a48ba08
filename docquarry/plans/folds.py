"""Queries that fold decisions and headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.taxonomy import current_types, heading_paths, since_when
from docquarry.sources.tables import table
from docquarry.streaming.settlements import reconciled
from docquarry.streaming.windows import event_stream

from .registry import query

FOLDED = """c AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT o_orderkey AS note, k, n, r FROM orders JOIN c ON o_custkey = k),
t AS (SELECT note, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a' || k WHEN 3 THEN 's' || k || '-' || note % 2 WHEN 4 THEN 'p' || k
  ELSE CASE n % 3 WHEN 0 THEN CASE WHEN r = 0 THEN NULL ELSE 'r' || r END WHEN 1 THEN 'm' || n || '-' || note % 3 ELSE 'm' || n END END AS type FROM o)"""


def decisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(notes, steps, parts, accepted). Orders are notes, first in a proposed type of their customer; by the customer's number it is rejected, accepted, merged into
    one of the nation, split by order or left open; the nation's type is merged into the region's, split or left, and region 0's rejected."""
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("note"), F.col("o_custkey").alias("k"))
    notes = orders.join(customers, "k").select("note", name("p", "k").alias("type"))
    kind, nations = F.col("k") % 5, customers.select("n", "r").distinct()
    into = F.when(kind == 1, name("a", "k")).when(kind == 2, name("m", "n"))
    steps = customers.where(kind < 3).select(name("p", "k").alias("ref"), into.alias("into"))
    steps = steps.unionByName(nations.where("n % 3 = 0").select(name("m", "n").alias("ref"), name("r", "r").alias("into")))
    steps = steps.unionByName(nations.where("r = 0").select(F.lit("r0").alias("ref"), F.lit(None).cast("string").alias("into")).distinct())
    own = orders.join(customers, "k")
    part = lambda letter, column, by: F.concat(name(letter, column), F.lit("-"), (F.col("note") % by).cast("string")).alias("into")
    parts = own.where(kind == 3).select(name("p", "k").alias("ref"), "note", part("s", "k", 2))
    parts = parts.unionByName(own.where((kind == 2) & (F.col("n") % 3 == 1)).select(name("m", "n").alias("ref"), "note", part("m", "n", 3)))
    accepted = customers.where(kind.isin(1, 2)).select(into.alias("type"), F.col("k").alias("at"))
    return notes, steps, parts, accepted


@query(f"WITH {FOLDED} SELECT type, count(*) AS notes, min(note) AS first_note FROM t GROUP BY type")
def ledger_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Types after all decisions, and their notes."""
    notes, steps, parts, _ = decisions(spark, d)
    return current_types(notes, steps, parts).groupBy("type").agg(F.count("*").alias("notes"), F.min("note").alias("first_note"))


@query(
    f"""WITH {FOLDED}, a AS (SELECT 'a' || k AS type, k AS since FROM c WHERE k % 5 = 1 UNION ALL SELECT 'm' || n, k FROM c WHERE k % 5 = 2 UNION ALL SELECT 'r' || r, k FROM c WHERE k % 5 = 2 AND n % 3 = 0
      UNION ALL SELECT 'm' || n || '-' || note % 3, k FROM o WHERE n % 3 = 1 AND k % 5 = 2 UNION ALL SELECT 'm' || o.n || '-' || o.note % 3, c.k FROM o JOIN c ON c.n = o.n AND c.k % 5 = 2 WHERE o.n % 3 = 1 AND o.k % 5 = 2)
    SELECT type, min(since) AS since FROM a GROUP BY type"""
)
def ledger_taxonomy_since(spark: SparkSession, d: str) -> DataFrame:
    """Since when each accepted type's criterion has existed: the earliest acceptance of what went into it."""
    _, steps, parts, accepted = decisions(spark, d)
    return since_when(accepted, steps.select("ref", "into").unionByName(parts.select("ref", "into").distinct()))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
    h AS (SELECT doc_id, pos, CASE WHEN length(line) BETWEEN 1 AND 120 THEN (length(line) - 1) // 20 + 1 END AS level FROM l), g AS (SELECT * FROM h WHERE level IS NOT NULL),
    u AS (SELECT a.doc_id, a.pos, min(b.pos) AS ended FROM g a LEFT JOIN g b ON b.doc_id = a.doc_id AND b.pos > a.pos AND b.level <= a.level GROUP BY ALL),
    p AS (SELECT h.doc_id, h.pos, count(u.pos) AS depth, coalesce(string_agg(u.pos::VARCHAR, '/' ORDER BY u.pos), '') AS path FROM h LEFT JOIN u ON u.doc_id = h.doc_id AND u.pos <= h.pos AND (u.ended IS NULL OR u.ended > h.pos) GROUP BY ALL)
    SELECT doc_id, count(*) AS n_lines, max(depth) AS deepest, count(DISTINCT path) AS paths, md5(string_agg(path, ',' ORDER BY pos)) AS paths_md5 FROM p GROUP BY 1"""
)
def window_heading_stack(spark: SparkSession, d: str) -> DataFrame:
    """Paths of headings over the lines of each text, at six levels by the length of a line."""
    text = table(spark, d, "documents").where("text is not null")
    level = lambda x: F.when(F.length(x).between(1, 120), F.floor((F.length(x) - 1) / 20) + 1)
    found = heading_paths(text.select("doc_id", F.transform(F.split("text", "\n"), level).alias("levels")), "levels")
    path = F.concat_ws("/", F.transform("path", lambda k: k.cast("string")))
    by = found.select("doc_id", "at", F.size("path").alias("depth"), path.alias("path")).groupBy("doc_id")
    listed = F.md5(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"])))
    return by.agg(F.count("*").alias("n_lines"), F.max("depth").alias("deepest"), F.countDistinct("path").alias("paths"), listed.alias("paths_md5"))


@query(
    """SELECT event_type, floor(epoch(ts) / 604800)::BIGINT AS week, sum(round(value * 1000)::BIGINT)::BIGINT AS total, count(*) AS n, 1::BIGINT AS closings FROM events GROUP BY 1, 2"""
)
def ledger_late_settlements(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of a stream of settlements by kind: what each closed with and its later corrections, together."""
    stream = event_stream(spark, f"{d}/events.parquet", per_trigger=1).withColumn("micro", F.round(F.col("value") * 1000).cast("long"))
    rows = reconciled(stream, "event_type", "ts", "micro", 604800, 86400)
    by = rows.groupBy(F.col("scope").alias("event_type"), F.col("interval").alias("week"))
    return by.agg(F.sum("amount").alias("total"), F.sum("n").alias("n"), F.count_if(F.col("kind") == "closed").alias("closings"))
