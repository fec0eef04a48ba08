"""Chunks, paths, sizes, routing and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.statistics import percentiles
from docquarry.functions.text import numbers, sentences, tokens
from docquarry.operators.chunking import pack_rows
from docquarry.operators.ledger import replay
from docquarry.sources.intermediate import written
from docquarry.sources.tables import table

from .registry import query
from .retrieval import BM25, SHINGLES, WORDS, containing


MOVES = {
    ("idle", "view"): "reserved",
    ("reserved", "click"): "dispatching",
    ("reserved", "error"): "released",
    ("dispatching", "purchase"): "settled",
    ("dispatching", "error"): "unknown",
    ("unknown", "purchase"): "settled",
    ("settled", "view"): "reserved",
    ("released", "view"): "reserved",
}
NEXT = "CASE state || '|' || event_type " + " ".join(f"WHEN '{a}|{b}' THEN '{c}'" for (a, b), c in MOVES.items()) + " END"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 'idle' AS state, 0::BIGINT AS moved, 0::BIGINT AS refused FROM e UNION ALL SELECT user_id, k, coalesce(nxt, state), moved + (nxt IS NOT NULL)::INT, refused + (nxt IS NULL)::INT
      FROM (SELECT e.user_id, e.k, f.state, f.moved, f.refused, {NEXT} AS nxt FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
    SELECT user_id, arg_max(state, k) AS state, max(moved) AS moved, max(refused) AS refused FROM f GROUP BY 1"""
)
def ledger_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events replayed as an attempt: reserve, dispatch, settle; events without a move are refused."""
    return replay(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", MOVES, "idle")


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t]+|[\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(s)::INT AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest FROM s"""
)
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


@query(
    r"""WITH s AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')) AS s FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(s)::INT AS n, array_to_string(s, ' ').md5() AS numbers_md5 FROM s WHERE len(s) > 0"""
)
def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", numbers(F.col("text")).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", " ")).alias("numbers_md5"))


@query(
    """WITH RECURSIVE l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_quantity::BIGINT AS c FROM lineitem),
    f AS (SELECT l_orderkey, k, 0 AS chunk, c AS used, c > 48 AS alone FROM l WHERE k = 1 UNION ALL SELECT f.l_orderkey, l.k, CASE WHEN f.used > 0 AND (alone OR f.used + l.c > 60 OR l.c > 48) THEN chunk + 1 ELSE chunk END,
      CASE WHEN f.used > 0 AND (alone OR f.used + l.c > 60 OR l.c > 48) THEN l.c ELSE f.used + l.c END, l.c > 48 FROM f JOIN l ON l.l_orderkey = f.l_orderkey AND l.k = f.k + 1)
    SELECT l_orderkey, chunk, count(*) AS n FROM f GROUP BY ALL"""
)
def chunk_pack_rows(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines packed in order into chunks of 60 units."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("k"), F.col("l_quantity").cast("long").alias("c"))
    return pack_rows(lines, ["l_orderkey"], "k", "c", 60, 48).groupBy("l_orderkey", "chunk").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN turn END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS b FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, concat_ws('/', a, CASE WHEN a IS NULL OR b > a THEN b END) AS path FROM s"""
)
def window_section_path(spark: SparkSession, d: str) -> DataFrame:
    """The path of headings over each row: a higher heading (system) ends the lower one (user)."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    level = lambda role: F.last(F.when(F.col("role") == role, F.col("turn")), True).over(w)
    lower = F.when(F.col("a").isNull() | (F.col("b") > F.col("a")), F.col("b"))
    return table(spark, d, "conversations").withColumn("a", level("system")).withColumn("b", level("user")).select("conv_id", "turn", F.concat_ws("/", "a", lower).alias("path"))


@query(
    """WITH s AS (SELECT lang, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL), g AS (SELECT lang, list_sort(list(n)) AS v, avg(n) AS mean, count(*) AS docs FROM s GROUP BY 1)
    SELECT lang, docs, v[1] AS least, v[floor(0.5 * (docs - 1) + 0.5)::INT + 1] AS p50, v[floor(0.9 * (docs - 1) + 0.5)::INT + 1] AS p90, v[len(v)] AS most, round(mean, 4) AS mean FROM g"""
)
def agg_size_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of document sizes, from a histogram of sizes: a group's values don't meet in one list."""
    sizes = table(spark, d, "documents").where("text IS NOT NULL").groupBy("lang", F.size(F.split("text", " ")).alias("n")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang").orderBy("n")
    laid = sizes.withColumn("upto", F.sum("c").over(w)).withColumn("docs", F.sum("c").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("docs") - 1) + 0.5), F.col("n")))
    return laid.groupBy("lang").agg(
        F.max("docs").alias("docs"), F.min("n").alias("least"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("n").alias("most"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 4).alias("mean")
    )


@query(
    """WITH e AS (SELECT user_id, floor(epoch(ts) / 604800)::BIGINT AS week, round(value * 1000)::BIGINT AS micro, event_type FROM events), s AS (SELECT week, sum(micro)::BIGINT AS total, count(DISTINCT user_id) AS scopes,
    sum(CASE WHEN event_type = 'purchase' THEN micro ELSE 0 END)::BIGINT AS settled FROM e GROUP BY 1) SELECT week, total, scopes, settled, total - settled AS residual, coalesce(total - lag(total) OVER (ORDER BY week), 0)::BIGINT AS change FROM s"""
)
def ledger_reconcile_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Closed weekly intervals: totals, settled parts, what is left, and the change from the one before."""
    e = table(spark, d, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 604800).alias("week"), F.round(F.col("value") * 1000).cast("long").alias("micro"), "event_type")
    s = e.groupBy("week").agg(F.sum("micro").alias("total"), F.countDistinct("user_id").alias("scopes"), F.sum(F.when(F.col("event_type") == "purchase", F.col("micro")).otherwise(0)).alias("settled"))
    change = F.col("total") - F.lag("total").over(Window.orderBy("week"))  # one row a week
    return s.select("week", "total", "scopes", "settled", (F.col("total") - F.col("settled")).alias("residual"), F.coalesce(change, F.lit(0)).alias("change"))


@query(
    f"""WITH t AS (SELECT doc_id, {WORDS.replace("text", "string_split(text, chr(10))[1]")} AS w FROM documents), dt AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM t), n AS (SELECT count(*) AS n FROM t),
    df AS (SELECT term, count(*) AS df FROM dt GROUP BY 1), q AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark),
    m AS (SELECT item_id, doc_id, count(*) AS shared, min(df) AS rarest, round(sum(ln(n.n / df)), 6) AS weight FROM q JOIN dt USING (term) JOIN df USING (term), n GROUP BY ALL),
    c AS (SELECT *, max(weight) OVER (PARTITION BY item_id) AS top, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, doc_id) AS k FROM m WHERE shared >= 2 AND rarest < 4)
    SELECT item_id, doc_id, shared, weight FROM c WHERE k <= 4 AND weight >= 0.5 * top"""
)
def search_route_by_title(spark: SparkSession, d: str) -> DataFrame:
    """At most four documents an item is about: two shared words of the first line, one of them rare, and half the best weight."""
    titles = table(spark, d, "documents").select("doc_id", F.array_distinct(tokens(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("w"))
    terms = titles.select("doc_id", F.explode("w").alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("df"))
    asked = written(table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))
    weights = written(counts.join(asked.select("term").distinct(), "term", "left_semi"))
    part = F.log(F.lit(float(titles.count())) / F.col("df"))
    # an item and a document that share a rare word: at most three documents a word, so common words never pair all of both
    rare = terms.join(weights.where("df < 4"), "term").select("doc_id", "term")
    pairs = written(rare.join(asked, "term").select("item_id", "doc_id").distinct())
    near = terms.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").join(weights, "term")
    met = pairs.join(near, "doc_id").join(asked, ["item_id", "term"])
    found = met.groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.round(F.sum(part), 6).alias("weight")).where("shared >= 2")
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("weight"), "doc_id")))
    top = found.groupBy("item_id").agg(F.max("weight").alias("top"))
    return ranked.where("k <= 4").join(top, "item_id").where("weight >= 0.5 * top").select("item_id", "doc_id", "shared", "weight")


@query(
    f"""WITH {BM25}, {SHINGLES}, p AS (SELECT item_id, doc_id FROM con WHERE rank = 1), a AS (SELECT item_id, c, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark) GROUP BY ALL),
    b AS (SELECT item_id, c, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, '')) AS c FROM p JOIN documents USING (doc_id)) GROUP BY ALL),
    o AS (SELECT a.item_id, sum(least(a.n, b.n)) AS overlap FROM a JOIN b ON a.item_id = b.item_id AND a.c = b.c GROUP BY 1)
    SELECT item_id, doc_id, round(2 * coalesce(overlap, 0) / (length(i.text) + length(d.text)), 6) AS f1 FROM p JOIN benchmark i USING (item_id) JOIN documents d USING (doc_id) LEFT JOIN o USING (item_id)"""
)
def text_character_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Multiset likeness of characters of each item and its best document."""
    best = containing(spark, d).where("rank = 1").select("item_id", "doc_id")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("a"))
    pairs = best.join(items, "item_id").join(table(spark, d, "documents").select("doc_id", F.col("text").alias("b")), "doc_id")
    count = lambda side: pairs.select("item_id", F.explode(F.split(side, "")).alias("c")).groupBy("item_id", "c").agg(F.count("*").alias(f"n_{side}"))
    overlap = count("a").join(count("b"), ["item_id", "c"]).groupBy("item_id").agg(F.sum(F.least("n_a", "n_b")).alias("overlap"))
    f1 = 2 * F.coalesce("overlap", F.lit(0)) / (F.length("a") + F.length("b"))
    return pairs.join(overlap, "item_id", "left").select("item_id", "doc_id", F.round(f1, 6).alias("f1"))


@query(
    """WITH v AS (SELECT source, list_sort(list(n_chars)) AS v, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1) SELECT source, v[floor(0.25 * (n - 1) + 0.5)::INT + 1] AS q1, v[floor(0.75 * (n - 1) + 0.5)::INT + 1] AS q3 FROM v"""
)
def agg_nearest_rank_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(table(spark, d, "documents"), ["source"], "n_chars", {"q1": 0.25, "q3": 0.75})
