"""Joins by position, path, box and type, siblings, and measures of stored things."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.text import tokens
from docquarry.operators.intervals import counts_in_boxes
from docquarry.operators.ranking import numbered, top_of_group
from docquarry.sources.tables import table

from .registry import query
from .retrieval import WORDS


@query(
    """WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(n_regionkey))) AS types FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT o_orderkey, CASE WHEN types IS NULL THEN 'unclassified' WHEN len(types) > 1 THEN 'ambiguous' ELSE r_name END AS type FROM orders LEFT JOIN s ON l_orderkey = o_orderkey LEFT JOIN region ON len(types) = 1 AND r_regionkey = types[1]"""
)
def join_type_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The type of an order by its suppliers' regions; ambiguous where they differ, unclassified without any."""
    place = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    types = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(place, "l_suppkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("n_regionkey").alias("types"))
    named = table(spark, d, "orders").select("o_orderkey").join(types, "o_orderkey", "left").withColumn("r_regionkey", F.when(F.size("types") == 1, F.element_at("types", 1)))
    out = F.when(F.col("types").isNull(), "unclassified").when(F.size("types") > 1, "ambiguous").otherwise(F.col("r_name"))
    return named.join(table(spark, d, "region"), "r_regionkey", "left").select("o_orderkey", out.alias("type"))


@query(
    """SELECT p_partkey, count(l_orderkey) AS n, count(DISTINCT l_orderkey) AS orders FROM part LEFT JOIN lineitem ON l_quantity BETWEEN p_size - 1 AND p_size + 1 AND l_extendedprice BETWEEN p_retailprice * 20 AND p_retailprice * 20 + 400 GROUP BY 1"""
)
def join_point_in_box(spark: SparkSession, d: str) -> DataFrame:
    """Lines as points of quantity and price in a box of each part."""
    boxes = table(spark, d, "part").select("p_partkey", (F.col("p_size") - 1.0).alias("x0"), (F.col("p_size") + 1.0).alias("x1"), (F.col("p_retailprice") * 20).alias("y0"), (F.col("p_retailprice") * 20 + 400).alias("y1"))
    found = counts_in_boxes(table(spark, d, "lineitem"), boxes, "l_orderkey", "l_quantity", "l_extendedprice", 4, 500, 400).withColumnRenamed("items", "orders")
    return boxes.join(found, ["x0", "x1", "y0", "y1"], "left").select("p_partkey", "n", "orders").na.fill(0)


@query(
    """WITH l AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_partkey FROM lineitem)
    SELECT a.g, a.k, coalesce(array_to_string((list(b.k ORDER BY abs(a.k - b.k), b.k) FILTER (b.k IS NOT NULL))[1:2], ','), '') AS nearest, count(b.k) AS siblings FROM l a LEFT JOIN l b ON a.g = b.g AND a.k <> b.k GROUP BY ALL"""
)
def join_nearest_siblings(spark: SparkSession, d: str) -> DataFrame:
    """For each line its two nearest siblings of the order, and how many it has: the others of the group, itself taken out."""
    order = Window.partitionBy("g").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").withColumn("k", F.row_number().over(order)).select("g", "k")
    near = F.array_compact(F.array(*[F.lag("k", n).over(Window.partitionBy("g").orderBy("k")) for n in (1, 2)], *[F.lead("k", n).over(Window.partitionBy("g").orderBy("k")) for n in (1, 2)]))
    by = F.transform(F.array_sort(F.transform(near, lambda x: F.struct(F.abs(x - F.col("k")).alias("d"), x.alias("x")))), lambda s: s["x"])
    siblings = F.count("*").over(Window.partitionBy("g")) - 1
    return lines.select("g", "k", F.array_join(F.slice(by, 1, 2).cast("array<string>"), ",").alias("nearest"), siblings.alias("siblings"))


@query(
    """WITH o AS (SELECT l_partkey, l_linenumber, count(*) AS old FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY 1, 2), n AS (SELECT l_partkey, l_linenumber, count(*) AS new, min(l_orderkey) AS at FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
    SELECT o.l_partkey, o.l_linenumber, old, coalesce(new, 0) AS new, at AS first_new, CASE WHEN new IS NULL THEN 'lost' WHEN new > 1 THEN 'ambiguous' ELSE 'pinned' END AS status FROM o LEFT JOIN n USING (l_partkey, l_linenumber)""".replace(" AS at FROM", " AS at_key FROM").replace("at AS first_new", "at_key AS first_new")
)
def join_repinned_paths(spark: SparkSession, d: str) -> DataFrame:
    """Places (part, line number) of an old reading looked up in a new one: pinned, ambiguous or lost."""
    l = table(spark, d, "lineitem")
    path = ["l_partkey", "l_linenumber"]
    old = l.where("l_linestatus = 'F' and l_returnflag = 'R'").groupBy(*path).agg(F.count("*").alias("old"))
    new = l.where("l_linestatus = 'O'").groupBy(*path).agg(F.count("*").alias("new"), F.min("l_orderkey").alias("first_new"))
    status = F.when(F.col("new").isNull(), "lost").when(F.col("new") > 1, "ambiguous").otherwise("pinned")
    return old.join(new, path, "left").select(*path, "old", F.coalesce("new", F.lit(0)).cast("long").alias("new"), "first_new", status.alias("status"))


@query(
    """WITH m AS (SELECT e.vec_id, e.label, len(embedding) = 64 AS sized, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 3) = 1 AS unit, d.n_chars = length(d.text) AS matches FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)
    SELECT label, count(*) AS n, bool_and(sized) AS sized, bool_and(unit) AS unit, count(matches) AS with_text, bool_and(matches) AS matches FROM m GROUP BY 1"""
)
def join_verified_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with the texts of their numbers: whether all have the length, are of unit norm, and match what the table says."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), (F.col("n_chars") == F.length("text")).alias("matches"))
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    met = table(spark, d, "embeddings").select("vec_id", "label", (F.size("embedding") == 64).alias("sized"), (F.round(norm, 3) == 1).alias("unit")).join(docs, "vec_id", "left")
    return met.groupBy("label").agg(F.count("*").alias("n"), F.bool_and("sized").alias("sized"), F.bool_and("unit").alias("unit"), F.count("matches").alias("with_text"), F.bool_and("matches").alias("matches"))


#: Window profiles (name, tokens, overlap).
ENDS = [("a", 256, 32), ("b", 512, 64), ("c", 800, 96)]


@query(
    f"""WITH w AS (SELECT doc_id, len({WORDS}) AS n FROM documents), e AS ({" UNION ALL ".join(f"SELECT doc_id, '{p}' AS profile, least(n, k * {s - o} + {s}) AS stop FROM w, range(0, 100000) t(k) WHERE k = 0 OR k * {s - o} + {o} < n" for p, s, o in ENDS)})
    SELECT doc_id, stop, bool_or(profile = 'a') AS a, bool_or(profile = 'b') AS b, bool_or(profile = 'c') AS c FROM e GROUP BY ALL"""
)
def join_boundary_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Where chunks of three window profiles end in each document, and which profiles end there."""
    n = table(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n"))

    def ends_of(profile: str, size: int, overlap: int):
        last = F.greatest(F.lit(0), F.ceil((F.col("n") - overlap) / (size - overlap)).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.lit(profile).alias("p"), F.least(F.col("n"), k * (size - overlap) + size).alias("stop")))

    ends = F.flatten(F.array(*[ends_of(*profile) for profile in ENDS]))
    rows = n.select("doc_id", F.explode(ends).alias("e")).select("doc_id", "e.*")
    return rows.groupBy("doc_id", "stop").agg(*[F.bool_or(F.col("p") == p).alias(p) for p, _, _ in ENDS])


@query(
    """WITH t AS (SELECT source, md5(coalesce(text, '')) AS h, doc_id, lang = 'en' AS final FROM documents), b AS (SELECT h, arg_min(doc_id, (NOT final, doc_id)) AS best, count(DISTINCT source) AS sources, count(*) AS copies FROM t GROUP BY 1)
    SELECT h AS digest, best, sources, copies, substr(md5('seed7:' || h), 1, 1) = '0' AS control FROM b"""
)
def agg_best_of_digest(spark: SparkSession, d: str) -> DataFrame:
    """Texts by digest: the best reading (a final one first), how many sources have it, and whether it is in the seeded control sample."""
    own = table(spark, d, "documents").select("source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "doc_id", (F.col("lang") != "en").alias("draft"))
    by = own.groupBy("digest").agg(F.min(F.struct("draft", "doc_id")).alias("b"), F.countDistinct("source").alias("sources"), F.count("*").alias("copies"))
    control = F.substring(F.md5(F.concat(F.lit("seed7:"), "digest")), 1, 1) == "0"
    return by.select("digest", F.col("b.doc_id").alias("best"), "sources", "copies", control.alias("control"))


@query("""SELECT source, lang, count(*) AS n, count(DISTINCT md5(text)) AS distinct_texts, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, round(coalesce(sum(strlen(text)), 0) / 1048576.0, 3) AS mb FROM documents GROUP BY ALL""")
def agg_storage(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of texts as stored, and distinct texts."""
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct(F.md5("text")).alias("distinct_texts"), size.alias("bytes"), F.round(size / 1048576, 3).alias("mb"))


@query(
    """WITH w AS (SELECT l_linestatus = 'O' AS loaded, date_diff('day', o_orderdate, l_shipdate)::BIGINT AS ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey), h AS (SELECT loaded, ms, count(*) AS n FROM w GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY loaded ORDER BY ms) AS upto, sum(n) OVER (PARTITION BY loaded) AS total FROM h), p AS (SELECT loaded, min(ms) FILTER (upto >= ceil(total * 0.5)) AS p50, min(ms) FILTER (upto >= ceil(total * 0.95)) AS p95, max(total)::BIGINT AS n FROM c GROUP BY 1)
    SELECT coalesce(sum(n) FILTER (NOT loaded), 0)::BIGINT AS n_alone, coalesce(sum(n) FILTER (loaded), 0)::BIGINT AS n_loaded, max(p50) FILTER (NOT loaded) AS p50_alone, max(p95) FILTER (NOT loaded) AS p95_alone, max(p95) FILTER (loaded) AS p95_loaded, max(p95) FILTER (loaded) - max(p95) FILTER (NOT loaded) AS added_p95 FROM p"""
)
def eval_latency_under_load(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of waits alone and under load from a histogram, and what load adds."""
    o, l = table(spark, d, "orders").select("o_orderkey", "o_orderdate"), table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_shipdate")
    waits = o.join(l, o.o_orderkey == l.l_orderkey).select((F.col("l_linestatus") == "O").alias("loaded"), F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long").alias("ms"))
    counts = waits.groupBy("loaded", "ms").agg(F.count("*").alias("n"))
    run = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy("loaded").orderBy("ms")), "total": F.sum("n").over(Window.partitionBy("loaded"))})  # a row a value
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("ms")))
    by = run.groupBy("loaded").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("total").alias("n"))
    of = lambda c, loaded: F.max(F.when(F.col("loaded") if loaded else ~F.col("loaded"), F.col(c)))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return by.agg(zero(of("n", False)).alias("n_alone"), zero(of("n", True)).alias("n_loaded"), of("p50", False).alias("p50_alone"), of("p95", False).alias("p95_alone"), of("p95", True).alias("p95_loaded"), (of("p95", True) - of("p95", False)).alias("added_p95"))


@query(
    """WITH l AS (SELECT lang, n_chars, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k FROM documents) SELECT lang, (k - 1) // 32 AS batch, count(*) AS n, max(n_chars) AS longest, (count(*) * max(n_chars) - sum(n_chars))::BIGINT AS padding FROM l GROUP BY ALL"""
)
def order_padding_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 32 documents of a language by length, and what padding to the longest costs. Lengths are counted before documents are numbered."""
    docs = table(spark, d, "documents").select("lang", "n_chars", "doc_id")
    counts = docs.groupBy("lang", "n_chars").agg(F.count("*").alias("held"))
    counts = counts.withColumn("before", F.sum("held").over(Window.partitionBy("lang").orderBy("n_chars")) - F.col("held"))  # a row a length
    k = F.col("before") + F.row_number().over(Window.partitionBy("lang", "n_chars").orderBy("doc_id")) - 1
    batches = docs.join(counts, ["lang", "n_chars"]).withColumn("batch", F.floor(k / 32))
    return batches.groupBy("lang", "batch").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), (F.count("*") * F.max("n_chars") - F.sum("n_chars")).alias("padding"))


@query(
    """WITH l AS (SELECT source, substr(md5(doc_id::VARCHAR), 1, 2) AS block, row_number() OVER (PARTITION BY source, substr(md5(doc_id::VARCHAR), 1, 2) ORDER BY md5(doc_id::VARCHAR)) AS k, ceil(n_chars / 4.0)::BIGINT AS c FROM documents),
    r AS (WITH RECURSIVE f AS (SELECT source, block, k, 0 AS batch, c AS used, 1 AS n FROM l WHERE k = 1 UNION ALL SELECT f.source, f.block, l.k, CASE WHEN n >= 3 OR used + l.c > 900 THEN batch + 1 ELSE batch END, CASE WHEN n >= 3 OR used + l.c > 900 THEN l.c ELSE used + l.c END, CASE WHEN n >= 3 OR used + l.c > 900 THEN 1 ELSE n + 1 END
      FROM f JOIN l ON l.source = f.source AND l.block = f.block AND l.k = f.k + 1) SELECT * FROM f)
    SELECT source, block, batch, count(*) AS n, max(used) AS tokens FROM r GROUP BY ALL"""
)
def window_greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches in hash order of three texts or 900 tokens at most, within blocks of the hash: a fold sees one block."""
    h = F.md5(F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").select("source", F.substring(h, 1, 2).alias("block"), F.struct(h.alias("h"), F.ceil(F.col("n_chars") / 4).cast("long").alias("c")).alias("x"))
    ordered = rows.groupBy("source", "block").agg(F.array_sort(F.collect_list("x")).alias("r"))
    state = F.struct(F.array().cast("array<struct<batch:int,c:bigint>>").alias("out"), F.lit(0).alias("batch"), F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"))

    def step(acc, x):
        new = (acc["n"] >= 3) | ((acc["n"] > 0) & (acc["used"] + x["c"] > 900))
        batch = F.when(new, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(
            F.array_append(acc["out"], F.struct(batch.alias("batch"), x["c"].alias("c"))).alias("out"), batch.alias("batch"), F.when(new, x["c"]).otherwise(acc["used"] + x["c"]).alias("used"), F.when(new, F.lit(1)).otherwise(acc["n"] + 1).alias("n")
        )

    folded = ordered.select("source", "block", F.explode(F.aggregate("r", state, step)["out"]).alias("o"))
    return folded.groupBy("source", "block", F.col("o.batch").alias("batch")).agg(F.count("*").alias("n"), F.sum("o.c").alias("tokens"))


@query(
    """WITH o AS (SELECT o_orderpriority, o_custkey, o_orderkey, o_orderdate FROM orders), g AS (SELECT o_orderpriority, o_custkey, min(o_orderkey) AS first, count(*) AS n, max(o_orderdate) AS newest FROM o GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY first) AS place FROM g"""
)
def window_first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups in the order in which they were first seen; a priority's groups are numbered by blocks."""
    by = table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))
    return numbered(by, ["o_orderpriority"], "first", "place")


@query(
    """SELECT o_custkey, o_orderkey AS run, o_orderdate AS created, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
)
def window_latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The newest matching run of each owner."""
    runs = table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')")
    newest = top_of_group(runs, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 1)
    return newest.select("o_custkey", F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("created"), "o_totalprice")


@query(
    """WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS next_role, position, token FROM (SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), ' ')) AS token, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS position FROM conversations)),
    a AS (SELECT conv_id, turn // 2 AS pair, position, token FROM t WHERE role = 'user'), b AS (SELECT conv_id, turn // 2 AS pair, position, token FROM t WHERE role = 'assistant')
    SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pair, b.pair) AS pair, count(a.token) AS asked, count(b.token) AS answered, count(*) FILTER (a.token = b.token) AS same, bool_and(a.token IS NOT NULL AND b.token IS NOT NULL) AS aligned
    FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.pair = b.pair AND a.position = b.position GROUP BY ALL"""
)
def join_positions(spark: SparkSession, d: str) -> DataFrame:
    """Words of a question and of its answer joined by position: how many each has, how many agree, whether the positions are the same."""
    words = table(spark, d, "conversations").select("conv_id", (F.floor(F.col("turn") / 2)).alias("pair"), "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("position", "token"))
    of = lambda role, name: words.where(F.col("role") == role).select("conv_id", "pair", "position", F.col("token").alias(name))
    met = of("user", "a").join(of("assistant", "b"), ["conv_id", "pair", "position"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return met.groupBy("conv_id", "pair").agg(F.count("a").alias("asked"), F.count("b").alias("answered"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.bool_and(both).alias("aligned"))


@query(
    """WITH m AS (SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '5-LOW' THEN 0 ELSE floor(o_totalprice)::BIGINT END AS amount FROM orders)
    SELECT o_custkey, o_orderkey, amount, CASE WHEN amount > 0 THEN row_number() OVER (PARTITION BY o_custkey, amount > 0 ORDER BY amount DESC, o_orderkey) END AS place FROM m"""
)
def order_decidable_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer by amount; rows whose amount is missing or zero have no place."""
    amount = F.when(F.col("o_orderpriority") == "1-URGENT", None).when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(F.floor("o_totalprice")).cast("long")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", amount.alias("amount"))
    order = Window.partitionBy("o_custkey", F.col("amount") > 0).orderBy(F.desc("amount"), "o_orderkey")
    return rows.select("*", F.when(F.col("amount") > 0, F.row_number().over(order)).alias("place"))
