"""Joins, aggregations, windows and set operations over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.statistics import percentiles
from docquarry.operators.governance import compare_rows, config_diff
from docquarry.operators.intervals import islands, overlap_join, sweep, union_length
from docquarry.operators.ranking import first_occurrence, top_of_group
from docquarry.sources.tables import table

from .registry import query


@query(
    """SELECT n_name, r_name, count(*) AS orders, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def join_star(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey"))
    joined = joined.join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left_outer_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    joined = table(spark, d, "customer").join(stats, F.expr("c_custkey = o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "most")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order that is finished."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return table(spark, d, "customer").join(urgent, F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    many = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(many, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def join_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    latest = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return latest.select("o_custkey", "x.o_orderkey", "x.o_orderdate")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def join_first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return first_occurrence(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY p_name) AS parts, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def join_grouped_list(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each order; an order has few lines."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return joined.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("p_name")), "; ").alias("parts"), F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT o_custkey AS k, bool_and(o_orderstatus = 'F') AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
    a AS (SELECT o_custkey AS k, bool_and(o_orderstatus = 'F') AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
    SELECT coalesce(b.k, a.k) AS k, b.v AS before, a.v AS after, CASE WHEN b.v IS NULL OR a.v IS NULL THEN 'incomparable' WHEN NOT b.v AND NOT a.v THEN 'both_failed'
    WHEN NOT b.v THEN 'improved' WHEN NOT a.v THEN 'regressed' ELSE 'same' END AS status FROM b FULL JOIN a ON a.k = b.k"""
)
def join_full_outer_status(spark: SparkSession, d: str) -> DataFrame:
    """Before and after a date: what changed for each customer."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    side = lambda test: o.where(test).groupBy("k").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("v"))
    return compare_rows(side("o_orderdate < TIMESTAMP '1996-01-01'"), side("o_orderdate >= TIMESTAMP '1996-01-01'"), "k", "v")


RANGES = """WITH a AS (SELECT o_custkey AS k, o_orderkey AS id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS s FROM orders),
r AS (SELECT k, id, s AS s, s + 60 AS e FROM a)"""


def order_ranges(spark: SparkSession, d: str) -> DataFrame:
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + 60).alias("end"))


@query(f"{RANGES} SELECT x.k, x.id, y.id AS other FROM r x JOIN r y ON x.k = y.k AND x.s < y.e AND y.s < x.e AND x.id < y.id")
def join_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a customer's orders that were open together."""
    r = order_ranges(spark, d)
    other = r.selectExpr("k", "id AS other", "start AS other_start", "end AS other_end")
    return overlap_join(r, other, ["k"], 90).where("id < other").select("k", "id", "other")


@query(
    f"""{RANGES}, w AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r)
    SELECT k, sum(greatest(0, e - greatest(s, coalesce(m, s))))::BIGINT AS covered, sum(e - s - greatest(0, e - greatest(s, coalesce(m, s))))::BIGINT AS repeated FROM w GROUP BY k"""
)
def window_interval_union(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a customer had an open order, and those counted more than once."""
    return union_length(order_ranges(spark, d).select("k", "start", "end"), ["k"])


@query(
    f"""{RANGES}, b AS (SELECT DISTINCT k, unnest([s, e]) AS x FROM r), g AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) AS y FROM b)
    SELECT g.k, g.x AS start, g.y AS "end", string_agg(id::VARCHAR, ',' ORDER BY id) AS items FROM g JOIN r ON r.k = g.k AND r.s < g.y AND g.x < r.e WHERE y IS NOT NULL GROUP BY ALL"""
)
def window_sweep_segments(spark: SparkSession, d: str) -> DataFrame:
    """Disjoint segments with the orders open in each."""
    return sweep(order_ranges(spark, d), ["k"], "id").select("k", "start", "end", F.array_join("items", ",").alias("items"))


@query(
    """WITH w AS (SELECT user_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts)) > 86400 THEN 1 ELSE 0 END AS new FROM events),
    i AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY epoch(ts)) AS island FROM w)
    SELECT user_id, island::BIGINT AS island, count(*) AS n FROM i GROUP BY ALL"""
)
def window_gaps_and_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events without a pause of over a day."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return islands(e, ["user_id"], "at", 86400e6).groupBy("user_id", "island").agg(F.count("*").alias("n"))


@query(
    """SELECT c_mktsegment, c_custkey, c_acctbal, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3"""
)
def window_top_of_group(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return top_of_group(c, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query(
    """SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w - l_quantity AS before, lag(l_partkey) OVER w AS previous, lead(l_partkey) OVER w AS next,
    l_linenumber / max(l_linenumber) OVER (PARTITION BY l_orderkey)::DOUBLE AS share FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)"""
)
def window_offsets_and_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Running offset, neighbours and relative place of each line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    share = F.col("l_linenumber") / F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("l_quantity")).alias("before"),
        F.lag("l_partkey").over(w).alias("previous"),
        F.lead("l_partkey").over(w).alias("next"),
        share.alias("share"),
    )


@query(
    """SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS last_urgent,
    first_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_urgent
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def window_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last and the next anchor of each row."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))
    last = F.last(urgent, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(urgent, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", last.alias("last_urgent"), following.alias("next_urgent"))


@query(
    """SELECT s_suppkey, s_nationkey, percent_rank() OVER w AS pr, ntile(4) OVER w AS quarter, nth_value(s_suppkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
    FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)"""
)
def window_rank_statistics(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    second = F.nth_value("s_suppkey", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.percent_rank().over(w).alias("pr"), F.ntile(4).over(w).alias("quarter"), second.alias("second"))


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END) AS discounted,
    coalesce(sum(CASE WHEN l_tax > 0.09 THEN l_quantity END), 0) AS taxed, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL"""
)
def agg_conditional_sums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(0.0)).alias("discounted"),
        F.coalesce(F.sum(F.when(F.col("l_tax") > 0.09, F.col("l_quantity"))), F.lit(0.0)).alias("taxed"),
        F.countDistinct("l_suppkey").alias("suppliers"),
    )


@query("SELECT split_part(p_type, ' ', 1) AS kind, count(*) AS n, min(p_retailprice) AS least FROM part GROUP BY 1 HAVING count(*) > 1")
def agg_expression_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"), F.min("p_retailprice").alias("least")).where("n > 1")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    """SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 2) AS median, round(quantile_cont(c_acctbal, 0.95), 2) AS p95,
    list_sort(list(c_acctbal))[floor(0.9 * (count(*) - 1) + 0.5)::INT + 1] AS nearest90 FROM customer GROUP BY 1"""
)
def agg_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles."""
    found = percentiles(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", {"nearest90": 0.9}, {"median": 0.5, "p95": 0.95})
    return found.withColumn("median", F.round("median", 2)).withColumn("p95", F.round("p95", 2))


@query(
    """SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) + grouping(o_orderpriority) AS level, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"""
)
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    level = (F.grouping("o_orderstatus") + F.grouping("o_orderpriority")).cast("long")
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(level.alias("level"), F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query(
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1"""
)
def agg_confusion_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return wide.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT width::BIGINT AS low, count(*) AS n FROM (SELECT floor(l_quantity / 10) * 10 AS width FROM lineitem) GROUP BY 1")
def agg_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy((F.floor(F.col("l_quantity") / 10) * 10).alias("low")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")).subtract(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("key")).intersect(t.where("l_linestatus = 'O' AND l_quantity > 45").select("l_partkey"))


@query(
    """SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'line', l_orderkey, l_shipdate FROM lineitem WHERE l_extendedprice > 90000"""
)
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_totalprice > 300000").selectExpr("'order' AS kind", "o_orderkey AS id", "o_orderdate AS at")
    return a.unionByName(table(spark, d, "lineitem").where("l_extendedprice > 90000").selectExpr("'line' AS kind", "l_orderkey AS id", "l_shipdate AS at"))


@query(
    """WITH u AS (SELECT o_custkey AS k, 1 AS p, o_orderkey AS v FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders)
    SELECT k, arg_min(v, p * 1000000000000 + v) AS v, min(p) AS source FROM u GROUP BY k"""
)
def set_union_first_source_wins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderpriority")
    both = o.where("o_orderpriority = '1-URGENT'").withColumn("p", F.lit(1)).unionByName(o.withColumn("p", F.lit(2)))
    return both.groupBy("k").agg(F.min(F.struct("p", "v")).alias("x")).select("k", "x.v", F.col("x.p").alias("source"))


@query(
    """WITH a AS (SELECT o_orderkey AS q, list(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS x, list(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT q, coalesce(len(list_filter(x, lambda v: NOT list_contains(coalesce(y, []), v))), 0)::INT AS only_a, coalesce(len(list_filter(y, lambda v: NOT list_contains(coalesce(x, []), v))), 0)::INT AS only_b,
    coalesce(len(list_intersect(x, y)), 0)::INT AS common FROM a"""
)
def set_evidence_difference(spark: SparkSession, d: str) -> DataFrame:
    """What only one run, only the other, and both cite."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(
        F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("x"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("y")
    )
    size = F.size
    return t.select("q", size(F.array_except("x", "y")).alias("only_a"), size(F.array_except("y", "x")).alias("only_b"), size(F.array_intersect("x", "y")).alias("common"))


@query(
    """WITH a AS (SELECT o_orderpriority AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS key, a.v AS a, b.v AS b FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v"""
)
def set_config_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    side = lambda t: o.where(t).groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("v"))
    return config_diff(side("o_orderstatus = 'F'"), side("o_orderstatus <> 'P'"))


@query(
    """SELECT s.s_nationkey AS k, count(*) AS n, max(s_acctbal) AS best, count(*) FILTER (s_acctbal = m) * 2 <= count(*) AS marked FROM supplier s JOIN (SELECT s_nationkey, max(s_acctbal) AS m FROM supplier GROUP BY 1) x ON x.s_nationkey = s.s_nationkey GROUP BY 1"""
)
def order_best_value_marked(spark: SparkSession, d: str) -> DataFrame:
    """The best value of a group, marked only if at most half of the group holds it."""
    s = table(spark, d, "supplier")
    counted = s.groupBy(F.col("s_nationkey").alias("k"), "s_acctbal").agg(F.count("*").alias("c"))
    return counted.groupBy("k").agg(F.sum("c").alias("n"), F.max("s_acctbal").alias("best"), (F.max_by("c", "s_acctbal") * 2 <= F.sum("c")).alias("marked"))


@query("SELECT arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS winner, max(o_totalprice) AS merit FROM orders WHERE o_orderstatus = 'F'")
def order_lexicographic_argmax(spark: SparkSession, d: str) -> DataFrame:
    merit = F.max(F.struct("o_totalprice", "o_orderkey"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").agg(merit.alias("x")).select(F.col("x.o_orderkey").alias("winner"), F.col("x.o_totalprice").alias("merit"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def order_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)


@query(
    """SELECT m, s, CASE WHEN m = 'O' THEN NULL ELSE p END AS p, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus AS m FROM orders) CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer)
    CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) LEFT JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) ON o_orderstatus = m AND c_mktsegment = s AND o_orderpriority = p GROUP BY ALL"""
)
def join_axes_product(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of three short axes, with a nulled axis, and its count. The axes are distinct values of enumerations."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    axes = o.select(F.col("o_orderstatus").alias("m")).distinct().crossJoin(c.select(F.col("c_mktsegment").alias("s")).distinct()).crossJoin(o.select(F.col("o_orderpriority").alias("p")).distinct())
    cells = o.join(c, F.expr("o_custkey = c_custkey")).groupBy(F.col("o_orderstatus").alias("m"), F.col("c_mktsegment").alias("s"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    full = axes.join(cells, ["m", "s", "p"], "left").withColumn("p", F.when(F.col("m") != "O", F.col("p")))
    return full.groupBy("m", "s", "p").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(
    """SELECT o.o_orderkey, count(*) AS earlier FROM orders o JOIN (SELECT o_custkey, min(o_orderdate) AS since FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) t
    ON t.o_custkey = o.o_custkey AND o.o_orderdate < t.since WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') GROUP BY 1"""
)
def join_temporal_anti(spark: SparkSession, d: str) -> DataFrame:
    """Orders from before a customer's first urgent one, without a returned line."""
    o = table(spark, d, "orders")
    since = o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    met = o.join(since, "o_custkey").where("o_orderdate < since").join(returned, "o_orderkey", "left_anti")
    return met.groupBy("o_orderkey").agg(F.count("*").alias("earlier"))


@query(
    """WITH s AS (SELECT l_partkey, l_suppkey, l_shipdate, l_quantity FROM lineitem WHERE l_returnflag = 'A')
    SELECT l.l_orderkey, l.l_linenumber, max(s.l_shipdate) AS last_before FROM lineitem l LEFT JOIN s ON s.l_partkey = l.l_partkey AND s.l_shipdate < l.l_shipdate WHERE l.l_returnflag = 'R' GROUP BY ALL"""
)
def join_as_of(spark: SparkSession, d: str) -> DataFrame:
    """For each returned line the latest earlier shipment of the part: both kinds in one ordered window, no range join."""
    t = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')").withColumn("us", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    w = Window.partitionBy("l_partkey").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).over(w)
    returned = t.withColumn("last_before", last).where("l_returnflag = 'R'")
    return returned.groupBy("l_orderkey", "l_linenumber").agg(F.max("last_before").alias("last_before"))
