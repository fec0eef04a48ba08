"""Datasets, decisions, attempts and checks; customers, orders and events stand for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.statistics import wilson
from docquarry.operators.gold import first_decision, first_reason, release_decision, resume_plan, revision_errors, row_errors
from docquarry.sources.tables import table

from .registry import query


@query(
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN c_custkey IS NULL THEN 'unknown_customer' END, CASE WHEN o_totalprice <= 0 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END,
    CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'early' END, CASE WHEN o_orderpriority LIKE '%NOT%' THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    WHERE errors <> ''"""
)
def governance_row_errors(spark: SparkSession, d: str) -> DataFrame:
    """Orders with all rules that they break."""
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    rules = {
        "unknown_customer": F.col("known").isNull(),
        "price": F.col("o_totalprice") <= 0,
        "status": ~F.col("o_orderstatus").isin("F", "O"),
        "early": F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp"),
        "priority": F.col("o_orderpriority").like("%NOT%"),
    }
    found = row_errors(table(spark, d, "orders").join(known, "o_custkey", "left"), rules)
    return found.where(F.size("errors") > 0).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, lag(l_linenumber, 1, 0) OVER w AS b, lag(l_returnflag) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag))
    SELECT l_orderkey, errors, count(*) AS n FROM (SELECT l_orderkey, concat_ws(',', CASE WHEN l_linenumber = b THEN 'repeated' END, CASE WHEN l_linenumber > b + 1 THEN 'gap' END, CASE WHEN l_returnflag = p THEN 'unchanged' END) AS errors FROM l) WHERE errors <> '' GROUP BY ALL"""
)
def governance_revisions(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as revisions: numbers that repeat or skip, and contents that don't change."""
    bad = revision_errors(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey"], "l_linenumber", "l_returnflag")
    return bad.groupBy("l_orderkey", F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT (props->>'k')::BIGINT AS item, ts, event_id, user_id, event_type FROM events), f AS (SELECT item, arg_min((user_id, event_type), (ts, event_id)) AS f FROM e GROUP BY 1),
    s AS (SELECT e.item, arg_min((user_id, event_type), (ts, event_id)) AS s FROM e JOIN f ON f.item = e.item WHERE user_id <> f.f[1] GROUP BY 1)
    SELECT f.item, f.f[1] AS decided_by, f.f[2] AS decision, s.s[1] AS second_by, s.s[2] = f.f[2] AS agreed FROM f LEFT JOIN s ON s.item = f.item"""
)
def governance_first_decision(spark: SparkSession, d: str) -> DataFrame:
    """For each item of the events: who decided first and what, and the first review by someone else."""
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("item"), "ts", "event_id", "user_id", "event_type")
    return first_decision(e, ["item"], ["ts", "event_id"], "user_id", "event_type")


@query(
    """SELECT user_id, (props->>'k')::BIGINT AS item, count(*) AS attempts, CASE WHEN bool_or(event_type IN ('purchase', 'signup')) THEN 'done' WHEN bool_or(event_type = 'error') THEN 'held' ELSE 'retry' END AS action
    FROM events GROUP BY ALL"""
)
def governance_resume_plan(spark: SparkSession, d: str) -> DataFrame:
    """Attempts by user and item: done, held because one may have gone through, or to be tried again."""
    e = table(spark, d, "events").withColumn("item", F.get_json_object("props", "$.k").cast("long"))
    return resume_plan(e, ["user_id", "item"], "event_type", ["purchase", "signup"], ["error"])


@query(
    """SELECT reason, count(*) AS n, sum(CASE WHEN reason = 'scored' THEN 1 ELSE 0 END)::BIGINT AS scored FROM (SELECT CASE WHEN l.quality IS NULL THEN 'unreviewed' WHEN l.toxic = 1 THEN 'disputed'
    WHEN right(sha256(d.source), 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 'other_split' WHEN d.n_chars < 200 THEN 'stale' ELSE 'scored' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1"""
)
def governance_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the first reason for which they aren't scored."""
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rules = {
        "unreviewed": F.col("quality").isNull(),
        "disputed": F.col("toxic") == 1,
        "other_split": F.substring(F.sha2("source", 256), -1, 1).isin(*"13579bdf"),
        "stale": F.col("n_chars") < 200,
    }
    counted = joined.select(first_reason(rules, "scored").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return counted.withColumn("scored", F.when(F.col("reason") == "scored", F.col("n")).otherwise(0).cast("long"))


@query(
    """WITH b AS (SELECT n_nationkey, min(c_acctbal) AS low, count(*) AS customers, count(o_orderkey) AS orders, avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END) AS finished FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT n_nationkey, CASE WHEN low < -900 THEN 'blocked' WHEN low IS NULL OR finished IS NULL OR finished < 0.48 OR orders < 20 THEN 'limited' ELSE 'ready' END AS decision FROM b"""
)
def eval_release_decision(spark: SparkSession, d: str) -> DataFrame:
    """Hard checks and quality targets of each nation as rows, folded to a decision."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    joined = table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    finished = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
    by = joined.groupBy("n_nationkey").agg(F.min("c_acctbal").alias("low"), F.count("o_orderkey").alias("orders"), F.avg(finished).alias("finished"))
    checks = F.array(
        F.struct(F.lit("hard").alias("kind"), (F.col("low") >= -900).alias("ok")),
        F.struct(F.lit("quality").alias("kind"), (F.col("finished") >= 0.48).alias("ok")),
        F.struct(F.lit("quality").alias("kind"), (F.col("orders") >= 20).alias("ok")),
    )
    return release_decision(by.select("n_nationkey", F.explode(checks).alias("c")).select("n_nationkey", "c.*"), ["n_nationkey"], "kind", "ok")


@query(
    """WITH l AS (SELECT o_orderpriority AS arm, o_orderkey, o_orderstatus, l_returnflag = 'N' AS correct, l_returnflag = 'R' AS wrong, l_tax > 0.04 AS cited, date_diff('day', o_orderdate, l_shipdate)::BIGINT AS wait FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    q AS (SELECT arm, o_orderkey, max(o_orderstatus) AS s, bool_and(correct) AS whole, count(*) FILTER (wrong) AS wrongs, count(*) AS claims, count(*) FILTER (correct) AS right_claims, count(*) FILTER (cited) AS cited, max(wait) AS wait FROM l GROUP BY 1, 2)
    SELECT arm, count(*) AS answers, sum(claims)::BIGINT AS claims, round(sum(right_claims) / sum(claims), 4) AS claim_correctness, round(avg(whole::INT), 4) AS whole_rate, count(*) FILTER (wrongs > 0) AS with_wrong, round(sum(cited) / sum(claims), 4) AS citation_rate,
    count(*) FILTER (s = 'P') AS abstained, round(avg(whole::INT) FILTER (s <> 'P'), 4) AS whole_if_answered, max(wait) AS longest FROM q GROUP BY 1"""
)
def eval_answer_quality(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers, their lines as claims: correctness of claims, whole answers, citations, abstentions and times by arm."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    claims = o.join(l, o.o_orderkey == l.l_orderkey).withColumn("wait", F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long"))
    flag = F.col("l_returnflag")
    answers = claims.groupBy(F.col("o_orderpriority").alias("arm"), "o_orderkey").agg(
        F.max("o_orderstatus").alias("s"), F.bool_and(flag == "N").alias("whole"), F.count_if(flag == "R").alias("wrongs"), F.count("*").alias("claims"), F.count_if(flag == "N").alias("right"), F.count_if(F.col("l_tax") > 0.04).alias("cited"), F.max("wait").alias("wait")
    )
    whole = F.col("whole").cast("int")
    return answers.groupBy("arm").agg(
        F.count("*").alias("answers"),
        F.sum("claims").alias("claims"),
        F.round(F.sum("right") / F.sum("claims"), 4).alias("claim_correctness"),
        F.round(F.avg(whole), 4).alias("whole_rate"),
        F.count_if(F.col("wrongs") > 0).alias("with_wrong"),
        F.round(F.sum("cited") / F.sum("claims"), 4).alias("citation_rate"),
        F.count_if(F.col("s") == "P").alias("abstained"),
        F.round(F.avg(F.when(F.col("s") != "P", whole)), 4).alias("whole_if_answered"),
        F.max("wait").alias("longest"),
    )


@query(
    """WITH s AS (SELECT event_type, count(*) FILTER (value > 60) AS k, count(*) AS n FROM events GROUP BY 1), a AS (SELECT 'all but view' AS event_type, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n FROM s WHERE event_type <> 'view'), u AS (SELECT * FROM s UNION ALL SELECT * FROM a), w AS (SELECT *, k / n AS p FROM u)
    SELECT event_type, k, n, round(p, 4) AS rate, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 4) AS low,
    round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 4) AS high FROM w"""
)
def eval_false_accepts(spark: SparkSession, d: str) -> DataFrame:
    """Rates with intervals by type, and rolled up over all types but the unchanged one."""
    by = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 60).alias("k"), F.count("*").alias("n"))
    rolled = by.where("event_type <> 'view'").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).select(F.lit("all but view").alias("event_type"), "k", "n")
    interval = wilson(F.col("k"), F.col("n"))
    rate = F.round(F.col("k") / F.col("n"), 4).alias("rate")
    return by.unionByName(rolled).select("event_type", "k", "n", rate, interval["low"].alias("low"), interval["high"].alias("high"))


@query(
    """WITH e AS (SELECT event_type, user_id, min(ts) AS first, count(*) AS notes FROM events GROUP BY 1, 2), o AS (SELECT user_id, row_number() OVER (ORDER BY min(ts), user_id) AS k, count(*) OVER () AS n FROM events GROUP BY 1)
    SELECT event_type, count(*) AS answers, sum(notes)::BIGINT AS notes, count(*) < 3 AS thin, min(k) AS first_seen, count(*) FILTER (k > n - 20) AS recent FROM e JOIN o USING (user_id) GROUP BY 1"""
)
def eval_taxonomy_progress(spark: SparkSession, d: str) -> DataFrame:
    """Types of notes: answers that have them, whether these are few, the first reviewed answer that showed one, and how many of the last 20 did."""
    e = table(spark, d, "events")
    firsts = e.groupBy("user_id").agg(F.min("ts").alias("at"))
    # answers are numbered through: ranges of time are counted first, then each is numbered alone
    ranged = firsts.withColumn("range", F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / 3600))
    before = F.sum("held").over(Window.orderBy("range")) - F.col("held")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("held")).withColumn("before", before)  # a row an hour
    numbered = ranged.join(sizes, "range").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("at", "user_id")))
    n = firsts.count()
    pairs = e.groupBy("event_type", "user_id").agg(F.count("*").alias("notes")).join(numbered.select("user_id", "k"), "user_id")
    return pairs.groupBy("event_type").agg(
        F.count("*").alias("answers"), F.sum("notes").alias("notes"), (F.count("*") < 3).alias("thin"), F.min("k").alias("first_seen"), F.count_if(F.col("k") > n - 20).alias("recent")
    )


@query(
    """WITH l AS (SELECT 'run-' || o_orderpriority || '-' || l_linenumber AS key, o_custkey AS question, l_linenumber AS attempt, round(l_extendedprice * 1000)::BIGINT AS micro, date_diff('day', o_orderdate, l_shipdate)::BIGINT AS took FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT question, count(*) AS attempts, max(attempt) AS retry, sum(micro)::BIGINT AS micro, sum(took)::BIGINT AS took FROM l WHERE starts_with(key, 'run-1-') AND key NOT LIKE '%-7' GROUP BY 1"""
)
def ledger_prefix_cost(spark: SparkSession, d: str) -> DataFrame:
    """Attempts whose key has a run's prefix: cost, time and highest retry of each question; the seventh tries are left out by pattern."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = o.where(F.col("o_orderpriority").startswith("1-")).join(l, o.o_orderkey == l.l_orderkey)
    key = F.concat_ws("-", F.lit("run"), "o_orderpriority", "l_linenumber")
    kept = rows.where(key.startswith("run-1-") & ~key.like("%-7"))
    took = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long")
    return kept.groupBy(F.col("o_custkey").alias("question")).agg(
        F.count("*").alias("attempts"), F.max("l_linenumber").alias("retry"), F.sum(F.round(F.col("l_extendedprice") * 1000).cast("long")).alias("micro"), F.sum(took).alias("took")
    )


@query(
    """WITH s AS (SELECT user_id, sum(round(value * 100)::BIGINT) FILTER (event_type = 'purchase') AS spent, sum(round(value * 100)::BIGINT) FILTER (event_type = 'click') AS pending, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1),
    c AS (SELECT *, 500000 AS cap, coalesce(spent, 0) + coalesce(pending, 0) AS used FROM s)
    SELECT user_id, used, greatest(0, least(cap - used, 300000 - coalesce(spent, 0))) AS headroom, round(cap * (date_diff('day', DATE '2024-01-01', last::DATE) + 1) / 30)::BIGINT AS paced, used > round(cap * (date_diff('day', DATE '2024-01-01', last::DATE) + 1) / 30)::BIGINT AS ahead FROM c"""
)
def ledger_headroom_pacing(spark: SparkSession, d: str) -> DataFrame:
    """What a member may still use (the lesser remainder of cap and envelope), and how use compares with an even pace over thirty days."""
    micro = F.round(F.col("value") * 100).cast("long")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, micro)), F.lit(0))
    by = table(spark, d, "events").groupBy("user_id").agg(of("purchase").alias("spent"), of("click").alias("pending"), F.max("ts").alias("last"))
    used, days = F.col("spent") + F.col("pending"), F.date_diff(F.to_date("last"), F.lit("2024-01-01").cast("date")) + 1
    paced = F.round(F.lit(500000) * days / 30).cast("long")
    headroom = F.greatest(F.lit(0), F.least(F.lit(500000) - used, F.lit(300000) - F.col("spent")))
    return by.select("user_id", used.alias("used"), headroom.alias("headroom"), paced.alias("paced"), (used > paced).alias("ahead"))


@query(
    """WITH r AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at FROM events GROUP BY 1)
    SELECT user_id, state, CASE state WHEN 'view' THEN 'released' WHEN 'click' THEN 'unknown' WHEN 'error' THEN 'interrupted' ELSE state END AS recovered, state IN ('view', 'click') AS open FROM r"""
)
def ledger_recovery(spark: SparkSession, d: str) -> DataFrame:
    """States after a restart: reserved ones are released, dispatched ones unknown, running ones interrupted; which were open."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    to = F.when(F.col("state") == "view", "released").when(F.col("state") == "click", "unknown").when(F.col("state") == "error", "interrupted").otherwise(F.col("state"))
    return last.select("user_id", "state", to.alias("recovered"), F.col("state").isin("view", "click").alias("open"))


@query(
    """WITH e AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS settled, max(ts) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'click') AS checks FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN settled IS NOT NULL AND (failed IS NULL OR settled >= failed) THEN 'reviewed' WHEN failed IS NOT NULL THEN 'flagged' WHEN checks > 0 THEN 'sample_checked' ELSE 'unreviewed' END AS status FROM e"""
)
def ledger_status_replay(spark: SparkSession, d: str) -> DataFrame:
    """A review status replayed from two kinds of events, of which the later one wins, and sample checks, which only count without both."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    by = table(spark, d, "events").groupBy("user_id").agg(at("purchase").alias("settled"), at("error").alias("failed"), F.count_if(F.col("event_type") == "click").alias("checks"))
    won = F.col("settled").isNotNull() & (F.col("failed").isNull() | (F.col("settled") >= F.col("failed")))
    status = F.when(won, "reviewed").when(F.col("failed").isNotNull(), "flagged").when(F.col("checks") > 0, "sample_checked").otherwise("unreviewed")
    return by.select("user_id", status.alias("status"))


@query(
    """WITH i AS (SELECT md5(coalesce(text, '')) AS h, min(doc_id) AS doc_id, count(*) AS copies, min(length(coalesce(text, ''))) AS n FROM documents GROUP BY 1), k AS (SELECT DISTINCT md5(text) AS h FROM benchmark),
    p AS (SELECT i.*, h IN (SELECT h FROM k) OR doc_id % 3 = 0 AS cached FROM i) SELECT count(*) AS distinct_texts, sum(copies)::BIGINT AS texts, count(*) FILTER (cached) AS cached, count(*) FILTER (NOT cached) AS missing,
    coalesce(sum(ceil(n / 4.0)) FILTER (NOT cached), 0)::BIGINT AS tokens, ceil(count(*) FILTER (NOT cached) / 256.0)::BIGINT AS batches, coalesce(sum(ceil(n / 4.0)) FILTER (NOT cached), 0) * 13 <= 400000000 AS fits FROM p"""
)
def governance_recompute_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which texts must be computed anew: distinct ones, those whose key a cache has, the rest in batches with their cost and whether it fits."""
    text = F.coalesce("text", F.lit(""))
    own = table(spark, d, "documents").groupBy(F.md5(text).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min(F.length(text)).alias("n"))
    known = table(spark, d, "benchmark").select(F.md5("text").alias("h")).distinct().withColumn("known", F.lit(True))
    cached = F.col("known").isNotNull() | (F.col("doc_id") % 3 == 0)
    cost = F.coalesce(F.sum(F.when(~F.col("cached"), F.ceil(F.col("n") / 4))), F.lit(0))
    missing = F.count_if(~F.col("cached"))
    return own.join(known, "h", "left").withColumn("cached", cached).agg(
        F.count("*").alias("distinct_texts"), F.sum("copies").alias("texts"), F.count_if("cached").alias("cached"), missing.alias("missing"), cost.cast("long").alias("tokens"), F.ceil(missing / 256).cast("long").alias("batches"), (cost * 13 <= 400000000).alias("fits")
    )


@query(
    """WITH l AS (SELECT user_id, (props->>'k')::BIGINT AS item, min(ts) AS seen_at FROM events WHERE event_type = 'view' GROUP BY 1, 2), n AS (SELECT DISTINCT user_id, (props->>'k')::BIGINT AS item FROM events WHERE event_type IN ('click', 'purchase'))
    SELECT user_id, count(*) AS unassigned, md5(string_agg(item::VARCHAR, ' ' ORDER BY item)) AS items_md5, min(seen_at) AS earliest FROM l ANTI JOIN n USING (user_id, item) GROUP BY 1"""
)
def governance_unassigned_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes (views of an item) that are in no accepted or proposed type (clicks and purchases), with the earliest time."""
    e = table(spark, d, "events").withColumn("item", F.get_json_object("props", "$.k").cast("long"))
    seen = e.where("event_type = 'view'").groupBy("user_id", "item").agg(F.min("ts").alias("at"))
    rest = seen.join(e.where(F.col("event_type").isin("click", "purchase")).select("user_id", "item").distinct(), ["user_id", "item"], "left_anti")
    items = F.array_join(F.array_sort(F.collect_list("item")).cast("array<string>"), " ")
    return rest.groupBy("user_id").agg(F.count("*").alias("unassigned"), F.md5(items).alias("items_md5"), F.min("at").alias("earliest"))
