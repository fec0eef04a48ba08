"""Evaluation statistics, event folds and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.statistics import holm, kappa, mcnemar, wilson
from docquarry.operators.ledger import latest_state, once, shares, totals, warnings
from docquarry.sources.tables import table
from docquarry.streaming.windows import deduplicated, event_stream, run_to_table, sessions, whole_lateness, windowed_counts

from .registry import query

JUDGED = "j AS (SELECT source, doc_id, quality = 1 AS a, len(string_split(text, '|')) < 5 AS b FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Two raters of a document: its label, and whether it has few bars."""
    joined = table(spark, d, "labels").where("quality IS NOT NULL").join(table(spark, d, "documents"), "doc_id")
    return joined.select("source", "doc_id", (F.col("quality") == 1).alias("a"), (F.size(F.split("text", r"\|")) < 5).alias("b"))


COUNTS = {"in_both": "a AND b", "only_a": "a AND NOT b", "only_b": "b AND NOT a", "neither": "NOT a AND NOT b"}


def four(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.expr(test)).alias(name) for name, test in COUNTS.items()])


FOUR = "count(*) FILTER (a AND b) AS in_both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither"


@query(
    f"""WITH {JUDGED}, s AS (SELECT source, count(*) FILTER (a) AS k, count(*) AS n FROM j GROUP BY 1), w AS (SELECT *, k / n AS p FROM s)
    SELECT source, k, n, round(p, 4) AS rate, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 4) AS low,
    round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 4) AS high FROM w"""
)
def eval_wilson_by_source(spark: SparkSession, d: str) -> DataFrame:
    rates = judged(spark, d).groupBy("source").agg(F.count_if("a").alias("k"), F.count("*").alias("n"))
    return rates.withColumn("w", wilson(F.col("k"), F.col("n"))).select("source", "k", "n", F.round(F.col("k") / F.col("n"), 4).alias("rate"), "w.low", "w.high")


@query(
    f"""WITH {JUDGED}, f AS (SELECT {FOUR} FROM j), g AS (SELECT *, (in_both + only_a + only_b + neither)::DOUBLE AS n FROM f), h AS (SELECT *, (in_both + neither) / n AS po, (in_both + only_a) / n AS p1, (in_both + only_b) / n AS p2 FROM g)
    SELECT in_both, only_a, only_b, neither, round((po - (p1 * p2 + (1 - p1) * (1 - p2))) / (1 - (p1 * p2 + (1 - p1) * (1 - p2))), 6) AS kappa FROM h"""
)
def eval_kappa(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(k) for k in COUNTS]
    return four(judged(spark, d)).withColumn("kappa", F.round(kappa(*c), 6))


@query(
    f"""WITH {JUDGED}, f AS (SELECT source, {FOUR} FROM j GROUP BY source), b AS (SELECT source, only_a + only_b AS n, least(only_a, only_b) AS k FROM f),
    t AS (SELECT source, n, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) AS term FROM (SELECT source, n, unnest(range(k + 1)) AS i FROM b)),
    p AS (SELECT source, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * sum(term)) END AS p FROM t GROUP BY source, n),
    s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, source) + 1) * p AS x FROM p)
    SELECT source, round(p, 9) AS p, round(least(1.0, max(x) OVER (ORDER BY p, source ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM s"""
)
def eval_mcnemar_holm(spark: SparkSession, d: str) -> DataFrame:
    """A paired test for each source, adjusted over all of them."""
    tested = four(judged(spark, d), "source").withColumn("p", mcnemar(F.col("only_a"), F.col("only_b"))).withColumn("family", F.lit(1))
    return holm(tested, ["family"], "p", "source").select("source", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@query(
    f"""WITH {JUDGED}, f AS (SELECT source, avg(a::INT) AS m, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM j GROUP BY source),
    r AS (SELECT rep, ('0x' || substr(md5('5:' || rep || ':' || slot), 1, 8))::BIGINT % (SELECT max(n) FROM f) AS k FROM range(0, 200) a(rep), range(0, (SELECT count(*) FROM f)) b(slot)),
    e AS (SELECT rep, avg(m) AS m FROM r JOIN f USING (k) GROUP BY rep), s AS (SELECT list_sort(list(m)) AS v FROM e) SELECT round(v[6], 6) AS low, round(v[195], 6) AS high FROM s"""
)
def eval_family_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Whole sources drawn 200 times by hash; the interval of the mean of their rates."""
    f = judged(spark, d).groupBy("source").agg(F.avg(F.col("a").cast("int")).alias("m"))
    numbered = f.select("m", (F.row_number().over(Window.orderBy("source")) - 1).cast("long").alias("k"))  # one row a source
    n = numbered.count()
    slot, rep = (F.col("id") % n).cast("string"), F.floor(F.col("id") / n)
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("5"), rep.cast("string"), slot)), 1, 8), 16, 10).cast("long") % n
    drawn = spark.range(200 * n).select(rep.alias("rep"), pick.alias("k"))
    means = drawn.join(numbered, "k").groupBy("rep").agg(F.avg("m").alias("m"))
    return means.agg(F.sort_array(F.collect_list("m")).alias("v")).select(F.round(F.col("v")[5], 6).alias("low"), F.round(F.col("v")[194], 6).alias("high"))


@query(
    f"""WITH {JUDGED}, t AS (SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) / greatest(length(text), 1), 2) AS s FROM documents),
    c AS (SELECT s, count(*) FILTER (a) AS pos, count(*) FILTER (NOT a) AS neg FROM j JOIN t USING (doc_id) GROUP BY s), x AS (SELECT s AS hi, sum(pos) OVER (ORDER BY s DESC) AS taken, sum(neg) OVER (ORDER BY s DESC) AS false_accepts, sum(pos + neg) OVER () AS n FROM c)
    SELECT round(hi, 2) AS cut, taken::BIGINT AS taken, false_accepts::BIGINT AS false_accepts FROM x WHERE (taken + false_accepts) >= 0.5 * n ORDER BY false_accepts, taken DESC, hi LIMIT 1"""
)
def eval_threshold_fit(spark: SparkSession, d: str) -> DataFrame:
    """The cut of a score (two digits, so at most 101 cuts) with the fewest false accepts that still takes half of all."""
    letters = F.length(F.regexp_replace("text", "[^A-Za-z ]", "")) / F.greatest(F.length("text"), F.lit(1))
    scored = judged(spark, d).join(table(spark, d, "documents").select("doc_id", F.round(letters, 2).alias("s")), "doc_id")
    cuts = scored.groupBy("s").agg(F.count_if("a").alias("pos"), F.count_if(~F.col("a")).alias("neg"))
    w = Window.orderBy(F.desc("s"))
    laid = cuts.select(F.col("s").alias("cut"), F.sum("pos").over(w).alias("taken"), F.sum("neg").over(w).alias("false_accepts"), F.sum(F.col("pos") + F.col("neg")).over(Window.partitionBy()).alias("n"))
    return laid.where(F.col("taken") + F.col("false_accepts") >= 0.5 * F.col("n")).orderBy("false_accepts", F.desc("taken"), "cut").limit(1).drop("n")


def micro(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("micro", F.round(F.col("value") * 1000).cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """WITH ev AS (SELECT *, round(value * 1000)::BIGINT AS micro FROM events), t AS (SELECT user_id, coalesce(sum(CASE WHEN event_type IN ('purchase', 'refund') THEN micro END), 0)::BIGINT AS spent, coalesce(sum(CASE WHEN event_type IN ('click', 'view') THEN micro END), 0)::BIGINT AS pending, count(*) AS n FROM ev GROUP BY 1)
    SELECT *, CASE WHEN (spent + pending) * 100 >= 2000000 * 90 THEN 90 WHEN (spent + pending) * 100 >= 2000000 * 75 THEN 75 WHEN (spent + pending) * 100 >= 2000000 * 50 THEN 50 END AS warning FROM t"""
)
def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    t = totals(micro(spark, d), ["user_id"], "event_type", "micro", ["purchase", "refund"], ["click", "view"])
    return t.withColumn("warning", warnings(F.col("spent"), F.col("pending"), F.lit(2_000_000)))


@query(
    """SELECT user_id, event_type, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY ALL"""
)
def ledger_annotation_state(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each target, the first time kept."""
    folded = latest_state(micro(spark, d), ["user_id", "event_type"], ["ts", "event_id"], "value")
    return folded.withColumn("first_at", F.unix_micros("first_at")).withColumn("last_at", F.unix_micros("last_at"))


@query("SELECT user_id, props, min(event_id) AS event_id FROM events GROUP BY user_id, props")
def ledger_idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    """A correction key counts once."""
    return once(micro(spark, d).select("user_id", "props", "event_id"), ["user_id", "props"], ["event_id"])


@query(
    """WITH t AS (SELECT user_id, round(sum(value) * 1000)::BIGINT AS total FROM events GROUP BY 1), f AS (SELECT *, floor(total * 1 / 16)::BIGINT AS a, floor(total * 3 / 16)::BIGINT AS b, floor(total * 12 / 16)::BIGINT AS c FROM t)
    SELECT user_id, total, a, b, c + (total - a - b - c) AS c FROM f"""
)
def ledger_envelopes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value") * 1000).cast("long").alias("total"))
    return t.withColumn("e", shares(F.col("total"), {"a": 1, "b": 3, "c": 12}, "c")).select("user_id", "total", "e.*")


@query("SELECT event_type, (json_extract(props, '$.k'))::BIGINT % 10 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_field_sums(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT")["k"] % 10
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    counted = run_to_table(windowed_counts(event_stream(spark, f"{d}/events.parquet"), "1 hour"), "complete")
    return counted.withColumn("total", F.round("total", 4))


@query(
    """SELECT (floor(epoch(ts) / 1800) * 1800 - o * 1800)::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 2) t(o) GROUP BY ALL"""
)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    counted = run_to_table(windowed_counts(event_stream(spark, f"{d}/events.parquet"), "1 hour", "30 minutes"), "complete")
    return counted.withColumn("total", F.round("total", 4))


@query(
    """WITH w AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM w)
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS session_start, floor(epoch(max(ts) + INTERVAL 6 HOUR))::BIGINT AS session_end, count(*) AS n FROM i GROUP BY user_id, s"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return run_to_table(sessions(event_stream(spark, path), "6 hours", whole_lateness(spark, path)), "complete")


@query("SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY ALL")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """One event of each user and type."""
    path = f"{d}/events.parquet"
    kept = run_to_table(deduplicated(event_stream(spark, path), ["user_id", "event_type"], whole_lateness(spark, path)), "append")
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
