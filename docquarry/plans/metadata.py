"""Metadata queries: orders stand for announced projects, with amounts that are missing, zero or in conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.predicates import Field, Filter, overlay, quality_flags, query_metadata
from docquarry.operators.ranking import top_with_ties
from docquarry.sources.tables import table

from .registry import query

FIELDS = {
    "amount": Field("amount", (">=", "<=", "between", "="), 1000),
    "institution": Field("institution", ("=", "contains")),
    "published": Field("published", (">=", "<=", "between")),
    "bid_close": Field("bid_close", (">=", "<=", "between")),
}


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Orders as projects: urgent ones have no amount, open ones no closing date, those in part a conflict about the amount."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("project_id"),
        F.col("c_name").alias("title"),
        F.col("n_name").alias("institution"),
        F.when(F.col("o_orderpriority") == "1-URGENT", None).when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(F.floor("o_totalprice")).cast("long").alias("amount"),
        F.to_date("o_orderdate").alias("published"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(F.to_date("o_orderdate"), 30)).alias("bid_close"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit("amount"))).otherwise(F.array().cast("array<string>")).alias("conflict_fields"),
    )


PROJECTS = """projects AS (SELECT o_orderkey AS project_id, c_name AS title, n_name AS institution,
  CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '5-LOW' THEN 0 ELSE floor(o_totalprice)::BIGINT END AS amount,
  o_orderdate::DATE AS published, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + 30 END AS bid_close,
  CASE WHEN o_orderstatus = 'P' THEN ['amount'] ELSE [] END AS conflict_fields
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT *, CASE WHEN list_contains(conflict_fields, 'amount') THEN 'conflict' WHEN amount IS NULL THEN 'missing' WHEN amount = 0 THEN 'zero' WHEN amount < 1000 THEN 'too_small' END AS ra,
  CASE WHEN bid_close IS NULL THEN 'missing' END AS rb FROM projects)"""


@query(
    f"""WITH {PROJECTS} SELECT project_id, CASE WHEN ra IS NULL AND rb IS NULL THEN 'matched' ELSE 'review' END AS outcome,
    concat_ws(',', 'amount:' || ra, 'bid_close:' || rb) AS reasons FROM r
    WHERE (ra IS NOT NULL OR amount >= 100000) AND (rb IS NOT NULL OR bid_close >= DATE '1996-06-01')"""
)
def metadata_filter_with_review(spark: SparkSession, d: str) -> DataFrame:
    """Amount and closing date: undecidable rows are for review unless a decidable filter excludes them."""
    import datetime

    filters = [Filter("amount", ">=", (100000,)), Filter("bid_close", ">=", (datetime.date(1996, 6, 1),))]
    found = query_metadata(projects(spark, d), FIELDS, filters)
    return found.select("project_id", "outcome", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH {PROJECTS} SELECT outcome, reason, count(*) AS n FROM (SELECT CASE WHEN ra IS NULL THEN 'matched' ELSE 'review' END AS outcome, coalesce(ra, 'none') AS reason
    FROM r WHERE (ra IS NOT NULL OR amount BETWEEN 50000 AND 150000) AND contains(institution, 'A')) GROUP BY ALL"""
)
def metadata_count_only(spark: SparkSession, d: str) -> DataFrame:
    """How many projects of a range and an institution match or need a review, by reason."""
    found = query_metadata(projects(spark, d), FIELDS, [Filter("amount", "between", (50000, 150000)), Filter("institution", "contains", ("A",))])
    reason = F.coalesce(F.substring_index(F.try_element_at("reasons", F.lit(1)), ":", -1), F.lit("none"))
    return found.groupBy("outcome", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {PROJECTS}, m AS (SELECT project_id, published FROM r WHERE ra IS NULL AND amount >= 100000)
    SELECT project_id, published FROM (SELECT *, rank() OVER (ORDER BY published) AS k FROM m) WHERE k <= 10"""
)
def metadata_limit_with_ties(spark: SparkSession, d: str) -> DataFrame:
    """The earliest ten matched projects, and all that tie with the tenth."""
    found = query_metadata(projects(spark, d), FIELDS, [Filter("amount", ">=", (100000,))]).where("outcome = 'matched'")
    return top_with_ties(found.select("project_id", "published"), "published", 10)


@query(
    f"""WITH {PROJECTS} SELECT project_id, concat_ws(',', CASE WHEN amount IS NULL THEN 'amount_missing' END, CASE WHEN amount = 0 THEN 'amount_zero_review' END,
    CASE WHEN bid_close IS NULL THEN 'bid_close_missing' END) AS flags FROM projects"""
)
def metadata_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = quality_flags(projects(spark, d), "amount", ["bid_close"])
    return projects(spark, d).select("project_id", F.array_join(flags, ",").alias("flags"))


@query(
    f"""WITH {PROJECTS}, l AS (SELECT l_orderkey, arg_max(floor(l_extendedprice)::BIGINT, (l_linenumber, floor(l_extendedprice)::BIGINT::VARCHAR)) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT project_id, amount AS raw_amount, coalesce(v, amount) AS amount FROM projects LEFT JOIN l ON l_orderkey = project_id"""
)
def metadata_effective_values(spark: SparkSession, d: str) -> DataFrame:
    """Recorded resolutions (here returned lines) replace amounts; raw ones stay."""
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    resolutions = lines.select(F.col("l_orderkey").alias("project_id"), F.lit("amount").alias("field"), F.floor("l_extendedprice").cast("long").cast("string").alias("value"), F.col("l_linenumber").alias("at"))
    return overlay(projects(spark, d).select("project_id", "amount"), resolutions, "project_id", ["amount"], "at")


@query(
    f"""WITH {PROJECTS} SELECT institution, count(*) AS n, count(amount) AS n_amount, sum(CASE WHEN amount = 0 THEN 1 ELSE 0 END)::BIGINT AS n_zero,
    sum(len(conflict_fields))::BIGINT AS n_conflicts, min(published) AS first_published, max(bid_close) AS last_close FROM projects GROUP BY institution"""
)
def metadata_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of states by institution."""
    return projects(spark, d).groupBy("institution").agg(
        F.count("*").alias("n"),
        F.count("amount").alias("n_amount"),
        F.count_if(F.col("amount") == 0).alias("n_zero"),
        F.sum(F.size("conflict_fields").cast("long")).alias("n_conflicts"),
        F.min("published").alias("first_published"),
        F.max("bid_close").alias("last_close"),
    )


@query(
    f"""WITH {PROJECTS}, v AS (SELECT project_id, unnest(['amount', 'bid_close', 'published']) AS field, unnest([amount::VARCHAR, bid_close::VARCHAR, published::VARCHAR]) AS value,
    unnest([CASE WHEN list_contains(conflict_fields, 'amount') THEN 'conflict' WHEN amount IS NULL THEN 'unknown' WHEN amount = 0 THEN 'zero_review' ELSE 'known' END,
    CASE WHEN bid_close IS NULL THEN 'unknown' ELSE 'known' END, CASE WHEN published IS NULL THEN 'unknown' ELSE 'known' END]) AS state FROM projects)
    SELECT project_id, field, value, state FROM v"""
)
def metadata_facts(spark: SparkSession, d: str) -> DataFrame:
    """A row for each field of each project, with its state."""
    p = projects(spark, d)
    state = F.when(F.array_contains("conflict_fields", "amount"), "conflict").when(F.col("amount").isNull(), "unknown").when(F.col("amount") == 0, "zero_review").otherwise("known")
    seen = lambda c: F.when(F.col(c).isNull(), "unknown").otherwise("known")
    facts = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), s.alias("state")) for c, s in (("amount", state), ("bid_close", seen("bid_close")), ("published", seen("published")))])
    return p.select("project_id", F.explode(facts).alias("f")).select("project_id", "f.*")
