"""Queries on stated values: dates with times, amounts, claims that their passages don't support, and mutants.

The given texts state no dates or Korean amounts, so each order is written as a claim and as a passage, in other spellings and with some values changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.values import MUTATIONS, amounts, dates, stated, unchanged, value_check, without_condition
from docquarry.sources.tables import table

from .registry import query

CLAIM = "납품은 {day} 오후 {hour}시까지 해야 합니다. 사업비는 {won}원 이상(부가세 포함)이며 하자보수는 {months}개월입니다."
STATED = """o AS (SELECT o_orderkey AS k, (o_orderdate + INTERVAL 30 YEAR)::DATE AS d, floor(o_totalprice)::BIGINT * 1000 AS won, 1 + o_custkey % 11 AS h, 2 + o_orderkey % 30 AS m FROM orders),
    v AS (SELECT *, CASE WHEN k % 4 = 0 THEN (d + 1)::DATE ELSE d END AS pd, CASE WHEN k % 5 = 0 THEN won + 50 ELSE won END AS pwon, CASE WHEN k % 7 = 0 THEN m + 1 ELSE m END AS pm FROM o)"""


def written(pattern: str, **parts: Column) -> Column:
    """A pattern with its {names} filled in."""
    out, rest = [], pattern
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), parts[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def statements(spark: SparkSession, d: str) -> DataFrame:
    # the work on a row is long, its bytes are few: rows of one file or row group are dealt to as many tasks as a shuffle has
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    o = o.select("o_orderkey", F.add_months("o_orderdate", 360).alias("d"), (F.floor("o_totalprice").cast("long") * 1000).alias("won"), (1 + F.col("o_custkey") % 11).alias("h"), (2 + F.col("o_orderkey") % 30).alias("m"))
    k, won = F.col("o_orderkey"), F.col("won")
    pwon = F.when(k % 5 == 0, won + 50).otherwise(won)
    claim = written(CLAIM, day=F.date_format("d", "yyyy년 M월 d일"), hour=F.col("h"), won=F.format_number("won", 0), months=F.col("m"))
    passage = written(
        "기한: {day}(월) {hour}:00, 납품 해야 합니다. 금액은 {eok}억 {man}만 {rest}원 이상(부가세 포함), 하자보수 {months} 개월.",
        day=F.date_format(F.when(k % 4 == 0, F.date_add("d", 1)).otherwise(F.col("d")), "yyyy.MM.dd"), hour=F.col("h") + 12,
        eok=F.floor(pwon / 10**8), man=F.floor(pwon / 10**4) % 10**4, rest=pwon % 10**4, months=F.when(k % 7 == 0, F.col("m") + 1).otherwise(F.col("m")),
    )
    return o.select("o_orderkey", claim.alias("claim"), passage.alias("passage"))


@query(
    f"""WITH {STATED} SELECT k AS o_orderkey, concat_ws(',', strftime(d, '%Y-%m-%d'), strftime(d, '%Y-%m-%d') || 'T' || lpad((h + 12)::VARCHAR, 2, '0') || ':00') AS claim_dates,
    concat_ws(',', strftime(pd, '%Y-%m-%d'), strftime(pd, '%Y-%m-%d') || 'T' || lpad((h + 12)::VARCHAR, 2, '0') || ':00') AS passage_dates, won AS largest, pwon AS passage_largest FROM v"""
)
def number_stated_values(spark: SparkSession, d: str) -> DataFrame:
    """The dates with times and the largest amounts that claims and passages state."""
    largest = lambda t: F.array_max(amounts(t)).cast("long")
    listed = lambda t: F.array_join(dates(t), ",")
    c, p = F.col("claim"), F.col("passage")
    return statements(spark, d).select("o_orderkey", listed(c).alias("claim_dates"), listed(p).alias("passage_dates"), largest(c).alias("largest"), largest(p).alias("passage_largest"))


@query(f"WITH {STATED} SELECT k AS o_orderkey, CASE WHEN d <> pd OR won <> pwon THEN 'unsupported' END AS verdict FROM v")
def eval_value_check(spark: SparkSession, d: str) -> DataFrame:
    """Claims with a date or an amount that their passage does not state."""
    return statements(spark, d).select("o_orderkey", value_check(F.col("claim"), F.col("passage")).alias("verdict"))


def mutant_sql(kind: str, when: str, before: str, after: str, **changed: str) -> str:
    parts = {"day": "strftime(d, '%Y년 ') || month(d) || '월 ' || day(d) || '일'", "hour": "h", "won": "format('{:,}', won)", "months": "m"} | changed
    text = CLAIM
    for old in [k for k in changed if k not in parts or k not in ("day", "hour", "won", "months")]:
        text = text.replace(old, changed[old])
    for name in ("day", "hour", "won", "months"):
        text = text.replace(f"{{{name}}}", f"' || {parts[name]} || '")
    return f"SELECT k AS o_orderkey, '{kind}' AS kind, {before} AS before, {after} AS after, md5('{text}') AS mutant_md5 FROM w WHERE {when}"


NEW_DAY = "strftime(nd, '%Y년 ') || month(nd) || '월 ' || day(nd) || '일'"
MUTANTS_SQL = " UNION ALL ".join(
    [
        mutant_sql("amount", "won = pwon AND won >= 10000", "won::VARCHAR", "(won + step)::VARCHAR", won="format('{:,}', won + step)"),
        mutant_sql("unit", "m = pm", "m || '개월'", "m || '년'", **{"개월입니다": "년입니다"}),
        mutant_sql("date", "d = pd", "strftime(d, '%Y-%m-%d')", "strftime(nd, '%Y-%m-%d')", **{"{day} 오후 {hour}시까지": f"' || {NEW_DAY} || ' ' || lpad((h + 12)::VARCHAR, 2, '0') || ':00까지"}),
        mutant_sql("qualifier", "true", "'부가세 포함'", "'부가세 별도'", **{"부가세 포함": "부가세 별도"}),
        mutant_sql("dropped_condition", "true", "'부가세 포함 / VAT 포함'", "''", **{"(부가세 포함)": ""}),
    ]
)


@query(f"WITH {STATED}, w AS (SELECT *, d + 7 AS nd, (10 ** (length(won::VARCHAR) - 1))::BIGINT AS step FROM v), x AS ({MUTANTS_SQL}) SELECT *, NULL::VARCHAR AS problem FROM x")
def text_mutants(spark: SparkSession, d: str) -> DataFrame:
    """Claims with an amount, a unit, a date or a qualifier that is wrong, or a condition that is left out, and whether each differs as meant."""
    c, p = F.col("claim"), F.col("passage")
    theirs = {k: F.col(f"their_{k}") for k in ("amount", "date")}
    made = {k: f(c, p, theirs[k]) if k in theirs else f(c, p) for k, f in MUTATIONS.items() if k != "negation"} | {"dropped_condition": without_condition(c, ["부가세 포함 / VAT 포함"])}
    rows = statements(spark, d).withColumns({f"their_{k}": stated(k, p) for k in theirs})
    for kind, x in made.items():
        rows = rows.withColumn(f"made_{kind}", x)

    def checked(k: str, x: Column) -> Column:
        parts = F.struct("o_orderkey", F.lit(k).alias("kind"), x["before"].alias("before"), x["after"].alias("after"), F.md5(x["text"]).alias("mutant_md5"), unchanged(k, c, x, p, theirs.get(k)).alias("problem"))
        return F.when(x.isNotNull(), parts)

    # the array is never empty; for explode() its size would be tested in a filter on orders, with all of this worked out there once more
    all_ = F.array(*[checked(k, F.col(f"made_{k}")) for k in made])
    return rows.select(all_.alias("all")).select(F.explode_outer("all").alias("e")).where(F.col("e").isNotNull()).select("e.*")
