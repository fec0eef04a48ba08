"""Contract checks, paired and combined measures, inventories, and what is shown or decided about single records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import affirmed, numbers, squashed
from docquarry.operators.governance import seeded
from docquarry.sources.tables import table

from .registry import query

#: Qualifiers looked for in the given prose, and what negates them there.
QUALIFIERS, AFTER, BEFORE = ("there", "heit", "ention"), ("an", "keit", "sh"), ("e", "n")


def affirmed_sql(spelling: str) -> str:
    n, tests = len(spelling), " OR ".join(f"contains(substr(hay, i + {len(spelling)}, 6), '{x}')" for x in AFTER)
    free = f"substr(hay, i, {n}) = '{spelling}' AND NOT ({tests}) AND NOT (i > 1 AND substr(hay, i - 1, 1) IN {BEFORE})"
    return f"len(list_filter(range(1, length(hay)), lambda i: {free})) > 0 AS {spelling}"


@query(
    f"""WITH h AS (SELECT item_id, regexp_replace(text, '[ \\t\\r\\n]+', '', 'g') AS hay FROM benchmark) SELECT item_id, {", ".join(affirmed_sql(q) for q in QUALIFIERS)} FROM h"""
)
def text_affirmed_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    """Qualifiers that an item states without a negation close by."""
    hay = table(spark, d, "benchmark").select("item_id", squashed(F.col("text")).alias("hay"))
    return hay.select("item_id", *[affirmed(F.col("hay"), q, AFTER, BEFORE).alias(q) for q in QUALIFIERS])


@query(
    r"""WITH m AS (SELECT doc_id, text, regexp_replace(text, '([0-9]+)', '\10') AS mutated FROM documents WHERE regexp_matches(text, '[0-9]')),
    c AS (SELECT doc_id, mutated, list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')) AS a, list_transform(regexp_extract_all(mutated, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')) AS b FROM m)
    SELECT doc_id, md5(mutated) AS mutated_md5, len(a)::INT AS n_before, len(b)::INT AS n_after, a[1] <> b[1] AS first_differs FROM c"""
)
def text_mutated_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its first number made ten times as large, and whether a check of the numbers sees it."""
    docs = table(spark, d, "documents").where(F.col("text").rlike("[0-9]"))
    changed = docs.select("doc_id", numbers(F.col("text")).alias("a"), F.regexp_replace("text", r"\A([^0-9]*[0-9]+)", "$10").alias("mutated")).withColumn("b", numbers(F.col("mutated")))
    return changed.select("doc_id", F.md5("mutated").alias("mutated_md5"), F.size("a").alias("n_before"), F.size("b").alias("n_after"), (F.col("a")[0] != F.col("b")[0]).alias("first_differs"))


@query(
    """WITH p AS (SELECT user_id AS question, event_type AS run, avg(value) >= 110 AS passed FROM events GROUP BY ALL), b AS (SELECT question, passed AS base FROM p WHERE run = 'view')
    SELECT run, count(*) AS n, count(*) FILTER (base AND NOT passed) AS baseline_only, count(*) FILTER (passed AND NOT base) AS run_only, round((count(*) FILTER (passed AND NOT base) - count(*) FILTER (base AND NOT passed)) / count(*), 4) AS pass_diff
    FROM p JOIN b USING (question) WHERE run <> 'view' GROUP BY run"""
)
def eval_paired_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run against the baseline on the questions that both answered."""
    p = table(spark, d, "events").groupBy(F.col("user_id").alias("question"), F.col("event_type").alias("run")).agg((F.avg("value") >= 110).alias("passed"))
    met = p.where("run <> 'view'").join(p.where("run = 'view'").select("question", F.col("passed").alias("base")), "question")
    counts = met.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.expr("base AND NOT passed")).alias("baseline_only"), F.count_if(F.expr("passed AND NOT base")).alias("run_only"))
    return counts.withColumn("pass_diff", F.round((F.col("run_only") - F.col("baseline_only")) / F.col("n"), 4))


@query(
    """WITH g AS (SELECT l_orderkey AS question, l_returnflag AS side, CASE WHEN l_quantity > 30 THEN 2 WHEN l_quantity > 10 THEN 1 ELSE 0 END AS grade FROM lineitem)
    SELECT question, count(DISTINCT side) AS sides, count(*) AS units, round(count(*) FILTER (grade = 2) / count(*), 4) AS recall, bool_and(grade = 2) AS complete, count(*) FILTER (grade = 1) AS loss,
    count(*) FILTER (grade = 0) AS missing, CASE WHEN count(DISTINCT side) = 1 THEN max(grade) > 0 END AS hit FROM g GROUP BY question"""
)
def eval_combined_sides(spark: SparkSession, d: str) -> DataFrame:
    """Measures of a question over its sides' units; those of a single ranking are null where there are several sides."""
    grade = F.when(F.col("l_quantity") > 30, 2).when(F.col("l_quantity") > 10, 1).otherwise(0)
    g = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_returnflag").alias("side"), grade.alias("grade"))
    sides = F.countDistinct("side")
    return g.groupBy("question").agg(
        sides.alias("sides"), F.count("*").alias("units"), F.round(F.count_if(F.col("grade") == 2) / F.count("*"), 4).alias("recall"), F.bool_and(F.col("grade") == 2).alias("complete"),
        F.count_if(F.col("grade") == 1).alias("loss"), F.count_if(F.col("grade") == 0).alias("missing"), F.when(sides == 1, F.max("grade") > 0).alias("hit"),
    )


@query(
    """SELECT event_id, CASE WHEN NOT json_valid(props) OR json_type(props) <> 'OBJECT' THEN 'not_json' WHEN json_keys(props) <> ['k'] THEN 'keys' WHEN json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'types'
    WHEN (props ->> '$.k')::BIGINT NOT BETWEEN 0 AND 89 THEN 'range' END AS problem FROM events WHERE props IS NOT NULL"""
)
def metadata_strict_properties(spark: SparkSession, d: str) -> DataFrame:
    """Why an event's properties break their contract (the one key k, a whole number from 0 to 89), else null."""
    keys, k = F.json_object_keys("props"), F.get_json_object("props", "$.k")
    problem = (
        F.when(keys.isNull(), "not_json")
        .when(F.array_join(keys, "\n") != "k", "keys")
        .when(~k.rlike(r"\A-?[0-9]+\z") | F.col("props").rlike(r':\s*"'), "types")
        .when(~k.try_cast("long").between(0, 89), "range")
    )
    return table(spark, d, "events").where("props IS NOT NULL").select("event_id", problem.alias("problem"))


@query(
    """WITH r AS (SELECT conv_id, role, list(turn ORDER BY turn) AS turns FROM conversations WHERE role IS NOT NULL GROUP BY ALL)
    SELECT conv_id, '{' || string_agg('"' || role || '":[' || array_to_string(turns, ',') || ']', ',' ORDER BY role) || '}' AS roles FROM r GROUP BY 1"""
)
def conversation_roles(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each role of a conversation, as nested JSON."""
    r = table(spark, d, "conversations").where("role IS NOT NULL").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return r.groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "turns"))))).alias("roles"))


@query(
    r"""WITH q AS (SELECT doc_id, lower(regexp_replace(string_split(text, chr(10))[1], '[ \t\r\n]+', '', 'g')) AS q FROM documents WHERE text IS NOT NULL)
    SELECT md5(q) AS title_md5, count(*) AS n, min(doc_id) AS first_doc FROM q GROUP BY q HAVING count(*) > 1"""
)
def governance_repeated_titles(spark: SparkSession, d: str) -> DataFrame:
    """First lines that more than one document has, whatever their white space and case."""
    title = F.lower(squashed(F.split_part("text", F.lit("\n"), F.lit(1))))
    q = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(title).alias("title_md5"))
    return q.groupBy("title_md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


#: Recorded prefixes of paths and what stands for them here; the first that fits is taken.
PREFIXES = {"http://blog.theres.example.com": "/srv/theres", "http://blog": "/srv/never", "https://www.ththhe.example.com/": "/srv/ththhe/", "http://thther.example.org/es": "/srv/es"}
FLAT = "replace(url, chr(92), '/')"


@query(
    "SELECT page_id, CASE "
    + " ".join(f"WHEN {FLAT} = '{a.rstrip('/')}' OR starts_with({FLAT}, '{a.rstrip('/')}/') THEN '{b.rstrip('/')}' || substr({FLAT}, {len(a.rstrip('/')) + 1})" for a, b in PREFIXES.items())
    + " ELSE url END AS path FROM pages"
)
def text_mapped_paths(spark: SparkSession, d: str) -> DataFrame:
    """Recorded paths under known prefixes are moved; a prefix ends at a slash; others stay as they are."""
    flat, path = F.replace("url", F.lit("\\"), F.lit("/")), F.col("url")
    for old, new in reversed(PREFIXES.items()):
        old, new = old.rstrip("/"), new.rstrip("/")
        path = F.when((flat == old) | flat.startswith(old + "/"), F.concat(F.lit(new), F.substr(flat, F.lit(len(old) + 1)))).otherwise(path)
    return table(spark, d, "pages").select("page_id", path.alias("path"))


@query(
    """SELECT o_orderkey, coalesce(format('{:,}', floor(o_totalprice)::BIGINT) || '원', '-') AS amount, coalesce(CASE WHEN o_orderdate = date_trunc('day', o_orderdate) THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END, '-') AS day FROM orders"""
)
def order_shown_values(spark: SparkSession, d: str) -> DataFrame:
    """Amounts with separators, dates by their precision, and a dash for what is missing."""
    at = F.col("o_orderdate").cast("timestamp")
    day = F.when(at == F.date_trunc("day", at), F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))
    amount = F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit("원"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(amount, F.lit("-")).alias("amount"), F.coalesce(day, F.lit("-")).alias("day"))


@query(
    """WITH x AS (SELECT l_orderkey, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_returnflag)) AS flag, max(l_shipdate) AS decided_at FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
    SELECT o_orderkey, CASE flag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS status, decided_at FROM orders LEFT JOIN x ON l_orderkey = o_orderkey"""
)
def ledger_suggestion_status(spark: SparkSession, d: str) -> DataFrame:
    """Orders as suggestions, their lines as decisions: the status by the last decision, pending without one."""
    last = F.max(F.struct("l_shipdate", "l_linenumber", "l_returnflag"))
    x = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(last.alias("x"))
    status = F.when(F.col("x.l_returnflag") == "A", "approved").when(F.col("x.l_returnflag") == "R", "rejected").otherwise("pending")
    return table(spark, d, "orders").select("o_orderkey").join(x, "o_orderkey", "left").select("o_orderkey", status.alias("status"), F.col("x.l_shipdate").alias("decided_at"))


@query("SELECT doc_id, source FROM documents ORDER BY sha256('11:' || doc_id::VARCHAR), doc_id LIMIT 50")
def governance_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents in seeded order."""
    return table(spark, d, "documents").select("doc_id", "source").orderBy(seeded(11, "doc_id"), "doc_id").limit(50)


@query(
    """WITH c AS (SELECT l_suppkey AS doc, l_partkey AS code, count(*) FILTER (l_returnflag = 'N') AS detail, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT doc, count(*) AS codes, count(*) FILTER (detail > 0) AS detail, count(*) FILTER (detail = 0) AS summary_only, count(*) FILTER (detail > 1) AS repeated_detail, sum(n)::BIGINT AS n FROM c GROUP BY doc"""
)
def agg_code_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Codes (parts) of a document (supplier): with detail rows, only in summaries, with repeated details. Rows of a code are counted first."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), "l_partkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("d"), F.count("*").alias("c"))
    return c.groupBy("doc").agg(
        F.count("*").alias("codes"), F.count_if(F.col("d") > 0).alias("detail"), F.count_if(F.col("d") == 0).alias("summary_only"), F.count_if(F.col("d") > 1).alias("repeated_detail"), F.sum("c").alias("n")
    )


@query(
    """WITH t AS (SELECT coalesce(sum(round(value * 1000)::BIGINT) FILTER (event_type = 'purchase'), 0)::BIGINT AS spent, coalesce(sum(round(value * 1000)::BIGINT) FILTER (event_type IN ('view', 'click')), 0)::BIGINT AS pending,
    count(*) FILTER (event_type = 'error') AS unknown, (count(*) * 100000)::BIGINT AS cap FROM events)
    SELECT *, cap - spent - pending AS available, floor(spent * 100 / cap)::BIGINT AS spent_percent, floor((spent + pending) * 100 / cap)::BIGINT AS committed_percent,
    array_to_string(list_filter([50, 75, 90], lambda x: (spent + pending) * 100 >= cap * x), ',') AS warnings FROM t"""
)
def ledger_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Spent, pending, available and unknown of the whole ledger, with all warning levels that are reached."""
    micro, kind = F.round(F.col("value") * 1000).cast("long"), F.col("event_type")
    total = lambda *kinds: F.coalesce(F.sum(F.when(kind.isin(*kinds), micro)), F.lit(0))
    t = table(spark, d, "events").agg(total("purchase").alias("spent"), total("view", "click").alias("pending"), F.count_if(kind == "error").alias("unknown"), (F.count("*") * 100000).alias("cap"))
    spent, both, cap = F.col("spent"), F.col("spent") + F.col("pending"), F.col("cap")
    levels = F.filter(F.array(*map(F.lit, (50, 75, 90))), lambda x: both * 100 >= cap * x)
    percent = lambda x: F.floor(x * 100 / cap)
    return t.select("*", (cap - both).alias("available"), percent(spent).alias("spent_percent"), percent(both).alias("committed_percent"), F.array_join(levels.cast("array<string>"), ",").alias("warnings"))
