"""Queries on two readings of a text: as it is, and with what must not be shown taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import squashed
from docquarry.operators.alignment import aligned, fidelity, remade, with_edits
from docquarry.operators.governance import redact
from docquarry.operators.placement import placed, quote_places
from docquarry.sources.tables import table

from . import texts  # noqa: F401  its SQL is used below
from .registry import SQL, query

PAGE = 1000  # characters of a page of the shown reading
SHOWN = SQL["text_redaction"].replace("SELECT doc_id, md5(", "SELECT doc_id, text, (", 1).replace("AS redacted_md5", "AS shown", 1)


@query(
    f"""WITH r AS ({SHOWN}) SELECT doc_id, md5(coalesce(shown, '')) AS shown_md5, md5(coalesce(text, '')) AS text_md5, coalesce(length(shown), 0) - coalesce(length(text), 0) AS grown, coalesce(shown <> text, false) AS changed FROM r"""
)
def text_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits between a text and its shown reading: each reading made anew from the other by them, and how many characters they add."""
    both = table(spark, d, "documents").select("doc_id", "text", redact(F.col("text")).alias("shown"))
    made = remade(remade(with_edits(both, "text", "shown"), "text", "edits", True, "forth"), "shown", "edits", False, "back")
    grown = F.aggregate("edits", F.lit(0).cast("long"), lambda n, x: n + F.length(x["new"]) - F.length(x["old"]))
    return made.select("doc_id", F.md5("forth").alias("shown_md5"), F.md5("back").alias("text_md5"), grown.alias("grown"), (F.size("edits") > 0).alias("changed"))


def readings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(units: the lines of each text; pages: its shown reading without white space, cut every PAGE characters)."""
    docs = table(spark, d, "documents").where("text is not null")
    units = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("unit", "text"))
    shown = docs.select("doc_id", squashed(redact(F.col("text"))).alias("t"))
    numbers = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("t") / PAGE) - 1).cast("int"))).alias("page")
    pages = shown.select(F.col("doc_id").alias("doc"), "t", numbers).select("doc", "page", F.substr("t", F.col("page") * PAGE + 1, F.lit(PAGE)).alias("text"))
    return units, pages


@query()
def text_page_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The pages on which each line may stand."""
    units, pages = readings(spark, d)
    found = aligned(units.select("doc", "unit", squashed(F.col("text")).alias("text")).where("text <> ''"), pages)
    return found.select(F.col("doc").alias("doc_id"), "unit", F.concat_ws(",", F.transform("pages", lambda p: p.cast("string"))).alias("pages"))


@query()
def text_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """What of each text its shown reading no longer has, and a verdict."""
    return fidelity(*readings(spark, d)).withColumnRenamed("doc", "doc_id")


HEADS = "[40, 20, 10]"


@query(
    f"""WITH r AS ({SHOWN}), l AS (SELECT doc_id, text, unnest(string_split(shown, chr(10))) AS f FROM r WHERE text IS NOT NULL),
    h AS (SELECT doc_id, list_filter({HEADS}, lambda n: length(f) >= n AND strpos(text, substr(f, 1, n)) > 0 AND strpos(substr(text, strpos(text, substr(f, 1, n)) + 1), substr(f, 1, n)) = 0)[1] AS size FROM l)
    SELECT doc_id, count(*) AS fragments, count(*) FILTER (size = 40) AS by_40, count(*) FILTER (size = 20) AS by_20, count(*) FILTER (size = 10) AS by_10 FROM h GROUP BY 1"""
)
def text_anchored_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the shown reading that have a place in the text by an anchor of 40, 20 or 10 characters which it has once."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.split(redact(F.col("text")), "\n").alias("lines"))
    by = lambda n: F.size(F.filter("placed", lambda x: x["size"] == n)).cast("long").alias(f"by_{n}")
    return placed(docs, "text", "lines").select("doc_id", F.size("lines").cast("long").alias("fragments"), by(40), by(20), by(10))


@query(
    f"""WITH r AS ({SHOWN}), q AS (SELECT doc_id, text, regexp_replace(text, '[ \\t\\r\\n]+', '', 'g') AS hay, substr(regexp_replace(shown, '[ \\t\\r\\n]+', '', 'g'), doc_id % 7 * 40 + 1, 50) AS quote FROM r WHERE text IS NOT NULL),
    f AS (SELECT *, CASE WHEN quote <> '' THEN strpos(hay, quote) ELSE 0 END AS p FROM q),
    l AS (SELECT doc_id, row, sum(n) OVER (PARTITION BY doc_id ORDER BY row) AS upto FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[ \\t\\r\\n]+', '', 'g')))) AS n, unnest(range(len(string_split(text, chr(10))))) AS row FROM f)),
    w AS (SELECT f.doc_id, min(row) FILTER (upto >= p) AS a, min(row) FILTER (upto >= p + length(quote) - 1) AS b FROM f JOIN l USING (doc_id) GROUP BY 1)
    SELECT doc_id, CASE WHEN quote = '' THEN 'empty' WHEN p = 0 THEN 'missing' WHEN strpos(substr(hay, p + 1), quote) > 0 THEN 'repeated' WHEN a = b THEN 'row' ELSE 'across' END AS verdict,
      CASE WHEN p > 0 THEN a END AS first_row, CASE WHEN p > 0 THEN b END AS last_row FROM f JOIN w USING (doc_id)"""
)
def text_quote_places(spark: SparkSession, d: str) -> DataFrame:
    """A passage of each shown reading, looked for in the text: in a row, across rows, repeated, or missing."""
    plain = table(spark, d, "documents").where("text is not null")
    quotes = plain.select("doc_id", "text", F.substr(F.regexp_replace(redact(F.col("text")), "[ \t\r\n]+", ""), (F.col("doc_id") % 7 * 40 + 1).cast("int"), F.lit(50)).alias("quote"))
    return quote_places(quotes, "text", "quote", PAGE).select("doc_id", "verdict", "first_row", "last_row")
