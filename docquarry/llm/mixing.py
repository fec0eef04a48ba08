"""Operator 4: mixing sources to target weights, in DataFrame operations only.

A source's weight is its share of all tokens to the power of an exponent between 0 (all sources alike) and 1 (as they are),
normalised. The exponent is bisected until the weights' entropy meets a target, a share of the largest possible entropy; if a source
would then be repeated more often than the limit, the exponent is bisected to meet that limit instead. Four bisection steps are
evaluated in one aggregation over the table of sources.

A source's quota of the token budget is taken in blocks. Each block is a new permutation of all its documents, by hash; the last block
stops before the first document that would exceed the quota. To find that place, tokens are added up in ranges of the hash; only rows
of the one range with the border are numbered one by one. `mix_key` is a copy's place in the mixed stream:
it grows from 0 along a source's blocks, and 1 is the end of the quota (about: the last block is laid out by hash, not by tokens).

Defined cases: a null source is a source of its own; a null or empty text has no tokens; a source without any token has no weight, and
its documents are taken once; repeated rows are separate documents; a null doc_id hashes like the empty one; ties in the hash
are ordered by doc_id; an empty table gives no rows; extra columns are kept, whatever their names but mix_block and mix_key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

STEPS, LEVELS = 52, 4
#: Sources up to this number are broadcast to the documents; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def words(text: F.Column) -> F.Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bisect(sources: DataFrame, measure, target: float) -> float:
    """The exponent at which a falling measure of the weights (an aggregate of p, the tokens' share, and the exponent) meets target."""
    low, high = 0.0, 1.0
    for _ in range(STEPS // LEVELS):
        points: dict[int, float] = {}

        def halve(k: int, a: float, b: float) -> None:
            if k < 1 << LEVELS:
                points[k] = (a + b) / 2
                halve(2 * k, a, points[k])
                halve(2 * k + 1, points[k], b)

        halve(1, low, high)
        got = sources.agg(*[measure(F.lit(x)).alias(f"at{k}") for k, x in points.items()]).first()
        k = 1
        while k < 1 << LEVELS:
            if got[f"at{k}"] > target:
                low, k = points[k], 2 * k + 1
            else:
                high, k = points[k], 2 * k
    return (low + high) / 2


def exponent(sources: DataFrame, entropy_share: float, most_repeats: float, budget: float | None, total: int, n: int) -> float:
    """The exponent for the sources' table (p: share of tokens, all over 0). budget None: as many tokens as use each document once or more."""
    power = lambda a: F.exp(a * F.log("p"))

    def entropy(a):
        return F.log(F.sum(power(a))) - F.sum(power(a) * a * F.log("p")) / F.sum(power(a))

    def repeats(a):  # the smallest source is repeated most
        most = F.max(power(a) / F.col("p"))
        return most / F.min(power(a) / F.col("p")) if budget is None else most / F.sum(power(a)) * (budget / total)

    def meets(measure, target: float) -> float:
        return 1.0 if sources.agg(measure(F.lit(1.0))).first()[0] >= target else bisect(sources, measure, target)

    found = meets(entropy, entropy_share * math.log(n)) if n > 1 else 1.0
    if sources.agg(repeats(F.lit(found))).first()[0] > most_repeats:
        found = meets(repeats, most_repeats)
    return found


def weigh(sources: DataFrame, entropy_share: float, most_repeats: float, budget: int | None) -> DataFrame:
    """sources (source, tokens) with weight, quota, blocks (whole ones) and rest (tokens of the last block)."""
    with_tokens = sources.where("tokens > 0")
    total, n = with_tokens.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return sources.selectExpr("source", "tokens", "0.0D AS weight", "0L AS quota", "1L AS blocks", "0L AS rest")
    shares = with_tokens.withColumn("p", F.col("tokens") / F.lit(total))
    a = F.lit(exponent(shares, entropy_share, most_repeats, budget, total, n))
    norm, rarest = shares.agg(F.sum(F.exp(a * F.log("p"))), F.min(F.exp(a * F.log("p")) / F.col("p"))).first()
    quota = F.col("weight") * F.lit(budget) + 1e-6 if budget is not None else F.exp(a * F.log("p")) / F.col("p") / F.lit(rarest) * F.col("tokens") * F.lit(1 + 1e-12)
    weighed = sources.withColumn("p", F.col("tokens") / F.lit(total)).withColumn("weight", F.when(F.col("tokens") > 0, F.exp(a * F.log("p")) / F.lit(norm)).otherwise(0.0))
    weighed = weighed.withColumn("quota", F.when(F.col("tokens") > 0, F.floor(quota)).otherwise(0).cast("long"))
    blocks = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1)
    return weighed.withColumn("blocks", blocks.cast("long")).withColumn("rest", F.col("quota") - F.col("blocks") * F.col("tokens")).drop("p")


def place(block: F.Column, seed: int) -> F.Column:
    """The hash that orders a source's documents in a block: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def number(digits: F.Column, n: int) -> F.Column:
    return F.conv(F.substring(digits, 1, n), 16, 10).cast("long")


def mix(docs: DataFrame, entropy_share: float = 0.95, most_repeats: float = 4.0, budget: int | None = None, seed: int = 0, tokens: F.Column | None = None) -> DataFrame:
    """The rows of docs that the mixed stream takes, once for each copy, with mix_block and mix_key. tokens: the cost of a row (its words)."""
    columns = [F.col("__doc").getField(c).alias(c) for c in docs.columns if c not in ("mix_block", "mix_key")]
    cost = words(F.col("text")) if tokens is None else tokens
    rows = docs.select(F.struct("*").alias("__doc"), "doc_id", "source", cost.cast("long").alias("n"))
    sources = written(rows.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")))
    plan = written(weigh(sources.drop("docs"), entropy_share, most_repeats, budget).withColumnRenamed("source", "s"))
    if sources.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    same = F.col("source").eqNullSafe(F.col("s"))
    laid = rows.join(plan, same).drop("s")
    last = laid.withColumn("at", place(F.col("blocks"), seed)).withColumn("range", number(F.col("at"), 3))
    sums = last.where("rest > 0").groupBy("source", "range", "rest").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy("source").orderBy("range"))  # at most 4096 rows a source
    border = sums.withColumn("upto", running).where("upto > rest").groupBy("source").agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("b"))
    border = written(border.select(F.col("source").alias("s"), F.col("b.range").alias("border"), "b.before"))
    last = last.where("rest > 0").join(F.broadcast(border) if sources.count() <= BROADCAST_SOURCES else border, same)
    whole_ranges = last.where("range < border")
    order = Window.partitionBy("source", "range").orderBy("at", "doc_id", "n")
    split_range = last.where("range = border").withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
    full = laid.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("at", place(F.col("block"), seed))
    parts = [full, whole_ranges.withColumn("block", F.col("blocks")), split_range.where("upto <= rest").withColumn("block", F.col("blocks"))]
    key = (F.col("block") + number(F.col("at"), 12) / F.lit(16.0**12)) * F.col("tokens") / F.greatest(F.col("quota"), F.lit(1))
    out = [p.select("__doc", F.col("block").cast("int").alias("mix_block"), F.coalesce(key, F.lit(0.0)).alias("mix_key")) for p in parts]
    return out[0].unionAll(out[1]).unionAll(out[2]).select(*columns, "mix_block", "mix_key")


def oracle(entropy_share: float, most_repeats: float) -> str:
    """DuckDB SQL for the mixed documents; the budget is the number of tokens there are."""
    pw = "exp(a * ln(p))"
    entropy = f"(ln(sum({pw})) - sum({pw} * a * ln(p)) / sum({pw}))"
    repeats = f"(max({pw} / p) / sum({pw}))"

    def search(name: str, measure: str, target: str) -> str:
        value = f"(SELECT {measure.replace('a *', 'm *').replace('* a', '* m')} FROM shares)"
        return f"""{name}(k, lo, hi, m) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE UNION ALL
        SELECT k + 1, lo2, hi2, (lo2 + hi2) / 2 FROM (SELECT k, CASE WHEN {value} > {target} THEN m ELSE lo END AS lo2, CASE WHEN {value} > {target} THEN hi ELSE m END AS hi2 FROM {name} WHERE k < {STEPS}))"""

    at = lambda measure, a: measure.replace("a *", f"{a} *").replace("* a", f"* {a}")
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents),
    src AS (SELECT source, sum(n)::BIGINT AS tokens FROM d GROUP BY source),
    tot AS (SELECT sum(tokens)::BIGINT AS total, count(*) AS k FROM src WHERE tokens > 0),
    shares AS (SELECT source, tokens, tokens::DOUBLE / total AS p FROM src, tot WHERE tokens > 0),
    {search("e", entropy, f"(SELECT {entropy_share} * ln(k) FROM tot)")},
    {search("r", repeats, f"{most_repeats}")},
    a1 AS (SELECT CASE WHEN (SELECT {at(entropy, "1.0")} FROM shares) >= (SELECT {entropy_share} * ln(k) FROM tot) OR (SELECT k FROM tot) = 1 THEN 1.0 ELSE (SELECT m FROM e WHERE k = {STEPS}) END AS x),
    a2 AS (SELECT CASE WHEN (SELECT {at(repeats, "(SELECT x FROM a1)")} FROM shares) <= {most_repeats} THEN (SELECT x FROM a1)
                       WHEN (SELECT {at(repeats, "1.0")} FROM shares) >= {most_repeats} THEN 1.0 ELSE (SELECT m FROM r WHERE k = {STEPS}) END AS x),
    q AS (SELECT source, tokens, floor(exp(x * ln(p)) / (SELECT sum(exp(x * ln(p))) FROM shares, a2) * total + 1e-6)::BIGINT AS quota FROM shares, a2, tot
          UNION ALL SELECT source, tokens, 0 FROM src WHERE tokens = 0),
    b AS (SELECT source, tokens, quota, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS blocks FROM q),
    c AS (SELECT d.*, b.tokens, b.quota, b.blocks, b.quota - b.blocks * b.tokens AS rest, unnest(range(0, b.blocks + 1)) AS block FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
    h AS (SELECT *, md5('0:' || block || ':' || coalesce(doc_id::VARCHAR, '')) AS pos FROM c),
    u AS (SELECT *, sum(n) OVER (PARTITION BY source, block ORDER BY pos, doc_id, n ROWS UNBOUNDED PRECEDING) AS upto FROM h)
    SELECT doc_id, source, n AS n_tokens, block::INTEGER AS mix_block,
      round((block + ('0x' || substr(pos, 1, 12))::BIGINT / 281474976710656.0::DOUBLE) * tokens / greatest(quota, 1), 9) AS mix_key
    FROM u WHERE block < blocks OR (rest > 0 AND upto <= rest)"""
