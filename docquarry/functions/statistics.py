"""Closed forms of small-sample statistics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high), rounded to 4 places and held in 0..1; null without trials."""
    k, m = successes.cast("double"), n.cast("double")
    p, z2 = k / m, z * z
    middle, half = p + z2 / (2 * m), z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    low, high = (middle - half) / (1 + z2 / m), (middle + half) / (1 + z2 / m)
    held = lambda x: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 4)
    return F.when(n > 0, F.struct(held(low).alias("low"), held(high).alias("high")))


def kappa(both: Column, first: Column, second: Column, neither: Column) -> Column:
    """Cohen's kappa of two yes/no raters from four counts; null if chance agreement is certain."""
    n = (both + first + second + neither).cast("double")
    agree, p1, p2 = (F.try_divide(x, n) for x in (both + neither, both + first, both + second))
    chance = p1 * p2 + (1 - p1) * (1 - p2)
    return F.when((n > 0) & (chance < 1), F.try_divide(agree - chance, 1 - chance))


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series from 10 on, after a product for smaller numbers."""
    x = n.cast("double")
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(10)]), (F.least(n, F.lit(9)) + 1).cast("int"))
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 10, small).otherwise(x * F.ln(x) - x + F.ln(2 * math.pi * x) / 2 + series)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p-value of b against c discordant pairs. The binomial tail is added up from its largest term down, as shares of that
    term, whose logarithm is taken once: numbers of any size neither underflow nor need more than some root of n terms."""
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    steps = F.least(k, F.ceil(6 * F.sqrt(n)) + 60).cast("long")  # a term this far down is under e^-50 of the largest
    start = F.struct(F.lit(1.0).alias("share"), F.lit(1.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        share = acc["share"] * (k - j + 1) / (n - k + j)
        return F.struct(share.alias("share"), (acc["total"] + share).alias("total"))

    total = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), steps), lambda j: j > 0), start, step)["total"]
    logarithm = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2)
    few = F.least(k, F.lit(500))  # numbers of up to 1,000 pairs fit as they are, without the rounding of a logarithm
    ways = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), few), lambda j: j > 0), F.lit(1.0), lambda acc, j: acc * (n - k + j) / j)
    largest = F.when(n <= 1000, ways * F.pow(F.lit(0.5), n.cast("double"))).otherwise(F.exp(logarithm))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total * largest))


def holm(df: DataFrame, family: list[str], p: str, name: str) -> DataFrame:
    """df with p-values adjusted by Holm within each family; ties in p are ordered by name."""
    w = Window.partitionBy(*family).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*family))
    scaled = (m - F.row_number().over(w) + 1) * F.col(p)
    return df.withColumn("__s", scaled).withColumn("p_holm", F.least(F.lit(1.0), F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def gain(grade: Column, rank: Column) -> Column:
    """A graded item's part of the discounted cumulative gain at a rank from 1."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + F.lit(1.0))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, nearest: Mapping[str, float] | None = None, between: Mapping[str, float] | None = None) -> DataFrame:
    """(keys, one column for each name): values at index int(q (n - 1) + 0.5) of a group's sorted values (nearest), and interpolated ones at
    q (n - 1) (between). From a histogram of distinct values with a running sum, so that no group meets in a list; nulls are left out."""
    by = Window.partitionBy(*keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    laid = counted.withColumn("__upto", F.sum("__c").over(by.orderBy("__v"))).withColumn("__n", F.sum("__c").over(by))

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("__upto") > index, F.col("__v")))

    def interpolated(q: float) -> Column:
        place = q * (F.col("__n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    exact = [at(F.floor(q * (F.col("__n") - 1) + 0.5)).alias(name) for name, q in (nearest or {}).items()]
    return laid.groupBy(*keys).agg(*exact, *[interpolated(q).alias(name) for name, q in (between or {}).items()])


def threshold_band(items: DataFrame, score: str, positive: str, floor: float, top: float = 1 + 1e-9) -> DataFrame:
    """One row (lo, hi, kappa, coverage, false_accepts, n, points, meets_floor): the best of all bands lo <= hi of distinct scores, 0 and `top`. Scores from hi on are
    accepted, those below lo rejected, those between and null ones abstain, and coverage is the share of all items that don't. Bands that
    reach the floor come first, then those with more kappa, fewer false accepts, more coverage, and the narrower.

    Scores are counted by value, and cuts carry running counts, so bands are pairs of cuts only; round scores to bound their number."""
    s, yes = F.col(score), F.col(positive)
    by_score = items.where(s.isNotNull()).groupBy(s.alias("cut")).agg(F.count_if(yes).alias("pos"), F.count_if(~yes).alias("neg"))
    ends = items.sparkSession.createDataFrame([(0.0, 0, 0), (float(top), 0, 0)], "cut double, pos long, neg long")
    cuts = by_score.unionByName(ends).groupBy("cut").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    listed = cuts.agg(F.array_sort(F.collect_list(F.struct("cut", "pos", "neg"))).alias("c"))
    upto = lambda name: lambda c, i: F.aggregate(F.slice("c", F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    below = F.transform("c", lambda c, i: F.struct(c["cut"].alias("cut"), F.when(i > 0, upto("pos")(c, i)).otherwise(0).alias("pb"), F.when(i > 0, upto("neg")(c, i)).otherwise(0).alias("nb")))
    total = lambda name: F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    n = items.agg(F.count("*").alias("n"))
    laid = listed.select(below.alias("b"), total("pos").alias("pos"), total("neg").alias("neg")).join(F.broadcast(n), F.lit(True))  # one row each
    lows = laid.select("b", "pos", "neg", "n", F.explode("b").alias("l"))
    bands = lows.select("pos", "neg", "n", "l", F.explode(F.filter("b", lambda h: h["cut"] >= F.col("l.cut"))).alias("h"))
    counted = bands.select(F.col("l.cut").alias("lo"), F.col("h.cut").alias("hi"), (F.col("pos") - F.col("h.pb")).alias("tp"), (F.col("neg") - F.col("h.nb")).alias("fa"), F.col("l.pb").alias("fr"), F.col("l.nb").alias("tn"), "n", (F.col("pos") + F.col("neg")).alias("points"))
    judged = counted.withColumn("m", F.col("tp") + F.col("fa") + F.col("fr") + F.col("tn"))
    scored = judged.withColumns({"kappa": kappa(F.col("tp"), F.col("fr"), F.col("fa"), F.col("tn")), "coverage": F.try_divide("m", "n")})
    meets = F.coalesce(F.col("coverage") >= floor, F.lit(False))
    order = [F.desc(meets), F.desc(F.round(F.coalesce("kappa", F.lit(-1.0)), 9)), F.asc("fa"), F.desc("m"), F.asc(F.round(F.col("hi") - F.col("lo"), 6)), F.asc("lo")]
    return scored.orderBy(*order).limit(1).select("lo", "hi", F.round("kappa", 6).alias("kappa"), F.round("coverage", 6).alias("coverage"), F.col("fa").alias("false_accepts"), "n", "points", meets.alias("meets_floor"))
