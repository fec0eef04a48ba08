"""Splits, samples, digests, differences, pseudonyms and redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's values as text, nulls apart from any text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]), 256)


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(n_rows, digest): independent of the order of rows. All digits of the row hashes are added up in parts, so no task holds all of them."""
    hashed = df.select(row_hash(columns or sorted(df.columns)).alias("h"))
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring("h", k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return hashed.agg(F.count("*").alias("n_rows"), F.concat_ws("-", *[part(k) for k in (1, 13, 25, 37, 49, 53)]).alias("digest"))


def hash_parity_split(df: DataFrame, key: str, names: tuple[str, str] = ("dev", "test")) -> DataFrame:
    """split by the last hexadecimal digit of the key's SHA-256: even digits are the first name."""
    even = F.conv(F.right(F.sha2(F.col(key).cast("string"), 256), F.lit(1)), 16, 10).cast("int") % 2 == 0
    return df.withColumn("split", F.when(even, names[0]).otherwise(names[1]))


def seeded(seed: int, key: str) -> Column:
    """A stable pseudo-random order of keys."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def stratified_half(df: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    """drawn: true for half of each stratum (rounded up), in seeded order. Places are counted within blocks of three digits of the order, and
    the counts of the blocks before are added, so that a large stratum is not ranked in one task."""
    blocked = df.withColumn("__h", seeded(seed, key)).withColumn("__b", F.substring("__h", 1, 3))
    within = Window.partitionBy(*strata)
    counts = blocked.groupBy(*strata, "__b").agg(F.count("*").alias("__c"))
    laid = counts.withColumn("__before", F.sum("__c").over(within.orderBy("__b")) - F.col("__c")).withColumn("__n", F.sum("__c").over(within))
    laid = laid.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)], F.col("__b").alias("__bb"), "__before", "__n")
    same = F.col("__b") == F.col("__bb")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    place = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy("__h", key)) + F.col("__before")
    return blocked.join(laid, same).withColumn("drawn", place <= F.ceil(F.col("__n") / 2)).select(*df.columns, "drawn")


def proportional_sample(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows: one of each group, largest groups first, then by the highest quotient size / (picked + 1); (group, key, pick).
    A group's j-th row has the quotient size / j, so the sample is the top n of these, after the first rows."""
    size = df.groupBy(group).agg(F.count("*").alias("__size"))
    placed = df.select(group, key).withColumn("__j", F.row_number().over(Window.partitionBy(group).orderBy(seeded(seed, key), key))).where(F.col("__j") <= n)
    order = [F.asc(F.when(F.col("__j") == 1, 0).otherwise(1)), F.desc(F.when(F.col("__j") == 1, F.col("__size")).otherwise(F.col("__size") / F.col("__j"))), F.asc(group), F.asc("__j")]
    top = placed.join(size, group).orderBy(*order).limit(n)
    return top.withColumn("pick", F.row_number().over(Window.orderBy(*order))).select(group, key, "pick")


def pseudonym(key: str, column: Column, digits: int = 12) -> Column:
    """A keyed pseudonym: HMAC-SHA-256 written out with hashes of padded keys; null stays null."""
    block = key.encode().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    once = F.unhex(F.sha2(F.concat(inner, F.encode(column.cast("string"), "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, once), 256), 1, digits)


#: What is never shown, and its name.
SECRETS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "url": r"https?://[^ \t\r\n]+",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+?[0-9][0-9() -]{7,}[0-9]",
}


def redact(text: Column, secrets: dict[str, str] | None = None) -> Column:
    """Each secret is replaced by its name in brackets, in the given order."""
    for name, pattern in (secrets or SECRETS).items():
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def compare_rows(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, status) of two observations: improved and regressed by true and false, incomparable if one is not there."""
    b, a = before.select(key, F.col(value).alias("before"), F.lit(1).alias("__b")), after.select(key, F.col(value).alias("after"), F.lit(1).alias("__a"))
    status = (
        F.when(F.col("__b").isNull() | F.col("__a").isNull() | F.col("before").isNull() | F.col("after").isNull(), "incomparable")
        .when(~F.col("before") & ~F.col("after"), "both_failed")
        .when(~F.col("before"), "improved")
        .when(~F.col("after"), "regressed")
        .otherwise("same")
    )
    return b.join(a, key, "full_outer").withColumn("status", status).drop("__b", "__a")


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b) where two sets of (key, value) differ."""
    return a.toDF("key", "a").join(b.toDF("key", "b"), "key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
