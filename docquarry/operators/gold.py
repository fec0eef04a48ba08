"""Rows of datasets: errors, decisions, revisions, attempts and release checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_errors(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """df with errors: the names of the rules (true where broken) in order; null counts as not broken."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()])))


def first_reason(rules: Mapping[str, Column], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, test in rules.items():
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def first_decision(df: DataFrame, keys: Sequence[str], order: Sequence[str], by: str, what: str) -> DataFrame:
    """(keys, decided_by, decision, second_by, agreed): the first row of a key decides; the first one by someone else is the second review."""
    row = F.struct(*order, F.col(by).alias("by"), F.col(what).alias("what"))
    first = df.groupBy(*keys).agg(F.min(row).alias("f"))
    met = df.join(first.select(*keys, F.col("f.by").alias("__by")), [*keys])
    second = met.where(F.col(by) != F.col("__by")).groupBy(*keys).agg(F.min(row).alias("s"))
    out = first.join(second, [*keys], "left")
    return out.select(*keys, F.col("f.by").alias("decided_by"), F.col("f.what").alias("decision"), F.col("s.by").alias("second_by"), (F.col("s.what") == F.col("f.what")).alias("agreed"))


def revision_errors(df: DataFrame, key: Sequence[str], revision: str, content: str) -> DataFrame:
    """Rows of df that are no valid next revision: gap (numbers must rise by one from 1), repeated (a number twice), unchanged (as the one before)."""
    own = Window.partitionBy(*key).orderBy(revision, content)
    before = F.lag(revision, 1, 0).over(own)
    errors = {"repeated": F.col(revision) == before, "gap": F.col(revision) > before + 1, "unchanged": F.col(content) == F.lag(content).over(own)}
    return row_errors(df, errors).where(F.size("errors") > 0)


def resume_plan(attempts: DataFrame, keys: Sequence[str], state: str, conclusive: Sequence[str], unsure: Sequence[str]) -> DataFrame:
    """(keys, attempts, action): done if any attempt is conclusive; held if one is in an unsure state, which is never sent again; else retry."""
    any_of = lambda names: F.bool_or(F.col(state).isin(*names))
    by = attempts.groupBy(*keys).agg(F.count("*").alias("attempts"), any_of(conclusive).alias("__c"), any_of(unsure).alias("__u"))
    return by.select(*keys, "attempts", F.when(F.col("__c"), "done").when(F.col("__u"), "held").otherwise("retry").alias("action"))


def release_decision(checks: DataFrame, keys: Sequence[str], kind: str, ok: str) -> DataFrame:
    """(keys, decision): blocked if a hard check fails, limited if one is unknown or a quality target isn't met, else ready."""
    hard, fine = F.col(kind) == "hard", F.col(ok)
    by = checks.groupBy(*keys).agg(F.count_if(hard & ~fine).alias("__b"), F.count_if((hard & fine.isNull()) | (~hard & (fine.isNull() | ~fine))).alias("__l"))
    return by.select(*keys, F.when(F.col("__b") > 0, "blocked").when(F.col("__l") > 0, "limited").otherwise("ready").alias("decision"))
