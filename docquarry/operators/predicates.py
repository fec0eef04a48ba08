"""Filters over typed metadata whose values may be undecidable: a row is matched, excluded, or left for review with reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A filterable column; an amount of zero or below least is never decidable, nor is a field named in the conflicts column."""

    column: str
    operators: tuple[str, ...]
    least: float | None = None


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    values: tuple[Any, ...]


COMPARE = {
    "=": lambda have, a: have == a,
    "!=": lambda have, a: have != a,
    ">": lambda have, a: have > a,
    ">=": lambda have, a: have >= a,
    "<": lambda have, a: have < a,
    "<=": lambda have, a: have <= a,
    "between": lambda have, a, b: have.between(a, b),
    "contains": lambda have, a: have.contains(a),
}


def reason(field: Field, name: str, conflicts: str) -> Column:
    """Why a value cannot be decided; null if it can."""
    have = F.col(field.column)
    found = F.when(F.array_contains(F.col(conflicts), name), "conflict").when(have.isNull(), "missing")
    if field.least is not None:
        found = found.when(have == 0, "zero").when(have < field.least, "too_small")
    return found


def query_metadata(rows: DataFrame, fields: dict[str, Field], filters: Sequence[Filter], conflicts: str = "conflict_fields") -> DataFrame:
    """Rows that no decidable filter excludes, with outcome (matched or review) and reasons. Unknown fields or operators are refused."""
    for f in filters:
        if f.field not in fields or f.operator not in fields[f.field].operators:
            raise ValueError(f"no filter {f.operator!r} on {f.field!r}")
    tests = [(f, reason(fields[f.field], f.field, conflicts), COMPARE[f.operator](F.col(fields[f.field].column), *map(F.lit, f.values))) for f in filters]
    excluded = reduce(Column.__or__, [why.isNull() & ~holds for _, why, holds in tests], F.lit(False))
    reasons = F.array_compact(F.array(*[F.when(why.isNotNull(), F.concat(F.lit(f"{f.field}:"), why)) for f, why, _ in tests])) if tests else F.array().cast("array<string>")
    kept = rows.where(~F.coalesce(excluded, F.lit(False))).withColumn("reasons", F.array_distinct(reasons))
    return kept.withColumn("outcome", F.when(F.size("reasons") == 0, "matched").otherwise("review"))


def quality_flags(rows: DataFrame, amount: str, dates: Sequence[str]) -> Column:
    """The flags of a row: amount_missing, amount_zero_review, amount_fractional, and <date>_missing."""
    have = F.col(amount)
    flags = [F.when(have.isNull(), "amount_missing"), F.when(have == 0, "amount_zero_review"), F.when(have != F.floor(have), "amount_fractional")]
    return F.array_compact(F.array(*flags, *[F.when(F.col(d).isNull(), f"{d}_missing") for d in dates]))


def overlay(rows: DataFrame, resolutions: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """The latest resolution of each (key, field) replaces the value; raw values stay as raw_<field>. resolutions: key, field, value, order."""
    latest = resolutions.groupBy(key, "field").agg(F.max_by("value", F.struct(order, "value")).alias("value"))
    wide = latest.groupBy(key).pivot("field", list(fields)).agg(F.first("value"))
    wide = wide.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = rows.join(wide, key, "left")
    types = dict(rows.dtypes)
    kept = [F.col(c) for c in rows.columns if c not in fields]
    return joined.select(*kept, *[F.col(f).alias(f"raw_{f}") for f in fields], *[F.coalesce(F.col(f"__{f}").cast(types[f]), F.col(f)).alias(f) for f in fields])
