"""Verdicts on claims: what a text states against what is wanted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_verdict(wanted: Column, stated: Column, qualified: Column) -> Column:
    """wanted: a value or null; stated: the distinct values of a text. Contested if others are stated beside it, incomplete without its qualifier."""
    held = F.array_contains(stated, wanted)
    return (
        F.when(wanted.isNull(), "needs_review")
        .when(held & (F.size(stated) > 1), "contested")
        .when(held & ~qualified, "incomplete_qualifier")
        .when(held, "correct")
        .when(F.size(stated) > 0, "wrong_value")
        .otherwise("missing")
    )
