"""All queries of the library."""

from . import analyzed, answers, checks, events, extracts, folds, linked, lookups, metadata, numbers, readings, relational, retrieval, reviews, routing, structure, texts, values
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analyzed", "answers", "checks", "events", "extracts", "folds", "linked", "lookups", "metadata", "numbers", "readings", "relational", "retrieval", "reviews", "routing", "structure", "texts", "values"]
