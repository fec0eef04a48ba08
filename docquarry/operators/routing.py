"""Choosing documents by the names that a question restates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that restate a name, documents above which a word names a kind, share of the best weight, documents routed at most.
RESTATED, RARE, SHARE, MOST = 2, 4, 0.5, 4


def restated_names(asked: DataFrame, names: DataFrame, query: str, doc: str, rare: int | None = RARE) -> DataFrame:
    """(query, doc, matched, rarest, weight, shared): documents (doc, terms) of whose terms a query (query, term) restates two or more, one of them
    in fewer than `rare` of the query's matched documents (None: any). A term weighs the logarithm of its rarity."""
    terms = names.select(doc, F.explode("terms").alias("term"))
    met = terms.join(asked.select(query, "term"), "term")
    counts = met.groupBy(query, "term").agg(F.count("*").alias("df"))
    weight = F.log(F.lit(names.count()) / F.col("df"))
    found = met.join(counts, [query, "term"]).groupBy(query, doc).agg(
        F.count("*").alias("matched"), F.min("df").alias("rarest"), F.round(F.sum(weight), 6).alias("weight"), F.array_sort(F.collect_list("term")).alias("shared"), F.collect_list(F.struct("term", weight.alias("w"))).alias("weights")
    )
    found = found.where(F.col("matched") >= RESTATED)
    return found if rare is None else found.where(F.col("rarest") < rare)


def route_by_names(asked: DataFrame, names: DataFrame, query: str, doc: str) -> DataFrame:
    """(query, doc): candidates in order of falling weight, taken while the words that no taken one explains weigh half the best weight, or if a taken
    one matched the very same words. A query that takes more than MOST takes none. The fold sees only documents whose own weight, which is
    never less than what is left of it, is half the best."""
    found = restated_names(asked, names, query, doc)
    near = found.join(found.groupBy(query).agg(F.max("weight").alias("top")), query).where((F.col("top") > 0) & (F.col("weight") >= SHARE * F.col("top")))
    ordered = near.groupBy(query, "top").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), F.col(doc).alias("doc"), "shared", "weights"))).alias("r"))
    state = F.struct(F.array().cast("array<bigint>").alias("docs"), F.array().cast("array<string>").alias("explained"), F.array().cast("array<array<string>>").alias("sets"))

    def step(acc: Column, x: Column) -> Column:
        left = F.aggregate(F.filter(x["weights"], lambda t: ~F.array_contains(acc["explained"], t["term"])), F.lit(0.0), lambda s, t: s + t["w"])
        take = (left >= SHARE * F.col("top")) | F.exists(acc["sets"], lambda s: s == x["shared"])
        return F.struct(
            F.when(take, F.array_append(acc["docs"], x["doc"].cast("bigint"))).otherwise(acc["docs"]).alias("docs"),
            F.when(take, F.array_union(acc["explained"], x["shared"])).otherwise(acc["explained"]).alias("explained"),
            F.when(take, F.array_append(acc["sets"], x["shared"])).otherwise(acc["sets"]).alias("sets"),
        )

    taken = ordered.select(query, F.aggregate("r", state, step)["docs"].alias("docs"))
    return taken.where(F.size("docs") <= MOST).select(query, F.explode("docs").alias(doc))
