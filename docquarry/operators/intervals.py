"""Interval joins, unions and sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.sources.intermediate import written


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of left (start, end) and right (other_start, other_end) with equal keys whose half-open ranges overlap. Ranges meet by grid
    cells of `width`; a pair is kept in the cell where the overlap begins only, so no distinct is needed."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    a = left.where("end > start").withColumn("__cell", cells("start", "end"))
    b = right.where("other_end > other_start").withColumn("__cell", cells("other_start", "other_end"))
    met = a.join(b, [*keys, "__cell"]).where("start < other_end AND other_start < end")
    return met.where(F.floor(F.greatest("start", "other_start") / width) == F.col("__cell")).drop("__cell")


def union_length(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, covered, repeated): the length of the union of ranges, and what is covered more than once, counted each time."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.max(end).over(before), F.col(start))))
    laid = spans.withColumn("__fresh", fresh)
    return laid.groupBy(*keys).agg(F.sum("__fresh").alias("covered"), F.sum(F.col(end) - F.col(start) - F.col("__fresh")).alias("repeated"))


def sweep(spans: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Disjoint segments (keys, start, end, items): overlapping ranges cut at every border, with the items over each segment."""
    borders = spans.select(*keys, F.explode(F.array("start", "end")).alias("at")).distinct()
    ends = borders.select(*keys, F.col("at").alias("other_start"), F.lead("at").over(Window.partitionBy(*keys).orderBy("at")).alias("other_end"))
    met = spans.join(ends.where("other_end IS NOT NULL"), list(keys)).where("start < other_end AND other_start < end")
    return met.groupBy(*keys, F.col("other_start").alias("start"), F.col("other_end").alias("end")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def islands(df: DataFrame, keys: Sequence[str], order: str, gap: float) -> DataFrame:
    """df with island: a number that grows by one wherever `order` (numeric) is more than gap past the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return df.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn("island", F.sum("__new").over(w)).drop("__new")


def carried_over(own: DataFrame, before: DataFrame, keys: Sequence[str], item: str, number: str, last: int) -> DataFrame:
    """own (keys, item, number) with carried false, and the items of before that own lacks under a key that own has, numbered from last on."""
    new = before.join(own.select(*keys).distinct(), [*keys], "left_semi").join(own.select(*keys, item), [*keys, item], "left_anti")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(number)) + last
    return own.withColumn("carried", F.lit(False)).unionByName(new.select(*keys, item, place.cast("long").alias(number), F.lit(True).alias("carried")))


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, x_step: float, y_step: float) -> DataFrame:
    """Rows of points joined to the rows of boxes (x0, x1, y0, y1, both ends inside) that hold them. Boxes are listed under each grid cell they touch, so
    only points and boxes of one cell meet."""
    cells = lambda a, b, step: F.explode(F.sequence(F.floor(F.col(a) / step).cast("long"), F.floor(F.col(b) / step).cast("long")))
    laid = boxes.withColumn("__i", cells("x0", "x1", x_step)).withColumn("__j", cells("y0", "y1", y_step))
    placed = points.withColumns({"__i": F.floor(F.col(x) / x_step).cast("long"), "__j": F.floor(F.col(y) / y_step).cast("long")})
    inside = F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    return placed.join(laid, ["__i", "__j"]).where(inside).drop("__i", "__j")


def counts_in_boxes(points: DataFrame, boxes: DataFrame, item: str, x: str, y: str, x_step: float, y_step: float, height: float) -> DataFrame:
    """(x0, x1, y0, y1, n, items) of the distinct boxes that hold points (item, x, y; a written table): how many, and of how many items. Points and boxes are not paired:

    The points of each x are counted by running sums over y, up to a box's two borders, within grid cells of `y_step`; so work follows the points, and the
    boxes times the distinct x that they span. Then items are the points without those that follow another of their item in a box. Only points with
    another of their item next to them by y, no further than `height`, the most that a box has, can be so; these are paired."""
    sides = ["x0", "x1", "y0", "y1"]
    laid = written(boxes.select(*[F.col(c).cast("double") for c in sides]).where("x0 <= x1 AND y0 <= y1").distinct())
    own = points.where(F.col(item).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(item).alias("item"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    spans = points_in_boxes(own.select("x", F.lit(0.0).alias("__y")).distinct(), laid.select("x0", "x1", F.lit(0.0).alias("__y0"), F.lit(0.0).alias("__y1")).distinct().toDF("x0", "x1", "y0", "y1"), "x", "__y", x_step, 1)
    met = laid.join(spans.select("x", "x0", "x1"), ["x0", "x1"])
    border = lambda c, kind: met.select("x", F.col(c).alias("y"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("n")).distinct()
    held = own.groupBy("x", "y").agg(F.count("*").alias("n")).select("x", "y", F.lit(0).alias("kind"), "n")
    steps = held.unionByName(border("y0", -1)).unionByName(border("y1", 1)).withColumn("cell", F.floor(F.col("y") / y_step))
    steps = written(steps)
    cells = steps.groupBy("x", "cell").agg(F.sum("n").alias("c"))
    before = cells.select("x", "cell", (F.sum("c").over(Window.partitionBy("x").orderBy("cell")) - F.col("c")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("x", "cell").orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, 0))
    upto = written(steps.withColumn("within", within).where("kind <> 0").join(before, ["x", "cell"]).select("x", "y", "kind", (F.col("within") + F.col("before")).alias("upto")))
    low, high = (upto.where(F.col("kind") == kind).select("x", F.col("y").alias(c), F.col("upto").alias(name)) for kind, c, name in ((-1, "y0", "low"), (1, "y1", "high")))
    counts = met.join(low, ["x", "y0"]).join(high, ["x", "y1"]).groupBy(*sides).agg(F.sum(F.col("high") - F.col("low")).alias("n"))
    order = Window.partitionBy("item").orderBy("y")
    gaps = own.withColumns({"down": F.col("y") - F.lag("y").over(order), "up": F.lead("y").over(order) - F.col("y")})
    close = gaps.where((F.col("down") <= height * (1 + 1e-9)) | (F.col("up") <= height * (1 + 1e-9))).select("item", "x", "y")
    repeated = points_in_boxes(close, laid, "x", "y", x_step, y_step).groupBy(*sides, "item").agg(F.count("*").alias("n")).where("n > 1")
    more = repeated.groupBy(*sides).agg(F.sum(F.col("n") - 1).alias("more"))
    return counts.where("n > 0").join(more, sides, "left").select(*sides, "n", (F.col("n") - F.coalesce("more", F.lit(0))).alias("items"))
