"""Event logs folded into state: reservations, settlements, adjustments, notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(attempts: DataFrame, keys: Sequence[str], state: str, amount: str, settled: Sequence[str], open_: Sequence[str]) -> DataFrame:
    """(keys, spent, pending, n): one pass of conditional sums."""
    when = lambda states: F.coalesce(F.sum(F.when(F.col(state).isin(*states), F.col(amount))), F.lit(0)).alias
    return attempts.groupBy(*keys).agg(when(settled)("spent"), when(open_)("pending"), F.count("*").alias("n"))


def warnings(spent: Column, pending: Column, cap: Column, levels: Sequence[int] = (50, 75, 90)) -> Column:
    """The highest level in percent of the cap that spent and pending reach together; null if none."""
    found = F.lit(None).cast("int")
    for level in sorted(levels):
        found = F.when((spent + pending) * 100 >= cap * level, F.lit(level)).otherwise(found)
    return found


def shares(total: Column, parts: dict[str, int], rest: str) -> Column:
    """struct of whole shares in proportion; what rounding leaves goes to `rest`."""
    whole = sum(parts.values())
    floors = {k: F.floor(total * n / whole).cast("long") for k, n in parts.items()}
    left = total - sum(floors.values(), F.lit(0).cast("long"))
    return F.struct(*[(v + left if k == rest else v).cast("long").alias(k) for k, v in floors.items()])


def latest_state(events: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(keys, first_at, last_at, value, n): the value of the last event; the first event's time is kept. No sort of groups is needed."""
    last = F.max(F.struct(*order, value))
    return events.groupBy(*keys).agg(F.min(order[0]).alias("first_at"), last.alias("x"), F.count("*").alias("n")).select(*keys, "first_at", F.col(f"x.{order[0]}").alias("last_at"), F.col(f"x.{value}").alias(value), "n")


def once(events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first event of each key: repeated corrections count once."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, "x.*").select(*events.columns)


def replay(events: DataFrame, keys: Sequence[str], order: Sequence[str], event: str, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """(keys, state, moved, refused): the events of a key in order, each moving the state if there is a move for it, else refused. Events are
    dealt by ranges of (keys, order); a range's events of a key fold into a map from every state at its begin to (state, moved, refused)
    at its end, and a key's maps are composed. So a key with many events is spread over ranges, and its last fold is over ranges only."""
    table = F.create_map(*[F.lit(x) for (state, name), to in moves.items() for x in (f"{state}|{name}", to)])
    states = F.array(*[F.lit(s) for s in sorted({start, *moves.values(), *(state for state, _ in moves)})])
    at = lambda state: F.struct(state.alias("state"), F.lit(0).cast("long").alias("moved"), F.lit(0).cast("long").alias("refused"))

    def step(acc: Column, x: Column) -> Column:
        to = F.try_element_at(table, F.concat_ws("|", acc["state"], x[event]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["moved"] + F.when(to.isNotNull(), 1).otherwise(0)).alias("moved"), (acc["refused"] + F.when(to.isNull(), 1).otherwise(0)).alias("refused"))

    def compose(acc: Column, x: Column) -> Column:
        after = F.element_at(x["ends"], acc["state"])
        return F.struct(after["state"].alias("state"), (acc["moved"] + after["moved"]).alias("moved"), (acc["refused"] + after["refused"]).alias("refused"))

    ranged = events.select(*keys, *order, event).repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    blocks = ranged.groupBy(*keys, "__range").agg(F.array_sort(F.collect_list(F.struct(*order, event))).alias("e"))
    folded = blocks.select(*keys, "__range", F.map_from_arrays(states, F.transform(states, lambda s: F.aggregate("e", at(s), step))).alias("ends"))
    maps = folded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__range", "ends")), lambda a, b: a["__range"] - b["__range"]).alias("m"))
    return maps.select(*keys, F.aggregate("m", at(F.lit(start)), compose).alias("s")).select(*keys, "s.*")
