"""Reconciled intervals of a stream of settlements: closed once, and compensated when a settlement comes late."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.sources.intermediate import shared_root

STATE = "scope string, interval long, total long, n long, closed boolean"
LOG = "kind string, scope string, interval long, amount long, n long"


def reconciled(stream: DataFrame, scope: str, at: str, amount: str, width: int, delay: int) -> DataFrame:
    """(kind, scope, interval, amount, n, batch) of a stream that is run until its input is used up; amounts are whole numbers, an interval is
    `width` seconds long and numbered from the epoch.

    An interval closes when the latest time seen is `delay` seconds past its end: one row `closed` with its total. What comes for a closed
    interval is never dropped and never changes that row: it is a row `correction`. When the input ends, intervals that are still open close. So
    an interval has one closed row, and that row and its corrections add up to all its settlements.

    Each micro-batch reads the state that the one before has written and writes its own, both in folders named by number, so a batch
    that is run again gives the same rows. The state is a row for each scope and interval; settlements themselves are not kept. Rows without a time have
    a null interval, which closes at the end."""
    spark = stream.sparkSession
    root = f"{shared_root(spark)}/settlements-{uuid.uuid4().hex}"
    numbers: list[int] = []

    def state_before(number: int) -> tuple[DataFrame, int | None]:
        earlier = [n for n in numbers if n < number]
        if not earlier:
            return spark.createDataFrame([], STATE), None
        mark = spark.read.schema("mark long").parquet(f"{root}/mark/{earlier[-1]:06d}").first()
        return spark.read.schema(STATE).parquet(f"{root}/state/{earlier[-1]:06d}"), mark["mark"]

    def put(batch: DataFrame, number: int) -> None:
        state, mark = state_before(number)
        seconds = F.unix_seconds(F.col(at))
        deltas = batch.groupBy(F.col(scope).cast("string").alias("d_scope"), F.floor(seconds / width).alias("d_interval")).agg(F.sum(amount).cast("long").alias("d_total"), F.count("*").alias("d_n"), F.max(seconds).alias("d_last"))
        deltas.write.mode("overwrite").parquet(path := f"{root}/deltas/{number:06d}")
        deltas = spark.read.parquet(path)
        last = deltas.agg(F.max("d_last")).first()[0]
        mark = max((x for x in (mark, last) if x is not None), default=None)
        same = F.col("scope").eqNullSafe(F.col("d_scope")) & F.col("interval").eqNullSafe(F.col("d_interval"))
        met = state.withColumn("there", F.lit(True)).join(deltas.withColumn("new", F.lit(True)), same, "full_outer")
        known, new = F.coalesce("there", F.lit(False)), F.coalesce("new", F.lit(False))
        was_closed = F.coalesce("closed", F.lit(False))
        closes = F.coalesce((F.coalesce("interval", "d_interval") + 1) * width + delay <= F.lit(mark).cast("long"), F.lit(False))
        total = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
        laid = met.select(
            F.when(known, F.col("scope")).otherwise(F.col("d_scope")).alias("scope"),
            F.when(known, F.col("interval")).otherwise(F.col("d_interval")).alias("interval"),
            total("total", "d_total").alias("total"),
            total("n", "d_n").alias("n"),
            (was_closed | closes).alias("closed"),
            F.when(was_closed & new, "correction").when(~was_closed & closes, "closed").alias("kind"),
            F.when(was_closed, F.coalesce("d_total", F.lit(0))).otherwise(total("total", "d_total")).cast("long").alias("amount"),
            F.when(was_closed, F.coalesce("d_n", F.lit(0))).otherwise(total("n", "d_n")).cast("long").alias("m"),
        )
        laid.write.mode("overwrite").parquet(path := f"{root}/laid/{number:06d}")
        laid = spark.read.parquet(path)
        laid.where("kind is not null").select("kind", "scope", "interval", "amount", F.col("m").alias("n")).write.mode("overwrite").parquet(f"{root}/log/{number:06d}")
        spark.createDataFrame([(mark,)], "mark long").write.mode("overwrite").parquet(f"{root}/mark/{number:06d}")
        laid.select("scope", "interval", "total", "n", "closed").write.mode("overwrite").parquet(f"{root}/state/{number:06d}")
        if number not in numbers:
            numbers.append(number)

    run = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], f"{LOG}, batch int")
    out = None
    for n in numbers:
        rows = spark.read.schema(LOG).parquet(f"{root}/log/{n:06d}").withColumn("batch", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    rest = spark.read.schema(STATE).parquet(f"{root}/state/{numbers[-1]:06d}").where("NOT closed")
    return out.unionByName(rest.select(F.lit("closed").alias("kind"), "scope", "interval", F.col("total").alias("amount"), "n", F.lit(numbers[-1] + 1).alias("batch")))
