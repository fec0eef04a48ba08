"""Event-time streams: windows, sessions, deduplication and keyed state, each run over what is there and returned as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources.intermediate import shared_root


def event_stream(spark: SparkSession, path: str, per_trigger: int = 4) -> DataFrame:
    """A stream of event files with ts as a timestamp."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, one file will do
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def whole_lateness(spark: SparkSession, path: str) -> str:
    """A watermark's delay under which no event of a table is late, in whatever order its files are read."""
    ts = F.col("ts").cast("timestamp")
    span = spark.read.parquet(path).agg(F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts))).first()[0]
    return f"{(span or 0) + 1} seconds"


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream until its input is used up. Each micro-batch is a folder of its own in the shared folder, replaced if it is run again;
    complete mode returns the last one, append and update mode all of them."""
    spark = stream.sparkSession
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batches/{number:06d}")
        done.append(number)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    kept = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{root}/batches/{n:06d}" for n in kept]) if kept else spark.createDataFrame([], stream.schema)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(window_start in seconds, event_type, n, total) of tumbling or sliding windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.unix_seconds("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """(user_id, session_start, session_end in seconds, n): runs of a user's events without a pause of gap."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.unix_seconds("w.start").alias("session_start"), F.unix_seconds("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
