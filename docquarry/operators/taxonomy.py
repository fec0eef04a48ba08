"""A taxonomy of notes by its decisions, and headings over lines by a stack.

Decisions send types on: accept, rename and merge send all notes of a type to one type, split sends each note to the part named for it, and reject
leaves its notes without a type. A type is decided once; a rename that keeps its id is no step. The fold follows types, not notes:
steps of whole types are doubled until they end, then notes take one join, and only splits need another turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.sources.intermediate import written


def ends_of(steps: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(ref, into): where each step (ref, into; into is null for a rejected type) ends, by doubling."""
    now = written(steps.select("ref", "into"))
    for _ in range(most_rounds):
        ahead = now.select(F.col("ref").alias("into"), F.col("into").alias("next"), F.lit(True).alias("goes"))
        both = written(now.join(ahead, "into", "left").select("ref", F.when(F.col("goes"), F.col("next")).otherwise(F.col("into")).alias("into"), F.coalesce("goes", F.lit(False)).alias("moved")))
        now = both.select("ref", "into")
        if both.where("moved").isEmpty():
            return now
    raise RuntimeError("a type leads back to itself")


def current_types(notes: DataFrame, steps: DataFrame, parts: DataFrame, most_rounds: int = 40) -> DataFrame:
    """notes (note, type) with the type that holds them after all decisions, or null: steps (ref, into) of whole types and parts (ref, note, into) of
    split ones. A note of a split type that no part names has none."""
    ends = ends_of(steps)
    divided = parts.select("ref").distinct().withColumn("split", F.lit(True))
    named = parts.select("ref", "note", F.col("into").alias("part"))
    now = written(notes.select("note", "type"))
    for _ in range(most_rounds):
        sent = now.join(ends.withColumn("known", F.lit(True)), now["type"] == ends["ref"], "left")
        sent = sent.select("note", F.when(F.col("known"), F.col("into")).otherwise(F.col("type")).alias("type"))
        met = sent.join(divided, F.col("type") == F.col("ref"), "left").drop("ref")
        met = met.join(named, (met["type"] == named["ref"]) & (met["note"] == named["note"]), "left").select(met["note"], met["type"], "split", "part")
        laid = written(met.select("note", F.when(F.col("split"), F.col("part")).otherwise(F.col("type")).alias("type"), F.coalesce("split", F.lit(False)).alias("moved")))
        now = laid.select("note", "type")
        if laid.where("moved").isEmpty():
            return now
    raise RuntimeError("a type leads back to itself")


def since_when(accepted: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(type, since): the earliest acceptance (type, at) among a type and all that were sent into it by links (ref, into)."""
    first = lambda df: df.groupBy("type").agg(F.min("at").alias("at"))
    now = written(first(accepted.select("type", "at")))
    reach = written(links.where("into is not null").select("ref", "into").distinct())
    for _ in range(most_rounds):
        sent = reach.join(now.withColumnRenamed("type", "ref"), "ref").select(F.col("into").alias("type"), "at")
        new = written(first(now.unionByName(sent)))
        if new.exceptAll(now).isEmpty():
            return now.withColumnRenamed("at", "since")
        now = new
        ahead = reach.select(F.col("ref").alias("into"), F.col("into").alias("far")).join(reach, "into").select("ref", F.col("far").alias("into"))
        reach = written(reach.unionByName(ahead).distinct()) if not ahead.isEmpty() else reach
    raise RuntimeError("a type leads back to itself")


def heading_paths(docs: DataFrame, levels: str) -> DataFrame:
    """(doc_id, at, path) for each line of docs (doc_id, levels: a heading's level, or null, for each line): the places of the headings
    over it, itself included. A heading ends all headings of its own level and below, at any depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stack: list[tuple[int, int]] = []
                paths = []
                for at, level in enumerate(own or ()):
                    if level is not None:
                        while stack and stack[-1][0] >= level:
                            stack.pop()
                        stack.append((level, at))
                    paths.append([k for _, k in stack])
                yield pa.record_batch([pa.array([doc_id] * len(paths), batch.schema.field(0).type), pa.array(range(len(paths)), pa.int32()), pa.array(paths, pa.list_(pa.int32()))], ["doc_id", "at", "path"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col(levels).cast("array<int>").alias("levels")).mapInArrow(run, f"doc_id {kind}, at int, path array<int>")
