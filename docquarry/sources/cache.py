"""A content-addressed store of computed rows: what is known is reused, only the rest is computed, and nothing is trusted unverified.

A store is a folder of parts and, beside it, one manifest entry for each part, written after the part: its rows and their digest. A part
without an entry is what a lost writer left; it is never read. Keys name inputs (a hash of them and of the version of what computes), so
an entry is never out of date, and publishing a key again is allowed only with the same value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.governance import row_hash, table_digest
from docquarry.sources.intermediate import written


class StoreError(ValueError):
    """A part is not what its manifest says, or a key has two values."""


@dataclass(frozen=True)
class Store:
    root: str

    def manifest(self, spark: SparkSession) -> DataFrame | None:
        """(part, n_rows, digest), or None before the first part."""
        try:
            return spark.read.schema("part string, n_rows long, digest string").json(f"{self.root}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def parts(self, spark: SparkSession) -> list[str]:
        """Names of the parts that count: one for each publication."""
        said = self.manifest(spark)
        return [] if said is None else sorted(r["part"] for r in said.select("part").distinct().collect())

    def read(self, spark: SparkSession, verify: bool = True) -> DataFrame | None:
        """All published rows; an error if a part is missing or its rows are others than those published."""
        names = self.parts(spark)
        if not names:
            return None
        try:
            stored = spark.read.parquet(*[f"{self.root}/parts/{name}" for name in names])
        except AnalysisException as e:
            raise StoreError("a part of the manifest is not there") from e
        if verify:
            said = {r["part"]: (r["n_rows"], r["digest"]) for r in self.manifest(spark).collect()}
            for name in names:
                got = table_digest(spark.read.parquet(f"{self.root}/parts/{name}")).first()
                if (got["n_rows"], got["digest"]) != said[name]:
                    raise StoreError(f"part {name} is not what was published")
        return stored

    def publish(self, rows: DataFrame, key: str) -> int:
        """Adds rows, one for each key, and returns how many were new. A key that is there already must come with the same values."""
        spark = rows.sparkSession
        fresh = written(rows)
        if not fresh.groupBy(key).count().where("count > 1").isEmpty() or not fresh.where(F.col(key).isNull()).isEmpty():
            raise StoreError("a key has two rows, or none")
        there = self.read(spark, verify=False)
        if there is not None:
            said = there.select(F.col(key).alias("__key"), row_hash(sorted(there.columns)).alias("__was"))
            met = fresh.withColumn("__now", row_hash(sorted(fresh.columns))).join(said, F.col(key) == F.col("__key"), "left")
            if sorted(there.columns) != sorted(fresh.columns) or not met.where("__was <> __now").isEmpty():
                raise StoreError("a key was published with another value")
            fresh = written(met.where("__key is null").select(*rows.columns))
        if fresh.isEmpty():
            return 0
        part = uuid.uuid4().hex
        fresh.write.mode("errorifexists").parquet(f"{self.root}/parts/{part}")
        digest = table_digest(spark.read.parquet(f"{self.root}/parts/{part}"))
        entry = digest.withColumn("part", F.lit(part)).select("part", "n_rows", "digest")
        entry.coalesce(1).write.mode("append").json(f"{self.root}/manifest")  # last: only now the part counts
        return fresh.count()


def input_key(version: str, columns: Sequence[str]) -> F.Column:
    """Names the input of a row: the version of what computes, and the values of columns."""
    return F.sha2(F.concat_ws(":", F.lit(version), row_hash(columns)), 256)


def recomputed(rows: DataFrame, inputs: Sequence[str], compute: Callable[[DataFrame], DataFrame], version: str, store: Store) -> tuple[DataFrame, dict[str, int]]:
    """(rows with input_key, the computed columns and `reused`; counts). compute gets the distinct unknown inputs (input_key and the columns of inputs) and
    returns one row for each input_key; anything else is refused and nothing is published."""
    spark = rows.sparkSession
    keyed = written(rows.withColumn("input_key", input_key(version, inputs)))
    asked = keyed.select("input_key", *inputs).dropDuplicates(["input_key"])
    there = store.read(spark)
    missing = written(asked if there is None else asked.join(there.select("input_key"), "input_key", "left_anti"))
    n = missing.count()
    if n:
        made = written(compute(missing))
        if made.count() != n or not missing.join(made, "input_key", "left_anti").isEmpty():
            raise StoreError("not one result for each input")
        store.publish(made, "input_key")
    known = store.read(spark, verify=False)
    if known is None:  # no input at all: the columns of compute, without rows
        known = compute(missing)
    out = keyed.join(known, "input_key", "left").join(missing.select("input_key", F.lit(True).alias("__new")), "input_key", "left")
    counts = {"asked": keyed.select("input_key").distinct().count(), "computed": n}
    return out.withColumn("reused", F.col("__new").isNull()).drop("__new"), counts
