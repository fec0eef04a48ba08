"""Readers of the given tables and of manifests, lines and binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def manifest_csv(spark: SparkSession, path: str, schema: StructType, names: list[str]) -> DataFrame:
    """A UTF-8 CSV with exactly this header and quoted line ends; other headers and broken rows are errors. Columns are renamed."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', encoding="UTF-8", mode="FAILFAST", enforceSchema=False)
    return df.toDF(*names)


def manifest_problems(rows: DataFrame, filename: str, allowed: list[str], existing: DataFrame | None = None) -> DataFrame:
    """(filename, problem): unsafe names, wrong extensions, repeated names, and files that are not there."""
    name = F.col(filename)
    found = F.array_compact(
        F.array(
            F.when(name.isNull() | (F.trim(name) == ""), "empty"),
            F.when(name.rlike(r"[/\\]|^\.|\x00"), "unsafe"),
            F.when(~F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*allowed), "extension"),
        )
    )
    problems = rows.select(name.alias("filename"), F.explode(found).alias("problem"))
    repeated = rows.groupBy(name.alias("filename")).count().where("count > 1").select("filename", F.lit("repeated").alias("problem"))
    out = problems.unionByName(repeated)
    if existing is not None:
        out = out.unionByName(rows.select(name.alias("filename")).join(existing, "filename", "left_anti").select("filename", F.lit("missing").alias("problem")))
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def partition_of(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """One partition of a table laid out by column; the others are not listed for reading."""
    return spark.read.parquet(path).where(F.col(column) == value)
