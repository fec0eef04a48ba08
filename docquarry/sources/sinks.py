"""Writers: lines, versioned snapshots with digests, and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docquarry.operators.governance import table_digest


class ResidualIdentifier(ValueError):
    """A text still holds an identifier that it must not show."""


def unescaped(text: str) -> str:
    """Each escape of JSON's grammar read by the JSON parser, two halves of a character together; what is no escape stays as it is."""
    first, *rest = text.split("\\")
    out, k = [first], 0
    while k < len(rest):
        piece = rest[k]
        k += 1
        if not piece:  # an escaped backslash, and what follows it; a last one alone stays
            out.append("\\" + (rest[k] if k < len(rest) else ""))
            k += 1
            continue
        size = 5 if piece[0] == "u" else 1
        shown = "\\" + piece[:size]
        if len(piece) == size == 5 and k < len(rest) and rest[k][:2] in ("uD", "ud") and piece[1:3].lower() in ("d8", "d9", "da", "db"):
            shown, piece, k = f"{shown}\\{rest[k][:5]}", piece + rest[k], k + 1
            size = 10
        try:
            out += (json.loads(f'"{shown}"'), piece[size:])
        except ValueError:
            out.append("\\" + piece if size < 10 else f"\\{piece[:5]}\\{piece[5:]}")
    return "".join(out)


def strings_of(value: object) -> Iterator[str]:
    """Names and texts of a JSON value."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from strings_of(v)
    elif isinstance(value, list):
        for v in value:
            yield from strings_of(v)


def readings(line: str) -> str:
    """A JSON line and all that its texts can be read as: JSON within texts, and texts whose escapes are read, each again and again."""
    seen: dict[str, None] = {}
    todo = [line]
    while todo:
        text = todo.pop()
        if text in seen:
            continue
        seen[text] = None
        try:
            todo += strings_of(json.loads(text) if text.lstrip()[:1] in ("{", "[", '"') else None)
        except (ValueError, RecursionError):
            pass
        if "\\" in text:
            todo.append(unescaped(text))
    return "\0".join(seen).encode("utf-8", "replace").decode()


@F.pandas_udf(StringType())
def all_readings(line: pd.Series) -> pd.Series:
    return line.map(readings)


def write_json_lines(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """A folder of JSON lines; the job commits all files or none."""
    df.write.mode("errorifexists").option("compression", compression).json(path)


def write_scrubbed(df: DataFrame, path: str, identifiers: DataFrame, text: str, identifier: str = "identifier", gram: int = 4) -> None:
    """Writes JSON lines unless a line, its names and all its columns, or the text column holds an identifier that is not empty. Lines
    and identifiers meet by the identifier's first characters, all of a shorter one."""
    own = identifiers.select(F.col(identifier).cast("string").alias("__id")).where(F.length("__id") > 0).distinct()
    keyed = own.withColumn("__k", F.substring("__id", 1, gram))
    lengths = sorted(r[0] for r in keyed.select(F.length("__k")).distinct().collect())  # gram values at most
    lines = df.select(F.concat_ws("\0", all_readings(F.to_json(F.struct(*df.columns))), F.col(text).cast("string")).alias("__line"))
    for n in lengths:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("__line") - n + 1)), lambda i: F.substr(F.col("__line"), i, F.lit(n)))  # noqa: B023
        met = lines.select("__line", F.explode(F.array_distinct(grams)).alias("__k")).join(keyed.where(F.length("__k") == n), "__k")
        if not met.where(F.col("__line").contains(F.col("__id"))).isEmpty():
            raise ResidualIdentifier("a text still holds an identifier")
    write_json_lines(df, path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """An immutable version of a table beside a row with its digest; the pointer row is written last."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    table_digest(stored).withColumn("version", F.lit(version)).coalesce(1).write.mode("append").json(f"{root}/_versions")
    return path


def verified_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    """A version of a table; an error if its digest is not the recorded one."""
    stored = spark.read.parquet(f"{root}/version={version}")
    said = spark.read.json(f"{root}/_versions").where(F.col("version") == version).select("n_rows", "digest")
    if said.exceptAll(table_digest(stored).select("n_rows", "digest")).count() or said.isEmpty():
        raise ValueError(f"version {version} is not what was written")
    return stored


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A small report table; rows is a bounded result, such as a top-k."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]).replace("|", "\\|") for c in columns) + " |" for r in rows.select(*columns).collect()]
    return "\n".join(lines)
