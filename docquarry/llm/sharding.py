"""Operator 9: sharding by extendible hashing.

A row's place is the hash of its key, read from the first bit. A bucket is a prefix of these bits; only buckets over the byte limit
split on one more bit, so each row ends in the shortest prefix whose rows fit. Bytes are first added up in cells of some more bits
than the mean needs; the directory follows from the cells, and only rows of cells that are still too large are looked at again with
finer cells. Rows with equal keys share all bits of that hash: if they are too large together, they are split by the bits of a second
hash, of a row number that has been written down.

Defined cases: a null key hashes like the empty one; a null text has no bytes; a row that alone exceeds the limit is a shard of its
own, the only kind of shard over the limit; repeated rows are split like others; an empty table gives no rows; columns not asked for
are left out, and names of columns asked for don't clash with those of this module.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_folder, written

BITS = 60  # of a hash
SLACK = 4  # bits of a cell beyond the mean need


def hash_of(key: F.Column) -> F.Column:
    """60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(column: str, depth: int | F.Column) -> F.Column:
    return F.call_function("shiftright", F.col(column), (F.lit(BITS) - (F.lit(depth) if isinstance(depth, int) else depth)).cast("int"))


def split_round(rows: DataFrame, hashed: str, least: int, most: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Cells of `most` bits of a column: (cell, depth, shard_bytes) of those that some prefix from `least` bits on fits, and the others."""
    cells = written(rows.groupBy(prefix(hashed, most).alias("cell")).agg(F.sum("__bytes").alias("bytes"), F.count("*").alias("n")))

    def levels(first: int) -> DataFrame:
        each = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(most))))
        return each.withColumn("own", F.expr(f"shiftright(cell, {most} - depth)"))

    sums = levels(least).groupBy("depth", "own").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("rows"))
    fits = written(sums.where((F.col("shard_bytes") <= limit) | (F.col("rows") == 1)).drop("rows"))
    # no shorter prefix fits, so no cell asks for one: the shortest ones would be a few keys of all cells
    shortest = fits.agg(F.min("depth")).first()[0]
    asked = levels(most if shortest is None else shortest)
    # both sides grow with the cells, and compress so well that Spark would take them for small
    best = asked.join(fits.hint("merge"), ["depth", "own"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("best"))
    found = written(best.select("cell", "best.depth", "best.shard_bytes"))
    return found, cells.join(found, "cell", "left_anti").select("cell")


def placed_rows(docs: DataFrame, limit: int, key: str, text: str, columns: tuple[str, ...]) -> DataFrame:
    """(row: the asked columns of docs, shard, depth, n_bytes, shard_bytes). docs, a table that reads the same each time, is read for the plan and for
    the rows; only rows of cells that are too large are written in between."""
    row_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*columns).alias("row"), hash_of(F.col(key)).alias("__hash"), row_bytes.alias("__bytes"))
    total = rows.agg(F.sum("__bytes")).first()[0] or 0
    parts: list[DataFrame] = []
    for hashed in ("__hash", "__again"):
        least, most = (0 if hashed == "__hash" else 1), min(BITS, max(0, -(-total // limit)).bit_length() + SLACK)
        group = F.lit("") if hashed == "__hash" else F.lpad(F.bin("__hash"), BITS, "0")
        if hashed == "__again":  # rows of equal keys: each key's rows apart
            if rows.isEmpty():
                break
            rows = written(rows.withColumn("__again", F.shiftrightunsigned(F.xxhash64("__hash", "__again"), 64 - BITS)))
        while True:
            found, rest = split_round(rows, hashed, least, most, limit)
            placed = rows.withColumn("cell", prefix(hashed, most)).join(found, "cell")
            bits = F.lpad(F.bin(prefix(hashed, F.col("depth"))), F.col("depth"), F.lit("0"))
            depth = F.col("depth") + (BITS if hashed == "__again" else 0)
            parts.append(placed.select("row", F.concat(group, bits).alias("shard"), depth.cast("int").alias("depth"), F.col("__bytes").alias("n_bytes"), "shard_bytes"))
            if rest.isEmpty():
                return reduce(DataFrame.unionAll, parts)
            rows = rows.withColumn("cell", prefix(hashed, most)).join(rest, "cell", "left_semi").drop("cell")
            if "__again" not in rows.columns:  # a row number, and its own bits
                rows = rows.withColumn("__again", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS))
            rows = written(rows)
            if most == BITS:
                break
            least, most = most + 1, min(BITS, most + 2 * SLACK)
    return reduce(DataFrame.unionAll, parts)


def extendible_shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The asked columns of docs with shard (its prefix as bits), depth, n_bytes and shard_bytes."""
    return placed_rows(docs, limit, key, text, columns).select("row.*", "shard", "depth", "n_bytes", "shard_bytes")


def write_shards(docs: DataFrame, limit: int, path: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Writes docs as Parquet, one folder a shard (named by its bits; `root` for no bits), and returns the folder."""
    path = path or shared_folder(docs.sparkSession)
    if docs.isEmpty():  # no shard, but files with the columns
        docs.withColumn("__shard", F.lit("root")).write.parquet(path)
        return path
    placed = placed_rows(docs, limit, key, text, tuple(docs.columns))
    named = placed.select("row.*", F.when(F.col("shard") == "", "root").otherwise(F.concat(F.lit("b"), "shard")).alias("__shard"))
    named.repartition("__shard").write.partitionBy("__shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """The written rows with shard (its prefix as bits), depth, n_bytes and shard_bytes, all from the files."""
    rows = spark.read.parquet(path)
    shard = F.when(F.col("__shard") == "root", "").otherwise(F.substring("__shard", 2, 2 * BITS))
    read = rows.withColumns({"shard": shard, "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})
    own = Window.partitionBy("shard")  # as large as a shard
    return read.withColumns({"depth": F.length("shard"), "shard_bytes": F.sum("n_bytes").over(own)}).drop("__shard")


def oracle(limit: int) -> str:
    """DuckDB SQL for the digest of documents by doc_id."""
    return f"""
    WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS b, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
    l AS (SELECT doc_id, b, d::INTEGER AS depth, h >> ({BITS} - d)::INTEGER AS p FROM r, range(0, 31) t(d)),
    s AS (SELECT depth, p, sum(b)::BIGINT AS shard_bytes, count(*) AS n FROM l GROUP BY depth, p HAVING sum(b) <= {limit} OR count(*) = 1),
    o AS (SELECT l.doc_id, l.b, l.depth, l.p, s.shard_bytes, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS k FROM l JOIN s USING (depth, p))
    SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS shard, depth, b AS n_bytes, shard_bytes FROM o WHERE k = 1"""
