"""Queries whose work grew with the square of their input, or that differed from SQL on larger tables."""

import hashlib
import random

from pyspark.sql import functions as F

from docquarry import plans
from docquarry.functions.numbers import korean_won
from docquarry.operators.intervals import counts_in_boxes


def test_input_hashes_write_amounts_as_sql_does(spark, tmp_path):
    import duckdb

    rows = [(1, -0.0, "A"), (2, -0.001, "B"), (3, 0.125, "C"), (4, 1.005, "D"), (5, None, "E"), (6, 2.5, None), (7, 2.675, 'q"e'), (8, 1e15, "F"), (9, -999.995, "G")]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = plans.QUERIES["governance_input_hashes"](spark, f"{tmp_path}").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(plans.SQL["governance_input_hashes"]).fetchall())
    assert {r["c_custkey"]: r["input_sha256"] for r in got}[1] == hashlib.sha256(b'{"c_acctbal":-0.00,"c_custkey":1,"c_mktsegment":"A"}').hexdigest()


def test_counts_in_boxes_equal_all_pairs(spark):
    rng = random.Random(4)
    points = [(rng.choice([None, *range(40)]), float(rng.randint(1, 12)), rng.choice([round(rng.uniform(-30, 60), 2), float(rng.randint(0, 20))])) for _ in range(900)] + [(1, None, 2.0), (1, 2.0, None)]
    boxes = [(float(a), float(a + 2), float(b), float(b + 8)) for a in range(-1, 13, 2) for b in (-31, -4, 0, 3, 8, 8, 59)] + [(2.0, 2.0, 5.0, 5.0), (None, 1.0, 1.0, 9.0)]
    df = spark.createDataFrame(points, "item long, x double, y double").repartition(3)
    got = counts_in_boxes(df, spark.createDataFrame(boxes, "x0 double, x1 double, y0 double, y1 double"), "item", "x", "y", 4, 5, 8)
    want = {}
    for b in boxes:
        inside = [p[0] for p in points if None not in (*p, *b) and b[0] <= p[1] <= b[1] and b[2] <= p[2] <= b[3]]
        if inside:
            want[b] = (len(inside), len(set(inside)))
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()} == want and got.count() == len(want)


def test_amounts_are_read_once(spark):
    """Before, each unit's rest was written out in full in the next one's expression."""
    df = spark.range(1).select(korean_won(F.col("id").cast("string")).alias("x"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_sets_in_tiles_equal_all_pairs(spark):
    """Before, sets met by each rare member that they share, and the pairs of sets drawn from few members followed the square of the table."""
    from docquarry.operators.similarity import set_classes, similar_classes

    rng = random.Random(9)
    names = [f"m{k}" for k in range(70)]
    sets = [sorted(rng.sample(names, rng.randint(1, 60))) for _ in range(150)]
    for k in range(0, 150, 2):
        sets[k] = sorted(set(sets[rng.randrange(150)]) ^ set(rng.sample(names, rng.randint(0, 4)))) or ["m0"]
    classes = set_classes(spark.createDataFrame([(s,) for s in sets], "own array<string>"), "own").groupBy("class").agg(F.first("own").alias("own"))
    name = {r["class"]: frozenset(r["own"]) for r in classes.collect()}
    found = similar_classes(classes, "own", 0.85, tile=7)
    got = [(name[r["a"]], name[r["b"]]) for r in found.collect()]
    distinct = list(set(name.values()))
    want = {frozenset((a, b)) for i, a in enumerate(distinct) for b in distinct[:i] if len(a & b) >= 0.85 * len(a | b)}
    assert {frozenset(p) for p in got} == want and len(got) == len(want) and want
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_pages_are_made_once(spark, monkeypatch):
    """Before, what makes the shown reading ran three times."""
    from docquarry.operators import alignment

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(text):
        seen.add(1)
        return text

    units = spark.createDataFrame([(k, 0, f"text {k} of a line") for k in range(20)], "doc long, unit int, text string").coalesce(1)
    pages = units.select("doc", F.col("unit").alias("page"), watched("text").alias("text"))
    assert {r["verdict"] for r in alignment.fidelity(units, pages).collect()} == {"faithful"} and seen.value == 20
