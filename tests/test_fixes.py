"""Exact p-values of large tables and scrubbed output behind escapes."""

import json
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.functions.statistics import mcnemar
from docquarry.operators.ranking import numbered
from docquarry.sources import sinks


def test_mcnemar_of_many_pairs(spark):
    cases = [(600, 600), (600, 700), (0, 0), (0, 1), (3, 9), (9, 10), (700, 600), (0, 400), (5000, 5300), (40, 2000), (10, 0), (12, 1)]
    rows = spark.createDataFrame(cases, "b long, c long").select("b", "c", mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    for r in rows:
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        exact = min(1.0, float(2 * Fraction(sum(comb(n, i) for i in range(k + 1)), 2**n)))
        assert r["p"] == pytest.approx(exact, rel=1e-8, abs=1e-300)
    assert {(r["b"], r["c"]): r["p"] for r in rows}[600, 600] == 1.0


def test_escapes_are_read_by_the_grammar():
    assert sinks.unescaped(r"akim \n \\n \" \q \u12 😀 x\\") == 'akim \n \\n " \\q \\u12 😀 x\\'
    assert sinks.unescaped("plain") == "plain" and sinks.unescaped("\\") == "\\" and sinks.unescaped(r"\ud83d\n") == "\ud83d\n"
    for text in ("ki\nm", 'say "kim"', "日本\t😀", "\\", "a\\\\b", "\u0001"):
        assert sinks.unescaped(json.dumps(text)[1:-1]) == text


@pytest.mark.parametrize("name", ["kim", "日本", "a\nb", 'q"t'])
def test_names_behind_many_levels_are_found(name):
    coded = "".join(f"\\u{ord(c):04x}" for c in name)
    nested = name
    for _ in range(4):
        nested = json.dumps({"k": ["x", nested]})
    by_name = json.dumps({"t": json.dumps({name: 1})})
    in_log = json.dumps({"t": "log: " + json.dumps({"who": name}) + " end"})
    for line in (json.dumps({"t": coded}), json.dumps({"t": "see " + coded.replace("\\", "\\\\") + "!"}), nested, by_name, in_log):
        assert name in sinks.readings(line)
    assert name not in sinks.readings(json.dumps({"t": "nothing", "n": [1, None, True, 2.5]}))


def test_numbers_within_groups_by_blocks(spark):
    rows = [("a", k * k % 1009 - 300, k) for k in range(500)] + [(None, 5, 1), (None, 2, 2), ("b", 2**40, 3), ("b", None, 4)]
    t = spark.createDataFrame(rows, "g string, v long, k int").dropDuplicates(["g", "v"]).cache()
    want = {(r["g"], r["v"]): r["n"] for r in t.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v"))).collect()}
    for width in (1, 7, 1 << 20):
        assert {(r["g"], r["v"]): r["n"] for r in numbered(t, ["g"], "v", "n", width).collect()} == want
    assert numbered(t.where("false"), ["g"], "v", "n").count() == 0
    equal = numbered(spark.createDataFrame([("a", 1), ("a", 1), ("a", 0)], "g string, v long"), ["g"], "v", "n")
    assert sorted((r["v"], r["n"]) for r in equal.collect()) == [(0, 1), (1, 2), (1, 3)]
