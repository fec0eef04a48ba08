"""Anchors and quotes against plain searches."""

import random

from pyspark.sql import functions as F

from docquarry.operators.placement import heads_once, placed, quote_places

rng = random.Random(4)


def text(n, letters="abc d\n"):
    return "".join(rng.choice(letters) for _ in range(n))


def occurrences(t, x):
    return [k for k in range(len(t) - len(x) + 1) if t[k : k + len(x)] == x]


def test_heads_equal_a_search():
    for _ in range(60):
        t = text(300)
        fragments = [t[k : k + rng.randint(0, 60)] for k in (rng.randrange(300) for _ in range(8))] + [text(30), "", t[:5] * 3]
        want = []
        for f in fragments:
            want.append(next(((n, at[0]) for n in (40, 20, 10) if len(f) >= n and len(at := occurrences(t, f[:n])) == 1), None))
        assert heads_once(t, fragments) == want


def test_kept_places_rise(spark):
    t = text(600, "abcdefghijklmnop")
    fragments = [t[0:50], t[300:350], t[100:150], t[400:450], "zz", t[500:550], t[200:250]]
    rows = spark.createDataFrame([(1, t, fragments), (2, None, ["x" * 50]), (3, t, None)], "k int, text string, f array<string>").withColumn("at", F.lit("x"))
    got = {r["k"]: r["placed"] for r in placed(rows, "text", "f").collect()}
    assert [(x["at"], x["place"]) for x in got[1]] == [(0, 0), (1, 300), (2, 100), (3, 400), (5, 500), (6, 200)]
    kept = [x["place"] for x in got[1] if x["kept"]]
    assert kept == sorted(kept) and len(kept) == 4 and got[2] == [] == got[3]


def test_quotes(spark):
    t = "one two\nthree  four\nfive one two six\n日本 語 end"
    quotes = ["three four", "two three", "one two", "fourfive", "日 本語", "seven", "  \n", None, "two six 日本", "ONE"]
    rows = spark.createDataFrame([(k, t, q) for k, q in enumerate(quotes)] + [(99, None, "x"), (98, "", "")], "k int, text string, q string").withColumn("start", F.lit("x")).drop("start")
    got = {r["k"]: r for r in quote_places(rows, "text", "q", 10).collect()}
    want = {0: "row", 1: "across", 2: "repeated", 3: "across", 4: "row", 5: "missing", 6: "empty", 7: "empty", 8: "across", 9: "missing", 99: "missing", 98: "empty"}
    assert {k: r["verdict"] for k, r in got.items()} == want
    squash = lambda x: "".join(x.split())
    for k, q in enumerate(quotes):
        r = got[k]
        if r["start"] is not None:
            assert squash(t[r["start"] : r["end"]]) == squash(q) and not t[r["start"]].isspace()
            assert (r["first_row"], r["last_row"]) == (t[: r["start"]].count("\n"), t[: r["end"]].count("\n"))
            assert (r["first_page"], r["last_page"]) == (r["start"] // 10, (r["end"] - 1) // 10)
