"""Each query against DuckDB on the smallest tables, and operators on small fixtures."""

import datetime
import math

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry import plans
from docquarry.functions.numbers import integral, korean_won, moment
from docquarry.functions.statistics import holm, kappa, mcnemar, percentiles, wilson
from docquarry.functions.text import affirmed, anchor, codes, grams, jaccard, nfc, shingles
from docquarry.operators.chunking import pack_rows, token_windows
from docquarry.operators.governance import proportional_sample, pseudonym, redact, seeded, stratified_half, table_digest
from docquarry.operators.intervals import overlap_join, sweep, union_length
from docquarry.operators.ledger import replay
from docquarry.operators.ranking import fuse_ranks, top_with_ties
from docquarry.operators.retrieval import bm25, exact_cosine
from docquarry.sources import sinks, tables

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    return c


def shown(x):
    if x is None or x is pd.NaT:
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (bool, str)):
        return str(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return pd.Timestamp(x).isoformat()
    return f"{float(x):.9g}"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    out = duck.execute(plans.SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == order
    want = sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in out.fetchall())
    assert got == want


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_korean_amounts(spark):
    cases = {
        "1억 2천만원": 120000000, "5천만": 50000000, "50,000,000원": 50000000, "3.5억": 350000000, "1억 5천": 150000000, "천만원": 10000000, "5백만원": 5000000, "2억 원": 200000000,
        "1억 5000원": 100005000, "1억 5천원": 100005000, "1억 5000": 150000000, "0억원": 0, "0조 5억": 500000000, "억": 100000000, "천억": 100000000000,
        "일억": None, "많이": None, "1억원쯤": None, "": None, "-5천만": None, None: None,
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, v long")
    assert rows.where(~korean_won(F.col("t")).eqNullSafe(F.col("v"))).collect() == []


def test_numbers_and_dates(spark):
    assert one(spark, integral(F.lit("1,200.0")).alias("x")).x == (1200, None)
    assert one(spark, integral(F.lit("1.5")).alias("x")).x == (None, "fractional")
    assert one(spark, integral(F.lit("n/a")).alias("x")).x == (None, "unparsed")
    assert one(spark, moment(F.lit("2024-07-01")).alias("x")).x == ("2024-07-01", "date")
    assert one(spark, moment(F.lit("2024-05-01 10:00:00")).alias("x")).x == ("2024-05-01 10:00:00", "timestamp")
    assert one(spark, moment(F.lit("soon")).alias("x")).x == (None, None)


def test_wilson(spark):
    for k, n, want in ((0, 0, None), (0, 1, (0, 0.7935)), (1, 1, (0.2065, 1)), (3, 10, (0.1078, 0.6032)), (45, 50, (0.7864, 0.9565)), (7, 7, (0.6457, 1))):
        assert one(spark, wilson(F.lit(k), F.lit(n)).alias("x")).x == want


def test_mcnemar_holm_and_kappa(spark):
    assert one(spark, mcnemar(F.lit(0), F.lit(6)).alias("x")).x == 2 / 64
    df = spark.createDataFrame([("f", f"h{k}", 2 / 64 if k == 0 else 1.0) for k in range(11)], "f string, name string, p double")
    adjusted = {r["name"]: round(r["p_holm"], 4) for r in holm(df, ["f"], "p", "name").collect()}
    assert adjusted["h0"] == 0.3438 and adjusted["h5"] == 1
    assert one(spark, kappa(F.lit(5), F.lit(0), F.lit(0), F.lit(5)).alias("x")).x == 1
    assert one(spark, kappa(F.lit(5), F.lit(0), F.lit(0), F.lit(0)).alias("x")).x is None


def test_rank_fusion(spark):
    lists = spark.createDataFrame([("q", "x", i, k + 1) for k, i in enumerate("abc")] + [("q", "y", i, k + 1) for k, i in enumerate("cdaa")], "q string, c string, i string, r int")
    got = [(r["i"], r["score"]) for r in fuse_ranks(lists, "q", "i", "c", "r").orderBy("fused_rank").collect()]
    assert [i for i, _ in got] == ["a", "c", "b", "d"] and math.isclose(got[0][1], 1 / 61 + 1 / 63)


def test_exact_cosine_keeps_the_least_keys_of_equal_scores(spark):
    rows = [(k, 0, [1.0, 2.0 + 1e-9 * (k % 7)]) for k in range(1500, 0, -1)] + [(0, 0, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "id long, g int, e array<double>").coalesce(1)
    found = exact_cosine(table, table.where("id in (0, 700)"), "id", "e", "g", 3).collect()
    assert sorted((r["query"], r["rank"], r["id"]) for r in found) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (700, 1, 1), (700, 2, 2), (700, 3, 3)]


def test_ties_are_kept(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([3, 1, 1, 2, None])], "k int, v int")
    assert {r["k"] for r in top_with_ties(df, "v", 1).collect()} == {1, 2}
    assert {r["k"] for r in top_with_ties(df, "v", 1, descending=True).collect()} == {0}
    assert top_with_ties(df.limit(0), "v", 3).count() == 0


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["b", "c", "c"])], "d long, w array<string>")
    asked = spark.createDataFrame([("q", ["a", "c"]), ("none", ["z"])], "q string, w array<string>")
    got = {(r["q"], r["d"]): r["score"] for r in bm25(docs, asked, "d", "q", "w", 5).collect()}
    idf = math.log(2.5 / 1.5)
    assert got == {("q", 1): round(idf * 2.5 / (1 + 1.5), 6), ("q", 3): round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 1.5)), 6)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 40)), min_size=1, max_size=12))
def test_interval_operators(spark, spans):
    rows = [("k", n, a, a + w) for n, (a, w) in enumerate(spans)]
    df = spark.createDataFrame(rows, "k string, id long, start long, end long")
    other = df.selectExpr("k", "id AS other", "start AS other_start", "end AS other_end")
    got = sorted((r["id"], r["other"]) for r in overlap_join(df, other, ["k"], 7).collect())
    assert got == sorted((x[1], y[1]) for x in rows for y in rows if x[2] < y[3] and y[2] < x[3])
    points = {p for _, _, a, b in rows for p in range(a, b)}
    union = union_length(df.select("k", "start", "end"), ["k"]).first()
    assert (union["covered"], union["repeated"]) == (len(points), sum(b - a for _, _, a, b in rows) - len(points))
    segments = sweep(df, ["k"], "id").collect()
    assert sum((s["end"] - s["start"]) * len(s["items"]) for s in segments) == sum(b - a for _, _, a, b in rows)


def test_text_functions(spark):
    row = one(spark, codes(F.lit("SFR-001 xSFR-2 SFR-0010 SFR-00100 ER-1.")).alias("c"), shingles(F.split(F.lit("a b c"), " "), 2).alias("s"), grams(F.lit("abab"), 2).alias("g"))
    assert (row.c, row.s, row.g) == (["SFR-001", "SFR-0010", "ER-1"], ["a b", "b c"], ["ab", "ba"])
    assert one(spark, jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("x")).x == 0.5
    df = spark.createDataFrame([("é", "a  b c a b", "b c"), (None, "a b a b", "a b")], "n string, t string, q string")
    assert [tuple(r) for r in df.select(nfc("n"), anchor("t", "q")).collect()] == [("é", [3, 6]), (None, None)]
    assert one(spark, redact(F.lit("me@x.org at 10.0.0.1, https://a.b/c")).alias("x")).x == "[email] at [ipv4], [url]"


def test_pseudonyms_are_hmac(spark):
    import hashlib
    import hmac

    assert one(spark, pseudonym("secret", F.lit("me")).alias("x")).x == hmac.new(b"secret", b"me", hashlib.sha256).hexdigest()[:12]


def test_windows_and_row_packing(spark):
    df = spark.createDataFrame([(1, [*"abcdefg"]), (2, ["a"])], "d long, w array<string>")
    got = [(r["d"], "".join(r["window"])) for r in token_windows(df, "w", 4, 1).orderBy("d", "k").collect()]
    assert got == [(1, "abcd"), (1, "defg"), (2, "a")]
    rows = spark.createDataFrame([("t", k, c) for k, c in enumerate([300, 300, 300, 900, 100])], "t string, o long, c long")
    assert [r["chunk"] for r in pack_rows(rows, ["t"], "o", "c", 700, 800).orderBy("o").collect()] == [0, 0, 1, 2, 3]
    rows = spark.createDataFrame([("t", 0, 50), ("t", 1, 5)], "t string, o long, c long")
    assert [r["chunk"] for r in pack_rows(rows, ["t"], "o", "c", 60, 48).orderBy("o").collect()] == [0, 1]  # a row over the limit is alone


def test_proportional_sample(spark):
    df = spark.createDataFrame([("big", k) for k in range(30)] + [("small", 100 + k) for k in range(3)], "g string, k long")
    picked = proportional_sample(df, "g", "k", 8, 1).collect()
    assert sum(r["g"] == "big" for r in picked) == 7 and {r["g"] for r in picked[:2]} == {"big", "small"}


def test_versions_and_digests(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.when(F.col("id") > 3, F.col("id").cast("string")))
    assert table_digest(df.orderBy(F.desc("id"))).first() == table_digest(df.repartition(7)).first()
    root = f"file://{tmp_path}/t"
    sinks.write_version(df, root, "v1")
    assert sinks.verified_version(spark, root, "v1").count() == 50
    spark.range(1).withColumn("x", F.lit("y")).write.mode("append").parquet(f"{root}/version=v1")
    with pytest.raises(ValueError):
        sinks.verified_version(spark, root, "v1")


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿a,b\n1,"two\nlines"\n', encoding="utf-8")
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField(c, StringType()) for c in ("a", "b")])
    assert [tuple(r) for r in tables.manifest_csv(spark, f"file://{path}", schema, ["x", "y"]).collect()] == [("1", "two\nlines")]
    names = spark.createDataFrame([("ok.pdf",), ("../x.pdf",), ("a.exe",), ("ok.pdf",), (None,)], "filename string")
    assert {tuple(r) for r in tables.manifest_problems(names, "filename", ["pdf"]).collect()} == {("../x.pdf", "unsafe"), ("a.exe", "extension"), ("ok.pdf", "repeated"), (None, "empty")}
    ids = spark.createDataFrame([("secret-7",)], "identifier string")
    clean, leaky = (spark.createDataFrame([(t,)], "t string") for t in ("nothing here", "see secret-7 here"))
    sinks.write_scrubbed(clean, f"file://{tmp_path}/out", ids, "t")
    with pytest.raises(sinks.ResidualIdentifier):
        sinks.write_scrubbed(leaky, f"file://{tmp_path}/out2", ids, "t")
    assert sinks.markdown(names.where("filename = 'a.exe'"), ["filename"]).splitlines()[-1] == "| a.exe |"


def test_scrubbed_output_refuses_any_identifier_in_any_column(spark, tmp_path):
    df = spark.createDataFrame([("clean", "by kim", 'say "a\\b"\nnow', 7)], "t string, who string, more string, n int")
    for k, name in enumerate(["kim", "by", "7", 'y "a\\', "b\"\nn", "clean"]):
        with pytest.raises(sinks.ResidualIdentifier):
            sinks.write_scrubbed(df, f"file://{tmp_path}/refused{k}", spark.createDataFrame([(name,)], "identifier string"), "t")
    sinks.write_scrubbed(df, f"file://{tmp_path}/out", spark.createDataFrame([("zq",), ("",), (None,), ("kimm",), ("x",)], "identifier string"), "t")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 1


def test_streams_of_files_out_of_time_order(spark, tmp_path):
    day, start = 86400, 1_700_000_000
    path = f"{tmp_path}/events.parquet"
    for k in reversed(range(9)):  # the newest first; files are read in the order of their times
        rows = [(100 * k + j, start + 100 * day * k + 3600 * j, j % 3, f"t{k % 2}", 1.0, None) for j in range(6)]
        part = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
        part.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(f"file://{path}")
    table = spark.read.parquet(f"file://{path}")
    got = plans.QUERIES["stream_sessions"](spark, f"file://{tmp_path}").collect()
    assert sum(r["n"] for r in got) == table.count() and len(got) == 27
    kept = plans.QUERIES["stream_deduplicated"](spark, f"file://{tmp_path}").collect()
    assert sorted((r["user_id"], r["event_type"], r["n"]) for r in kept) == [(u, t, 1) for u in range(3) for t in ("t0", "t1")]


def test_unknown_filters_are_refused(spark):
    from docquarry.operators.predicates import Filter, query_metadata
    from docquarry.plans.metadata import FIELDS

    with pytest.raises(ValueError):
        query_metadata(spark.range(1), FIELDS, [Filter("amount", "like", ("x",))])


def test_route_cover_like_a_loop(spark):
    from docquarry.operators.routing import route_by_names

    names = {1: ["alpha", "beta", "city"], 2: ["alpha", "city"], 3: ["gamma", "delta"], 4: ["city", "works"], 5: ["omega"], 6: ["alpha", "beta", "city"]}
    names |= {k: ["city", "works"] for k in range(7, 12)}
    asked = {1: ["alpha", "beta", "city", "gamma", "delta"], 2: ["city", "works"], 3: ["omega", "x"], 4: ["gamma", "delta", "x"]}
    want = set()
    for q, words in asked.items():
        own = {d: set(t) & set(words) for d, t in names.items() if set(t) & set(words)}
        df = {t: sum(t in o for o in own.values()) for t in words}
        idf = {t: math.log(len(names) / n) for t, n in df.items() if n}
        weight = {d: round(sum(idf[t] for t in o), 6) for d, o in own.items() if len(o) >= 2 and min(df[t] for t in o) < 4}
        taken, explained = [], set()
        for d in sorted(weight, key=lambda d: (-weight[d], d)):
            if sum(idf[t] for t in own[d] - explained) >= max(weight.values()) / 2 or any(own[d] == own[k] for k in taken):
                taken.append(d)
                explained |= own[d]
        want |= {(q, d) for d in taken} if len(taken) <= 4 else set()
    a = spark.createDataFrame([(q, t) for q, words in asked.items() for t in words], "q long, term string")
    n = spark.createDataFrame([*names.items()], "d long, terms array<string>")
    assert {(r["q"], r["d"]) for r in route_by_names(a, n, "q", "d").collect()} == want and want


def test_rerank_keeps_head_and_failed_orders(spark):
    from docquarry.operators.retrieval import rerank_below_head

    order = spark.createDataFrame([(q, f"d{k}", k) for q in (1, 2) for k in range(1, 7)], "q long, d string, rank int")
    scores = spark.createDataFrame([(1, "d3", 0.1), (1, "d4", 0.9), (1, "d5", 0.5), (2, "d3", 0.1), (2, "d5", 0.5)], "q long, d string, score double")
    got = {(r["q"], r["place"]): r["d"] for r in rerank_below_head(order, scores, "q", "d", 2, 5).collect()}
    assert [got[1, k] for k in range(1, 7)] == ["d1", "d2", "d4", "d5", "d3", "d6"]
    assert [got[2, k] for k in range(1, 7)] == [f"d{k}" for k in range(1, 7)]  # one of the pool has no score


def test_decisions_plans_and_releases(spark):
    from docquarry.operators.gold import first_decision, release_decision, resume_plan, revision_errors
    from docquarry.operators.intervals import points_in_boxes

    rows = spark.createDataFrame([("a", 2, "x", "no"), ("a", 1, "y", "yes"), ("a", 3, "y", "no"), ("b", 1, "x", "yes")], "k string, at int, who string, what string")
    got = {r["k"]: tuple(r)[1:] for r in first_decision(rows, ["k"], ["at"], "who", "what").collect()}
    assert got == {"a": ("y", "yes", "x", False), "b": ("x", "yes", None, None)}
    tries = spark.createDataFrame([("a", "ok"), ("a", "bad"), ("b", "unsure"), ("b", "bad"), ("c", "bad")], "k string, s string")
    assert {r["k"]: r["action"] for r in resume_plan(tries, ["k"], "s", ["ok"], ["unsure"]).collect()} == {"a": "done", "b": "held", "c": "retry"}
    checks = spark.createDataFrame([("a", "hard", True), ("a", "quality", True), ("b", "hard", False), ("c", "hard", None), ("d", "hard", True), ("d", "quality", False)], "k string, kind string, ok boolean")
    assert {r["k"]: r["decision"] for r in release_decision(checks, ["k"], "kind", "ok").collect()} == {"a": "ready", "b": "blocked", "c": "limited", "d": "limited"}
    revisions = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 4, "y"), ("b", 1, "x"), ("b", 1, "y")], "k string, n int, c string")
    assert sorted((r["k"], r["n"], *r["errors"]) for r in revision_errors(revisions, ["k"], "n", "c").collect()) == [("a", 2, "unchanged"), ("a", 4, "gap"), ("b", 1, "repeated")]
    points = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0), (9.5, 9.5)], "x double, y double")
    boxes = spark.createDataFrame([("a", 0.0, 5.0, 0.0, 4.0), ("b", 3.0, 9.5, 4.0, 9.5)], "b string, x0 double, x1 double, y0 double, y1 double")
    assert sorted((r["b"], r["x"]) for r in points_in_boxes(points, boxes, "x", "y", 2, 3).collect()) == [("a", 0.0), ("a", 3.0), ("b", 3.0), ("b", 9.5)]


def test_replay_composes_ranges_of_one_key(spark):
    moves = {("a", "x"): "b", ("b", "y"): "c", ("c", "x"): "a"}
    said = ["xyxzy"[(k * k) % 5] for k in range(400)]
    df = spark.createDataFrame([("hot", k, e) for k, e in enumerate(said)] + [("one", 0, "y"), (None, 0, "x")], "u string, t long, e string")
    state, moved = "a", 0
    for e in said:
        moved += (state, e) in moves
        state = moves.get((state, e), state)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the small ranges apart
    try:
        got = {r["u"]: tuple(r)[1:] for r in replay(df, ["u"], ["t"], "e", moves, "a").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == {"hot": (state, moved, 400 - moved), "one": ("a", 0, 1), None: ("b", 1, 0)}


def test_percentiles_of_a_histogram(spark):
    df = spark.createDataFrame([("a", v) for v in [5, 1, 1, 9]] + [("b", 7), ("c", None), (None, 2), (None, 4)], "k string, v long")
    got = {r["k"]: (r["near"], r["mid"]) for r in percentiles(df, ["k"], "v", {"near": 0.5}, {"mid": 0.5}).collect()}
    assert got == {"a": (5, 3.0), "b": (7, 7.0), None: (4, 3.0)}


def test_half_of_each_stratum_with_nulls(spark):
    df = spark.createDataFrame([("s" if k % 3 else None, k) for k in range(3000)], "s string, k long")
    drawn = stratified_half(df, ["s"], "k", 7).where("drawn")
    want = [[r["k"] for r in df.where(F.col("s").eqNullSafe(s)).orderBy(seeded(7, "k")).limit(n).collect()] for s, n in [(F.lit("s"), 1000), (F.lit(None), 500)]]
    assert sorted(r["k"] for r in drawn.collect()) == sorted(sum(want, []))


def test_affirmed_qualifiers(spark):
    texts = {"부가세포함금액": True, "부가세를포함하지않은": False, "미포함": False, "포함안됨포함": True, "": False, "포함가나다라마별도": True, "포함가나다라별도": False}
    df = spark.createDataFrame([*texts.items(), (None, None)], "t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", affirmed(F.col("t"), "포함").alias("got")).collect())
    assert one(spark, affirmed(F.lit("x"), "").alias("x")).x is False
