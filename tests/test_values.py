"""Stated dates and amounts, the value check and mutants on small fixtures."""

import datetime
import re
from decimal import Decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry import plans
from docquarry.functions.values import AMOUNT, MUTATIONS, amounts, dates, large_amounts, read_amounts, replaced, stems, unchanged, value_check, with_negation, with_other_date, with_other_qualifier, with_other_unit, without_condition

DATES = {
    "2024. 6. 11.(화) 17:00": ["2024-06-11", "2024-06-11T17:00"],
    "2024-06-11": ["2024-06-11"],
    "2024년 6월 11일 오후 5시": ["2024-06-11", "2024-06-11T17:00"],
    "2024년 6월 11일 오전 12시 30분": ["2024-06-11", "2024-06-11T00:30"],
    "2024년 6월 11일 오후 12시": ["2024-06-11", "2024-06-11T12:00"],
    "2024/6/1 24:00": ["2024-06-01"],
    "2024/6/1 9:60": ["2024-06-01"],
    "2023-02-29 2024-13-01 1999-01-01": [],
    "b 2025-01-02 a 2024.1.2 9:05 a 2024.1.2": ["2024-01-02", "2024-01-02T09:05", "2025-01-02"],
    "": [],
}
AMOUNTS = {
    "130,000,000원": [130000000], "1억 3천만 원": [130000000], "130백만원": [130000000], "1.3억": [130000000], "12개월": [12], "5만 6만": [50000, 60000], "5천 3억": [5000, 300000000],
    "1억 2345만 6000원": [123456000], "1억5000": [100005000], "3.14 v1.2.3": ["3.14", "1.2"], "5, 6": [5, 6], "0억 0만 0원": [0], "7 7": [7], "없음": [], "2조 5십만": [2000000500000],
}


def test_dates_and_amounts(spark):
    rows = spark.createDataFrame([(k,) for k in [*DATES, None]], "t string").select("t", dates(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == DATES | {None: []}
    rows = spark.createDataFrame([(k,) for k in [*AMOUNTS, None]], "t string").select("t", amounts(F.col("t")).alias("a")).collect()
    assert {r["t"]: r["a"] for r in rows} == {k: [Decimal(str(x)) for x in v] for k, v in AMOUNTS.items()} | {None: []}
    assert spark.range(1).select(large_amounts(F.lit("9,999원 10,000원 1만, 0.5억, 3천")).alias("a")).first()["a"] == [10000, 50000000]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.dates(datetime.date(2000, 1, 1), datetime.date(2099, 12, 31)), st.integers(0, 23), st.integers(0, 59), st.sampled_from("-./년")), min_size=1, max_size=40))
def test_written_dates_are_read_back(spark, given_):
    def written(d, h, m, sep):
        day = f"{d.year}년 {d.month}월 {d.day}일" if sep == "년" else f"{d.year}{sep}{d.month:02d}{sep}{d.day}"
        return f"{day} {'오후' if h >= 12 else '오전'} {h % 12 or 12}시 {m:02d}분" if sep == "년" else f"{day} {h}:{m:02d}"

    rows = [(k, written(*x), f"{x[0]}T{x[1]:02d}:{x[2]:02d}") for k, x in enumerate(given_)]
    assert spark.createDataFrame(rows, "k int, t string, want string").where(F.element_at(dates(F.col("t")), -1) != F.col("want")).collect() == []


@pytest.mark.parametrize(
    "claim, passages, want",
    [
        ("2024-06-11까지 5억원", "기한 2024년 6월 11일, 500,000,000원", None), ("2024-06-11 17:00", "2024-06-11", "unsupported"), ("5억원", "5천만원", "unsupported"), ("3개월", "없음", None),
        ("9,999원", "", None), ("10,000원", "", "unsupported"), ("말", None, None), (None, "2024-06-11", None), ("1만", None, "unsupported"),
    ],
)
def test_value_check(spark, claim, passages, want):
    rows = spark.createDataFrame([(claim, passages)], "c string, p string")
    assert rows.select(value_check(F.col("c"), F.col("p")).alias("v")).first()["v"] == want


def made(spark, f, text, passages):
    r = spark.createDataFrame([(text, passages)], "t string, p string").select(f(F.col("t"), F.col("p")).alias("m")).first()["m"]
    return None if r is None else tuple(r)


def test_each_mutation(spark):
    got = lambda kind, t, p: made(spark, MUTATIONS[kind], t, p)
    assert got("amount", "금액 1억 5000만원, 150,000,000 원", "1.5억") == ("금액 250,000,000원, 250,000,000 원", "150000000", "250000000")
    assert got("amount", "20000", "20,000 30000 40000") == ("20001", "20000", "20001")
    assert got("amount", "20000", "5") is None and got("amount", "3개월", "3개월") is None and got("amount", "1.5만 x", None) is None
    assert got("date", "2024-06-11 17:00 및 2024.6.11", "2024년 6월 11일, 2024-06-18") == ("2024년 6월 25일 17:00 및 2024년 6월 25일", "2024-06-11", "2024-06-25")
    assert got("date", "2024-02-30", "2024-02-30") is None and got("date", "2024-06-11", "2024-06-12") is None
    assert made(spark, with_other_unit, "2024년 3월 1일부터 12 개월, 12개월", "12개월 2024년") == ("2024년 3월 1일부터 12 년, 12년", "12개월", "12년")
    assert made(spark, with_other_unit, "2024년", "2024년") is None and made(spark, with_other_unit, "3시간", "3 시간 이내")[0] == "3분"
    assert made(spark, with_other_qualifier, "5년 이상, 이상 징후", "3명 이상") == ("5년 이하, 이상 징후", "이상", "이하")
    assert made(spark, with_other_qualifier, "부가세 포함 금액 포함", "부가세 포함")[0] == "부가세 별도 금액 포함"
    assert made(spark, with_other_qualifier, "이상 징후", "이상 징후") is None
    text = "서류를 제출해야 합니다. 회의가 있습니다.\n끝"
    assert made(spark, with_negation, text, "서류를 제출해야 한다") == ("서류를 제출하지 않아도 됩니다. 회의가 있습니다.\n끝", "서류를 제출해야 합니다.", "서류를 제출하지 않아도 됩니다.")
    assert made(spark, with_negation, text, "회의가 있습니다")[1] == "회의가 있습니다." and made(spark, with_negation, text, "다른 말") is None
    for kind, f in MUTATIONS.items():
        assert made(spark, f, None, "x") is None and made(spark, f, "x", None) is None and made(spark, f, "", "") is None, kind


def test_conditions_left_out(spark):
    drop = lambda t, *c: made(spark, lambda x, _: without_condition(x, c), t, None)
    assert drop("금액 (부가세 포함) 확정", "부가세 포함 / VAT 포함") == ("금액 확정", "부가세 포함 / VAT 포함", "")
    assert drop("금액 부가세 포함, 부가가치세도", "부가세 포함 / VAT 포함") is None  # the text still speaks of it
    assert drop("a 현장 설치 b", "없는 말", "현장 설치") == ("a b", "현장 설치", "")
    assert drop("x", "") is None and drop(None, "부가세 포함") is None
    assert stems("부가세 포함 / VAT 포함") == ["vat", "부가", "포함"]


def test_mutants_that_do_not_differ(spark):
    rows = spark.createDataFrame([("1만", "1만", ("2만", "10000", "20000")), ("1만", "2만", ("2만", "10000", "20000")), ("1만", "", ("1만, 2만", "10000", "20000")), ("1만", "", ("1만", "10000", "20000")), ("1만", "", None)], "t string, p string, m struct<text: string, before: string, after: string>")
    got = [r["u"] for r in rows.select(unchanged("amount", F.col("t"), F.col("m"), F.col("p")).alias("u")).collect()]
    assert got == [None, "the passages also state the new amount", "the amount was not replaced everywhere", "text unchanged", None]
    day = spark.createDataFrame([("2024-01-01", "", ("2024-01-08", "2024-01-01", "2024-01-08"))], "t string, p string, m struct<text: string, before: string, after: string>")
    assert day.select(unchanged("date", F.col("t"), F.col("m"), F.col("p")).alias("u")).first()["u"] is None
    assert made(spark, with_other_date, "2024-01-01 오후 3시", "2024-01-01")[0] == "2024년 1월 8일 15:00" and not re.search("오후", made(spark, with_other_date, "2024-01-01 오후 3시", "2024-01-01")[0])


def test_mutants_read_texts_once_in_many_tasks(spark, tmp_path):
    """Before, texts were read anew for each mutation and check, patterns were compiled for each row by split(), and one row group was one task."""
    rows = [(k, k * 7 % 13, 900.0 + 1234.56 * k, datetime.datetime(1995 + k % 5, 1 + k % 12, 28)) for k in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    df = plans.QUERIES["text_mutants"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.sql(plans.SQL["text_mutants"]).fetchall(), key=str)
    assert df.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 12 and "split(claim" not in plan and plan.count("array_contains(") == 0


def test_matches_are_replaced_where_they_stand(spark):
    texts = ["", "5", "5만", "a5만", "5만a", "5만5만 5", "v1.2 5만\n", "\u00015만\u0001", "1만2억 5만,", "5만 \n 5만", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", replaced(F.col("t"), AMOUNT, read_amounts(F.col("t")), lambda x: F.when(x["v"] == 50_000, F.concat(F.lit("<"), x["w"], F.lit(">")))).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == {t: None if t is None else re.sub(AMOUNT, lambda m: f"<{m[0]}>" if m[0].strip() == "5만" else m[0], t) for t in texts}
