"""The contract of structured answers, their fields and segments, rule by rule."""

import json

import pytest
from pyspark.sql import functions as F

from docquarry.operators.answers import answer_fields, cited_ids, cited_segments, document_text, field_text, mentioned, parsed, validated, verbatim

UNITS = [("a", "E1", "d1", "q", "q"), ("a", "E2", "d2", "q", "q"), ("a", "E3", "d1", "q", "other"), ("a", "E3", "d1", "q", "q"), ("a", "M1", "d1", None, None), ("a", None, "d1", "q", "q"), ("b", "E9", "d1", "q", "q"), (None, "E9", "d1", "q", "q")]


def claim(ids, doc="d1", kind="source_fact", text="so [E1]"):
    return {"kind": kind, "doc_id": doc, "text": text, "evidence_ids": ids}


def answer(**parts):
    return {"status": "answered", "summary": "all [E1, M1]", "summary_evidence_ids": ["E1"], "claims": [claim(["E1"])]} | parts


def conflict(*sides):
    return [{"topic": "t", "alternatives": [{"doc_id": doc, "value": "v", "evidence_ids": ids} for doc, ids in sides]}]


def check(spark, given, required=None, allowed=("d1", "d2")):
    rows = [(k, a if isinstance(a, str) or a is None else json.dumps(a), None if allowed is None else list(allowed), required) for k, a in given]
    table = spark.createDataFrame(rows, "k string, answer string, allowed array<string>, required array<string>")
    evidence = spark.createDataFrame(UNITS, "k string, evidence_id string, doc_id string, quote string, stored string")
    return validated(table, evidence, "k", "answer", "allowed", "required").collect()


ONE_SIDE = conflict(("d1", ["E1"]))
BOTH = conflict(("d1", ["E1"]), ("d2", ["E2"]))


@pytest.mark.parametrize(
    "given, want",
    [
        (answer(), []),
        (answer(claims=[claim(["E1", "M1"])]), []),
        (answer(claims=[claim(["E7"])]), ["unknown_evidence_id: E7"]),
        (answer(claims=[claim(["E2"])]), ["evidence_scope_mismatch: E2"]),
        (answer(claims=[claim(["E3"])]), ["evidence_quote_mismatch: E3"]),
        (answer(claims=[claim([])]), ["claim_without_evidence"]),
        (answer(claims=[claim(None)]), ["claim_without_evidence"]),
        (answer(claims=[claim(["E1"], "d9")]), ["claim_outside_scope: d9", "evidence_scope_mismatch: E1"]),
        (answer(claims=[claim([], "d9", "absence"), claim(["E1"])]), ["claim_outside_scope: d9"]),
        (answer(claims=[claim([], "d2", "absence")]), ["answered_without_claims"]),
        (answer(claims=None), ["answered_without_claims"]),
        (answer(summary_evidence_ids=[]), ["summary_without_evidence"]),
        (answer(summary_evidence_ids=["E2", "E3", "E8"]), ["evidence_quote_mismatch: E3", "unknown_evidence_id: E8"]),
        (answer(status="insufficient_evidence", claims=[], summary_evidence_ids=[]), []),
        (answer(status="conflicting_evidence"), ["conflict_without_conflicts"]),
        (answer(status="conflicting_evidence", conflicts=ONE_SIDE, next_action="ask"), ["conflict_with_one_alternative"]),
        (answer(status="conflicting_evidence", conflicts=BOTH, next_action=" "), ["conflict_without_next_action"]),
        (answer(status="conflicting_evidence", conflicts=BOTH, next_action="ask"), []),
        (answer(conflicts=conflict(("d9", ["E1"]), ("d1", []))), ["conflict_without_evidence", "evidence_scope_mismatch: E1", "conflict_without_evidence"]),
        (answer(missing_fields=[{"doc_id": "d9", "field": "f", "reason": "r"}, {"doc_id": "d1", "field": "f", "reason": "source_absence_verified"}]), ["missing_field_outside_scope: d9", "source_absence_claimed_from_retrieval"]),
        (answer(claims=7), ["schema_invalid"]),
        (answer(claims=[{"kind": "inference"}]), ["schema_invalid"]),
        (answer(status=None), ["schema_invalid"]),
        ('{"status": "answered", ', ["schema_invalid"]),
        ("", ["schema_invalid"]),
        (None, ["schema_invalid"]),
    ],
)
def test_each_rule(spark, given, want):
    got = check(spark, [("a", given)])[0]
    assert got["problems"] == want
    assert got["problem"] == (want[0] if want else None) and (got["shown"] is None) == bool(want)


def test_comparisons_may_cite_the_other_side_and_need_both(spark):
    both = ["d1", "d2"]
    run = lambda a, required=both: check(spark, [("a", a)], required)[0]["problems"]
    inference = claim(["E1", "E2"], kind="inference")
    assert run(answer(claims=[inference, claim(["E2"], "d2")])) == []
    assert run(answer(claims=[inference, claim(["E2"], "d2")]), None) == ["evidence_scope_mismatch: E2"]
    assert run(answer(claims=[claim(["E2"], "d1", "inference"), claim(["E2"], "d2")])) == ["evidence_scope_mismatch: inference cites nothing of d1"]
    assert run(answer()) == ["comparison_side_missing: d2"]
    assert run(answer(missing_fields=[{"doc_id": "d2", "field": "f", "reason": "not_found_in_context"}])) == []
    assert run(answer(claims=[claim(["E1"]), claim([], "d2", "absence")])) == []


def test_no_evidence_no_scope_and_no_answers(spark):
    assert check(spark, [("b", answer()), ("c", answer())])[1]["problems"][0].startswith("unknown")
    assert check(spark, [("a", answer())], allowed=None)[0]["problem"] == "claim_outside_scope: d1"
    assert [r["problem"] for r in check(spark, [(None, answer()), (None, answer())])] == ["unknown_evidence_id: E1"] * 2
    assert check(spark, []) == []


def test_absences_become_missing_fields(spark):
    listed = {"doc_id": "d1", "field": "the  price", "reason": "r"}
    claims = [claim([], "d1", "absence", "the price [E1]"), claim([], "d2", "absence", "the price"), claim([], "d2", "absence", " the  price (E2)"), claim([], "d1", "absence", "[E1]"), claim(["E1"])]
    s = check(spark, [("a", answer(claims=claims, missing_fields=[listed]))])[0]["shown"]
    assert [tuple(m) for m in s["missing_fields"]] == [("d1", "the  price", "r"), ("d2", "the price", "not_found_in_context")]
    assert [c["text"] for c in s["claims"]] == ["so"] and s["summary"] == "all"


def test_fields_and_ids(spark):
    a = answer(conflicts=BOTH, missing_fields=[{"doc_id": "d1", "field": "f", "reason": "r"}], listing=[{"doc_id": "d1", "description": "row", "evidence_ids": ["E5", "E1"]}], next_action="")
    col = lambda x: parsed(F.lit(json.dumps(x)))
    row = spark.range(1).select(
        answer_fields(col(a)).alias("f"), cited_ids(col(a)).alias("ids"), answer_fields(col({"status": "answered"})).alias("none"), cited_ids(col({})).alias("no_ids"),
        *[field_text(col(a), F.lit(n)).alias(f"t{k}") for k, n in enumerate(["claim.0", "claim.1", "conflict.0.1", "next_action", "nonsense"])],
        document_text(col(a), F.lit("d1"), F.lit(True)).alias("one"), document_text(col(a), F.lit("d2"), F.lit(False)).alias("two"), document_text(col({}), F.lit("d2"), F.lit(False)).alias("three"),
    ).first()
    assert [f["field"] for f in row["f"]] == ["summary", "claim.0", "conflict.0.0", "conflict.0.1", "missing.0", "listing.0"]
    assert row["ids"] == ["E1", "E2", "E5"] and row["none"] == [] and row["no_ids"] == []
    assert [row[f"t{k}"] for k in range(5)] == ["so [E1]", None, "v", None, None]
    assert (row["one"], row["two"], row["three"]) == ("all [E1, M1] so [E1] v", "v", "")


def test_support_word_for_word(spark):
    pairs = [("one two", "x onetwo\ny", True), ("one two", "one three two", False), ("abc", "abc", False), ("", "abc", False), (None, "a", False), ("abcd", None, False)]
    rows = spark.createDataFrame(pairs, "c string, t string, want boolean")
    assert rows.where(verbatim(F.col("c"), F.col("t")) != F.col("want")).count() == 0


def test_segments_put_together_are_the_text(spark):
    cases = [("abcabc", "bc", 4, [("abca", False), ("bc", True)]), ("abcabc", "bc", 2, [("a", False), ("bc", True), ("abc", False)]), ("abc", "x", 0, [("abc", False)]), ("abc", "", 1, [("abc", False)]), ("abc", None, None, [("abc", False)]), ("abc", "abc", None, [("abc", True)]), ("", "a", 0, []), ("ä€😀b", "😀", -1, [("ä€", False), ("😀", True), ("b", False)])]
    rows = spark.createDataFrame([c[:3] for c in cases], "t string, q string, s int")
    got = rows.select(cited_segments(F.col("t"), F.col("q"), F.col("s")).alias("x")).collect()
    assert [[tuple(s) for s in r["x"]] for r in got] == [c[3] for c in cases]


def test_members_without_themselves(spark):
    rows = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "a"), ("g", None), ("h", "c"), (None, "d"), (None, "e")], "g string, m string")
    assert {(r["g"], r["m"]): r["others"] for r in mentioned(rows, ["g"], "m").collect()} == {("g", "a"): ["b"], ("g", "b"): ["a"], ("h", "c"): [], (None, "d"): ["e"], (None, "e"): ["d"]}
