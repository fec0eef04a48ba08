"""Operator 11 against a loop over code points."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry.llm import middle

rng = random.Random(3)
ALPHABET = "ab \n<>PSMé日😀\r \x00"
TEXTS = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(300)]
TEXTS += ["", None, "x", "<P>", "a<S>b", "<M", "S>", "<", "日" * 300_000, "ab" * 900_000, "<<P", "é" * 50]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (5, TEXTS[5]), (5, TEXTS[5]), (-3, "negative")]
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, sha("<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]), sha(text)
    return doc_id, n, "psm", a, b - a, sha("<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]), sha(text)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").select("*", F.lit("x").alias("form"), F.lit(1).alias("output"), F.lit(2).alias("n"))


def test_digests_equal_the_loop(docs):
    from docquarry.llm.queries import middle_digests

    got = Counter(map(tuple, middle_digests(docs).collect()))
    assert got == Counter(expected(*r) for r in ROWS)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_units_of_ones_own(docs):
    own = middle.fill_in_middle(docs, middle.Settings(unit=r"\X", percent=100, spm_percent=50))
    rows = own.withColumn("back", middle.restored(F.col("form"), F.col("output"))).collect()
    assert Counter((r["doc_id"], r["back"]) for r in rows) == Counter((k, t or "") for k, t in ROWS)
    whole = [r for r in rows if r["doc_id"] == TEXTS.index("é" * 50)]
    assert whole[0]["n"] == 50 and whole[0]["prefix_chars"] % 2 == whole[0]["middle_chars"] % 2 == 0
    words = middle.fill_in_middle(docs, middle.Settings(unit=r"b+")).where("doc_id = 2").collect()
    assert all(r["n"] is None and r["form"] == "plain" or set(r["output"]) <= set("b<PSM>") for r in words)


def test_empty_table(spark, docs):
    from docquarry.llm.queries import middle_digests

    assert middle_digests(docs.where("false")).count() == 0
