"""Rankings made within the tasks against plain loops, with bounds so small that every cut is met."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry import plans
from docquarry.functions.text import raw_text, tokens
from docquarry.operators import matching
from docquarry.operators.analysis import Pieces, WholeWords, entries_of

rng = random.Random(11)
WORDS = [*"abcdefghij", "é", "on", "in"]
DOCS = [(k, " ".join(rng.choices(WORDS, range(13, 0, -1), k=rng.randint(1, 9))), rng.choice(["x", "y", None])) for k in range(300)]
DOCS += [(400, "a b", "x"), (400, "c d", "y"), (400, "a b", "y"), (401, None, "x"), (None, "a b j", "x"), (None, "j", "y")]
ITEMS = [(q, " ".join(rng.choices([*WORDS, "zz"], k=rng.randint(1, 6)))) for q in range(30)]


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for name, value in (("GROUP_TERMS", 40), ("GROUP_QUERIES", 8), ("PART", 64), ("SLICE", 16), ("WAITING", 50), ("KEPT", 150), ("SIDES", 3)):
        monkeypatch.setattr(matching, name, value)


def texts(spark, side=None):
    docs = spark.createDataFrame(DOCS, "d long, text string, s string").repartition(3)
    return matching.words_by_text(docs, "d", F.split(F.coalesce("text", F.lit("∅")), " "), side)


def best(score, k):
    """{query: [doc]} of {(query, doc): score}."""
    out = {}
    for (q, d), s in sorted(((x, s) for x, s in score.items() if s > 0 and x[1] is not None), key=lambda x: (x[0][0], -x[1], x[0][1])):
        out.setdefault(q, []).append((d, s))
    return {q: v[:k] for q, v in out.items()}


def test_scores_of_lists_equal_a_loop(spark):
    asked = spark.createDataFrame([(q, t, n) for q, text in ITEMS for t, n in Counter(text.split()).items()], "q long, term string, tf long")
    own = {}
    for d, text, _ in DOCS:
        own.setdefault(d, Counter()).update((text or "∅").split(" "))
    df = Counter(t for words in own.values() for t in words)
    idf = {t: math.log((len(own) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    mean = sum(sum(w.values()) for w in own.values()) / len(own)
    part = lambda w, t: (idf[t] if idf[t] >= 0 else floor) * w[t] * 2.5 / (w[t] + 1.5 * (0.25 + 0.75 * sum(w.values()) / mean))
    score = {(q, d): round(sum(part(w, t) for t in text.split() if w[t]), 6) for q, text in ITEMS for d, w in own.items()}
    lists = matching.term_lists(texts(spark), "d").cache()
    got = matching.bm25_of_lists(lists, asked, "d", "q", 4).collect()
    want = best(score, 4)
    assert {(r["q"], r["d"], r["score"], r["rank"]) for r in got} == {(q, d, s, k + 1) for q, v in want.items() for k, (d, s) in enumerate(v)}
    sided = matching.bm25_of_lists(matching.term_lists(texts(spark, F.col("s")), "d").cache(), asked, "d", "q", 2, "s").collect()
    for side in ("x", "y", None):
        has = [d for d, _, s in DOCS if s == side]
        found = {q: [d for d, _ in v] for q, v in best({(q, d): s for (q, d), s in score.items() if d in has and d != 400}, 9).items()}
        for q in {q for q, _ in ITEMS}:
            mine = [r["d"] for r in sorted(sided, key=lambda r: r["rank"]) if r["q"] == q and r["s"] == side]
            assert [d for d in mine if d != 400] == found.get(q, [])[: len([d for d in mine if d != 400])] and len(mine) <= 2
    assert matching.bm25_of_lists(lists.where("false"), asked, "d", "q", 4).count() == 0
    assert matching.bm25_of_lists(lists, asked.where("false"), "d", "q", 4).count() == 0


def test_shared_runs_of_two_words_equal_a_loop(spark):
    runs = lambda t: set(zip((t or "∅").split(" "), (t or "∅").split(" ")[1:], strict=False))
    asked = spark.createDataFrame([(q, " ".join(p)) for q, t in ITEMS for p in runs(t)], "q long, term string")
    own = {}
    for d, text, _ in DOCS:
        own.setdefault(d, set()).update(runs(text))
    score = {(q, d): round(len(runs(t) & have) / len(runs(t)), 6) for q, t in ITEMS if runs(t) for d, have in own.items()}
    got = matching.containment(texts(spark), asked, "d", "q", 3).collect()
    assert {(r["q"], r["d"], r["score"], r["rank"]) for r in got} == {(q, d, s, k + 1) for q, v in best(score, 3).items() for k, (d, s) in enumerate(v)}


def test_lists_hold_the_postings(spark):
    docs = spark.createDataFrame([(k, f"{t} SFR-001 On, no" if k % 7 == 0 else t) for k, t, _ in DOCS if k is not None], "doc_id long, text string")
    for own in (WholeWords(), Pieces(entries_of([("on", "content", 10), ("in", "function", 5)]))):
        lists = own.lists(docs, "doc_id", "text").select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).selectExpr("doc_id", "x.terms", "cast(x.tfs as long)")
        assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, own.postings(docs, "doc_id", "text").collect()))


def test_rankings_do_not_pair_all_documents_with_all_items(spark):
    """Before, each document met each item under every common word; now tasks give their best rows only."""
    df = plans.QUERIES["search_bm25"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


SHOWN = [(k, t and t.replace(" ", rng.choice([" ", "\n", "\t\r\n", ", ", " ( ", "  "])).upper(), s) for k, t, s in DOCS] + [(500, "", "x"), (501, " ?! .", "y"), (502, "É İn 'on'.", "x")]


def test_scores_of_texts_equal_those_of_lists(spark, monkeypatch):
    """Texts are cut within tasks as `tokens` cuts them; parts and sums so small that each border is met."""
    monkeypatch.setattr(matching, "BYTES", 60)
    monkeypatch.setattr(matching, "ADDED", 7)
    docs = spark.createDataFrame(SHOWN, "d long, text string, s string").repartition(3)
    asked = spark.createDataFrame([(q, t, n) for q, text in ITEMS for t, n in Counter([*text.split(), "∅"]).items()], "q long, term string, tf long")
    for side, k in ((None, 4), (F.col("s"), 2)):
        lists = matching.term_lists(matching.words_by_text(docs, "d", tokens(F.col("text")), side), "d").cache()
        texts = matching.words_by_text(docs, "d", F.array(raw_text(F.col("text"))), side)
        want = matching.bm25_of_lists(lists, asked, "d", "q", k).collect()
        got = matching.bm25_of_texts(texts, asked, "d", "q", k).collect()
        assert want and sorted(map(repr, got)) == sorted(map(repr, want))
        some = F.col("d") % 2 == 0
        assert sorted(map(repr, matching.bm25_of_texts(texts, asked, "d", "q", k, admitted=some).collect())) == sorted(map(repr, matching.bm25_of_lists(lists, asked, "d", "q", k, admitted=some).collect()))
    pairs = spark.createDataFrame([(q, " ".join(p)) for q, t in ITEMS for p in set(zip(t.split(), t.split()[1:], strict=False))], "q long, term string")
    words = matching.words_by_text(docs, "d", tokens(F.col("text")))
    texts = matching.words_by_text(docs, "d", F.array(raw_text(F.col("text"))))
    want, got = (matching.containment(x, pairs, "d", "q", 3, *c).collect() for x, c in ((words, []), (texts, [matching.coded_texts])))
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))
    held = {r["term"]: r["n"] for r in matching.held_terms(texts).collect()}
    one = words.select("d", F.explode("words").alias("w")).where("w IS NOT NULL").distinct().groupBy("w").count().collect()
    assert held.pop(None) == texts.count() and held == {r["w"]: r["count"] for r in one}
    assert matching.bm25_of_texts(texts.where("false"), asked, "d", "q", 4).count() == 0
    assert matching.bm25_of_texts(texts, asked.where("false"), "d", "q", 4).count() == 0


@pytest.mark.parametrize("name", ["search_bm25", "search_bm25_scoped", "search_balanced_sides", "search_hybrid_rrf"])
def test_rankings_write_nothing_of_the_texts(spark, monkeypatch, name):
    """Before, the words of all texts were written as lists; now only counts of terms and rows of items are."""
    kinds = []
    for module in (matching, plans.retrieval):
        monkeypatch.setattr(module, "written", lambda df, own=module.written: kinds.append(df.dtypes) or own(df))
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert kinds and not [x for kind in kinds for x in kind if x[0] == "doc_id" or x[1].startswith("array")]


@pytest.mark.parametrize(
    "name", ["eval_needle_hits", "search_hybrid_rrf", "eval_channel_gate", "search_pack_evidence", "search_rerank_protected", "eval_missed_items", "search_bm25_scoped"]
)
def test_rankings_write_nothing_of_the_vocabulary(spark, monkeypatch, tmp_path, name):
    """Before, each term of all texts was written, twice; now only those of items are, and one row for all others that are in as many texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = F.concat_ws(" ", F.coalesce("text", F.lit("")), *[F.concat(F.lit(f"junk{k}x"), "doc_id") for k in range(50)])
    docs.withColumn("text", junk).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "benchmark.parquet").symlink_to("/root/testdata/sf0.001/benchmark.parquet")
    for bound, value in (("GROUP_TERMS", 16_384), ("GROUP_QUERIES", 512)):
        monkeypatch.setattr(matching, bound, value)
    sizes = []

    def measured(df, own=matching.written):
        sizes.append((out := own(df)).count())
        return out

    for module in (matching, plans.retrieval):
        monkeypatch.setattr(module, "written", measured)
    assert plans.QUERIES[name](spark, str(tmp_path)).count() > 0
    items = [plans.retrieval.word_pairs(spark.read.parquet(str(tmp_path / "benchmark.parquet")), "item_id").count(), docs.count()]
    assert sizes and max(sizes) <= sum(items) < docs.count() * 50
