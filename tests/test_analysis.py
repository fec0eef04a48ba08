"""Analyzers: best paths against all paths, postings by version, BM25 by brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry import plans
from docquarry.operators import analysis
from docquarry.operators.analysis import Entry, Lattice, Pieces, WholeWords, entries_of, kept_postings

ENTRIES = tuple(Entry(t, tag, c) for t, tag, c in [("on", "function", 900), ("en", "content", 2000), ("onen", "content", 3100), ("er", "content", 2500), ("ner", "content", 2400), ("th", "content", 4000), ("erth", "content", 6500), ("no", "function", 1500), ("none", "content", 9000), ("on", "content", 950), ("日本", "content", 5000)])
SHARDS = "/root/testdata/sf0.001"


def all_paths(run, entries):
    costs = {}
    for e in entries:
        if e.term not in costs or (e.cost, e.tag) < costs[e.term]:
            costs[e.term] = (e.cost, e.tag)

    def walk(a, last):
        if a == len(run):
            yield 0, ()
            return
        for b in range(a + 1, len(run) + 1):
            piece = run[a:b]
            options = [(costs[piece][0], costs[piece][1])] if piece in costs else []
            if last != "unknown":
                options.append((analysis.UNKNOWN + analysis.UNKNOWN_CHARACTER * len(piece), "unknown"))
            for cost, tag in options:
                for rest, path in walk(b, tag):
                    yield cost + rest, ((piece, tag), *path)

    return list(walk(0, ""))


def test_best_path_is_the_best_of_all():
    rng = random.Random(1)
    lattice = Lattice(ENTRIES)
    for _ in range(300):
        run = "".join(rng.choice(["on", "en", "er", "th", "n", "o", "x", "日本", "日"]) for _ in range(rng.randint(1, 5)))[:9]
        got = lattice.path(run)
        paths = all_paths(run, ENTRIES)
        cost = {p: c for c, p in paths}
        assert "".join(p for p, _ in got) == run
        assert cost[tuple(got)] == min(c for c, _ in paths)


def test_pieces_of_words():
    own = Pieces(ENTRIES)
    assert own.terms("onenerth") == ["onen", "erth"] or sum(map(len, own.terms("onenerth"))) <= 8
    assert own.terms("on") == [] and own.terms("no") == ["no"]  # a function word goes, a negation stays
    assert own.terms("en2024-xyz") == ["en", "2024", "xyz"]
    assert own.version == Pieces(ENTRIES[::-1]).version != Pieces(ENTRIES[:-1]).version


DOCS = [(k, " ".join(random.Random(k).choice(["onen", "onener", "Erth,", "no", "SFR-001", "xy", "enth", "on"]) for _ in range(12))) for k in range(30)] + [(30, None), (31, ""), (32, "on on"), (33, "SFR-001 sfr-001 xSFR-001")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def plain_postings(rows, own):
    out = Counter()
    for k, t in rows:
        found = Counter()
        words = [w for w in (w.strip(".,;:!?()[]{}\"'`|*#%$&") for w in (t or "").lower().split()) if w]
        for w in words or ["∅"]:
            found.update(own.terms(w))
        for code in [c for c in (t or "").split() if c == "SFR-001"]:
            found["code:" + code] += 1
        for term, n in (found or {"∅": 1}).items():
            out[k, term] += n
    return out


def test_postings_equal_a_loop(docs):
    own = Pieces(ENTRIES)
    got = {(r["doc_id"], r["term"]): r["tf"] for r in own.postings(docs, "doc_id", "text").collect()}
    assert got == plain_postings(DOCS, own)
    assert own.postings(docs.where("false"), "doc_id", "text").count() == 0


def test_postings_are_kept_by_version(docs, tmp_path):
    root = f"file://{tmp_path}/postings"
    own = Pieces(ENTRIES)
    first, there = kept_postings(docs, "doc_id", "text", own, root)
    again, found = kept_postings(docs, "doc_id", "text", own, root)
    assert (there, found) == (False, True) and sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert kept_postings(docs, "doc_id", "text", WholeWords(), root)[1] is False
    assert kept_postings(docs, "doc_id", "text", Pieces(ENTRIES[1:]), root)[1] is False
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, "new").otherwise(F.col("text")))
    assert kept_postings(changed, "doc_id", "text", own, root)[1] is False
    assert kept_postings(docs, "doc_id", "text", own, root)[1] is True


def test_ranking_by_pieces(spark):
    import duckdb

    entries = entries_of(plans.QUERIES["text_dictionary"](spark, SHARDS).collect())
    own = Pieces(entries)
    con = duckdb.connect()
    docs = con.sql(f"SELECT doc_id, text FROM '{SHARDS}/documents.parquet'").fetchall()
    items = con.sql(f"SELECT item_id, text FROM '{SHARDS}/benchmark.parquet'").fetchall()
    counts, asked = plain_postings(docs, own), plain_postings(items, own)
    size, df = Counter(), Counter()
    for (k, term), n in counts.items():
        size[k] += n
        df[term] += 1
    n, mean = len(size), sum(size.values()) / len(size)
    idf = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if x < 0 else x for t, x in idf.items()}
    by_term = {}
    for (k, term), tf in counts.items():
        by_term.setdefault(term, []).append((k, tf))
    want = Counter()
    for (item, term), times in asked.items():
        for k, tf in by_term.get(term, ()):
            want[item, k] += times * idf[term] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size[k] / mean))
    got = plans.QUERIES["search_bm25_pieces"](spark, SHARDS).collect()
    assert got and all(abs(r["score"] - want[r["item_id"], r["doc_id"]]) < 2e-6 for r in got)
    least = {r["item_id"]: r["score"] for r in sorted(got, key=lambda r: -r["score"])}
    for (item, k), score in want.items():
        assert score <= least[item] + 2e-6 or any(r["item_id"] == item and r["doc_id"] == k for r in got)
    both = plans.QUERIES["eval_analyzers"](spark, SHARDS).collect()
    assert len(both) == len({i for i, _ in items}) and all(r["by_both"] <= min(r["by_words"], r["by_pieces"]) <= 20 for r in both)
