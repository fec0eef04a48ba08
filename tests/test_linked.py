"""Similarity joins, families, the vector index and threshold bands against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry import plans
from docquarry.functions.statistics import threshold_band
from docquarry.operators import vectorindex
from docquarry.operators.families import families
from docquarry.operators.similarity import across_splits, set_classes, similar_classes

rng = random.Random(6)


def some_sets(n, names, most):
    out = [sorted(rng.sample(names, rng.randint(1, most))) for _ in range(n)]
    for k in range(0, n, 3):  # near copies
        own = set(out[rng.randrange(n)])
        own.symmetric_difference_update(rng.sample(names, rng.randint(0, 2)))
        out[k] = sorted(own) or [names[0]]
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_similar_sets_equal_all_pairs(spark, threshold):
    names = [f"g{k}" for k in range(14)] + ["common", "a|b", ""]
    sets = [*some_sets(120, names, 9), ["common"], ["common"], [], None, [""]]
    splits = [rng.choice(["dev", "test", None]) for _ in sets]
    rows = spark.createDataFrame(list(zip(range(len(sets)), sets, splits, strict=True)), "k int, own array<string>, split string")
    alike = lambda a, b: bool(a) and bool(b) and len(set(a) & set(b)) >= threshold * len(set(a) | set(b)) - 1e-12
    got = {r["k"]: r["n_links"] for r in across_splits(rows, "own", "split", threshold).collect()}
    assert got == {k: sum(alike(a, b) and splits[k] != splits[j] for j, b in enumerate(sets)) for k, a in enumerate(sets)}
    classes = set_classes(rows, "own").where("class is not null").groupBy("class").agg(F.first("own").alias("own"))
    name = {r["class"]: frozenset(r["own"]) for r in classes.collect()}
    pairs = {frozenset((name[r["a"]], name[r["b"]])) for r in similar_classes(classes, "own", threshold).collect()}
    distinct = list(set(name.values()))
    assert pairs == {frozenset((a, b)) for i, a in enumerate(distinct) for b in distinct[:i] if alike(a, b)}
    assert across_splits(rows.where("false"), "own", "split", threshold).count() == 0


def test_families_equal_a_search(spark):
    rows = [(k, f"h{k // 2}", f"t{(k + 1) // 2}") for k in range(60)]  # one long chain
    rows += [(100 + k, None, "hot") for k in range(300)] + [(500, None, None), (501, "x", None), (502, "x", "y"), (503, None, "y"), (504, "y", None)]
    got = {r["k"]: r["family"] for r in families(spark.createDataFrame(rows, "k long, h string, t string"), "k", ["h", "t"]).collect()}
    want = {k: 0 if k < 60 else 100 if k < 500 else {500: 500, 504: 504}.get(k, 501) for k, _, _ in rows}
    assert got == want
    assert families(spark.createDataFrame([], "k long, h string, t string"), "k", ["h"]).count() == 0


def test_index_finds_what_exact_search_finds(spark):
    found = plans.QUERIES["eval_indexed_recall"](spark, "/root/testdata/sf0.01").collect()
    assert len(found) == 25 and sum(r["found"] for r in found) >= 0.9 * sum(r["n"] for r in found)
    g = np.random.default_rng(3)
    rows = [(k, [*map(float, g.standard_normal(32) + 3 * (k % 5 == 0))]) for k in range(700)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32)]
    table = spark.createDataFrame(rows, "k long, v array<double>")
    asked = table.where("k % 20 = 0")  # all of one kind of rows
    chosen = vectorindex.built(table, "k", "v", 10, like=asked)
    assert chosen.setting and chosen.measured[-1][1] >= 0.92 and chosen.setting.shortlist < 700 / 3
    assert sum(len(r["keys"]) for r in chosen.index.collect()) == 700  # every usable row is in the index
    exact = vectorindex.search(vectorindex.Chosen(chosen.rows, None, None, None, ()), asked, "k", "v", 10)
    v = np.array([e for _, e in rows[:700]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for r in exact.collect():
        own = v @ v[r["query"]]
        own[r["query"]] = -2
        assert abs(own[r["key"]] - r["score"]) < 1e-6 and (own > r["score"] + 1e-6).sum() < 10
    share = vectorindex.recall(exact, vectorindex.search(chosen, asked, "k", "v", 10)).agg(F.sum("found") / F.sum("n")).first()[0]
    assert share >= 0.9
    whole = vectorindex.built(table.where("false"), "k", "v", 10)
    assert whole.setting is None and vectorindex.search(whole, table.where("false"), "k", "v", 10).count() == 0


def test_bands_equal_all_bands(spark):
    items = [(round(rng.random(), 1) if rng.random() < 0.9 else None, rng.random() < 0.5) for _ in range(80)]
    got = threshold_band(spark.createDataFrame(items, "s double, a boolean"), "s", "a", 0.6, 1.01).first()
    cuts, best = sorted({s for s, _ in items if s is not None} | {0.0, 1.01}), None
    for lo in cuts:
        for hi in [c for c in cuts if c >= lo]:
            judged = [(s >= hi, a) for s, a in items if s is not None and (s >= hi or s < lo)]
            m = len(judged)
            tp, fa, fr = sum(x and a for x, a in judged), sum(x and not a for x, a in judged), sum(a and not x for x, a in judged)
            kappa = None
            if m:
                po, ra, ja = (m - fa - fr) / m, (tp + fr) / m, (tp + fa) / m
                pe = ra * ja + (1 - ra) * (1 - ja)
                kappa = (po - pe) / (1 - pe) if pe < 1 else None
            score = (m / 80 >= 0.6, round(-1 if kappa is None else kappa, 9), -fa, m, -round(hi - lo, 6), -lo)
            if best is None or score > best[0]:
                best = (score, (lo, hi, kappa, m / 80, fa))
    assert (got["lo"], got["hi"], got["false_accepts"], got["n"]) == (best[1][0], best[1][1], best[1][4], 80)
    assert got["kappa"] == pytest.approx(best[1][2], abs=1e-6) and got["coverage"] == pytest.approx(best[1][3])
