"""Operator 12 against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import anchors, vectorcodes

generator = np.random.default_rng(4)


def brute_codes(points, entries):
    gap = ((points[:, None].astype(object) - entries.astype(object)) ** 2).sum(axis=2)
    return [min(range(len(entries)), key=lambda k: (row[k], k)) for row in gap], gap


@pytest.mark.parametrize("kind", ["even", "clustered", "equal", "few", "line", "far", "wide"])
def test_tree_gives_nearest_entries(kind):
    d = 20 if kind == "wide" else 3
    for n in (1, 2, 17, 300, 1500):
        rows = {"even": generator.integers(-99, 99, (n, d)), "clustered": generator.integers(-3, 4, (n, d)) + 60 * generator.integers(0, 4, (n, 1)), "equal": np.full((n, d), 7), "few": generator.integers(0, 2, (n, d)), "line": np.arange(n)[:, None] * np.ones((1, d), int), "far": generator.integers(-(2**27), 2**27, (n, d)), "wide": generator.integers(-50, 50, (n, d))}[kind]
        tree = anchors.grown(rows)
        assert (tree.points[tree.place] == rows).all() and tree.counts[0] == n and (tree.sums[0] == rows.sum(axis=0)).all()
        for k, (a, b) in enumerate(zip(tree.start.tolist(), tree.end.tolist(), strict=True)):
            own, weights = tree.points[a:b].astype(np.int64), tree.weights[a:b]
            assert tree.counts[k] == weights.sum() and (tree.sums[k] == weights @ own).all()
            assert np.sqrt(((own - tree.sums[k] / tree.counts[k]) ** 2).sum(axis=1)).max() <= tree.radius[k] * (1 + 1e-12)
            assert tree.left[k] < 0 or (tree.start[tree.left[k]], tree.end[tree.left[k]], tree.end[tree.right[k]]) == (a, tree.start[tree.right[k]], b)
        entries = np.concatenate([rows[:10], rows[:5], rows[:9] + 1, generator.integers(-99, 99, (8, d))]).astype(np.int64)
        want, gap = brute_codes(rows, entries)
        again = anchors.Tree.from_bytes(tree.to_bytes())
        code, error = anchors.codes(again, entries)
        assert code.tolist() == want and error.tolist() == [row[k] for row, k in zip(gap, want, strict=True)]
        sums, counts = anchors.totals(again, entries)
        for k in range(len(entries)):
            own = rows[np.array(want) == k]
            assert counts[k] == len(own) and (sums[k] == own.sum(axis=0)).all()
        if n == 1500 and kind in ("clustered", "line"):
            taken = anchors.owners(tree, entries)[2]
            assert taken < len(tree.points) * len(entries) / 3


def expected(rows, parts=16, entries=64, rounds=2):
    kept = defaultdict(list)
    for vec, label, e in rows:
        if e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        width = max(parts, -(-len(e) // parts) * parts)
        kept[width].append((vec, label, [math.floor(256 * x) for x in e] + [0] * (width - len(e))))
    out, by_label = [], Counter()
    for width, own in kept.items():
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        step, code, error, books = width // parts, [[] for _ in own], [0] * len(own), []
        for p in range(parts):
            points = [tuple(r[2][p * step : (p + 1) * step]) for r in own]
            book = points[:entries]
            nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(book))
            for _ in range(rounds):
                at = [nearest(x, book)[1] for x in points]
                groups = [[x for x, k in zip(points, at, strict=True) if k == j] for j in range(len(book))]
                book = [tuple(sum(c) // len(g) for c in zip(*g, strict=True)) if g else y for g, y in zip(groups, book, strict=True)]
            for i, x in enumerate(points):
                gap, k = nearest(x, book)
                code[i].append(k)
                error[i] += gap
            books.append(book)
        digest = hashlib.sha256(",".join(str(c) for book in books for y in book for c in y).encode()).hexdigest()
        for r, c, x in zip(own, code, error, strict=True):
            out.append((r[0], "".join(f"{k:02x}" for k in c), x, r[1], digest))
            by_label[r[1]] += x
    return Counter((v, c, x, by_label[label], h) for v, c, x, label, h in out)


def vector(d=32):
    return [round(float(x), 3) for x in generator.normal(size=d)]


ROWS = [(k, k % 3 if k % 7 else None, vector()) for k in range(260)]
ROWS += [(k, 1, [0.5] * 32) for k in range(300, 420)] + [(k, 2, [round(x + 0.01, 3) for x in ROWS[k % 9][2]]) for k in range(420, 470)]
ROWS += [(500, 0, None), (501, 0, [1.0] * 31 + [None]), (502, 0, [math.nan] * 32), (503, 0, [math.inf] * 32), (None, 0, vector()), (None, None, vector()), ROWS[3], ROWS[3], (-9, 5, vector()), (3, 4, vector())]
OTHER = [(600 + k, k % 2, vector(48)) for k in range(5)] + [(610, 0, []), (611, 0, vector(17)), (612, None, [-0.0] * 20)]
SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("rows", [ROWS, ROWS + OTHER, OTHER, ROWS[:5]])
def test_codes_equal_brute_force(spark, rows, monkeypatch):
    vectors = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("code", "e", "width", "of", "trees")])
    assert Counter(map(tuple, vectorcodes.vector_codes(vectors.repartition(3)).collect())) == expected(rows)


def test_large_components_have_a_bound(spark):
    rows = [(k, 0, [1e30 * (-1) ** k, *vector(31)]) for k in range(70)]
    found = vectorcodes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
    bound = int((2.0**62 / 32) ** 0.5) // 2
    clipped = [(k, 0, [bound / 256 * (-1) ** k, *e[1:]]) for k, _, e in rows]
    assert Counter(map(tuple, found)) == expected(clipped)


def test_empty_table(spark):
    vectors = spark.createDataFrame(ROWS[:1], SCHEMA)
    assert vectorcodes.vector_codes(vectors.where("false")).collect() == []
    assert vectorcodes.vector_codes(spark.createDataFrame([(1, 1, None)], SCHEMA)).count() == 0
