"""Scores of the quality classifier and likeness of fingerprints, against plain loops over every feature, gram and window."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import quality, winnow

rng = random.Random(9)
MASK, BASE = (1 << 64) - 1, int(quality.BASE)
TEXTS = [None, "", " \t\n", "a", "a a a", "River river RIVER stone", "ÄRGER ärger 😀 b", "$$$ $$$ buy!! buy!!", *[" ".join(rng.choice(["is", "of", "the", "zz", "Öl", "x" * 40]) for _ in range(rng.randint(1, 300))) for _ in range(12)]]


def buckets_of(word: bytes, settings: quality.Settings) -> list[int]:
    code = [c + 1 for c in b"<" + word + b">"]
    hashes = [sum(c * pow(BASE, k + 1, MASK + 1) for k, c in enumerate(code)) & MASK]
    for n in settings.grams:
        for k in range(len(code) - n + 1):
            h = n
            for c in code[k : k + n]:
                h = (h * BASE + c) & MASK
            hashes.append(h)
    return [((((h ^ (h >> 32)) * BASE & MASK) >> 40) % (settings.buckets - 1)) + 1 for h in hashes]


def plain_score(model: quality.Model, text: str | None) -> float:
    words = (text or "").encode().lower().split()
    values = [model.weights[b] for w in words for b in buckets_of(w, model.settings)]
    values += [model.weights[quality.REPEATED] for a, b in zip(words, words[1:], strict=False) if a == b]
    return 1 / (1 + math.exp(-((sum(values) / len(values) if values else 0.0) + model.bias)))


@pytest.mark.parametrize("buckets, grams", [(1 << 10, (3, 4, 5)), (17, (2,)), (1 << 18, (3, 4, 5))])
def test_scores_are_plain_means_of_features(buckets, grams):
    settings = quality.Settings(buckets=buckets, grams=grams)
    model = quality.Model(np.random.default_rng(1).normal(0, 2, buckets), 0.3, settings)
    assert np.allclose(model.scores(TEXTS), [plain_score(model, t) for t in TEXTS], rtol=1e-10)


def test_trained_scores_are_plain_means_too(spark):
    rows = [(k, t, "", "", 0) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(TEXTS))], "doc_id long, quality int")
    model = quality.train_on(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    assert all(abs(got[k] - plain_score(model, t)) < 1e-9 for k, t in enumerate(TEXTS)) and len(set(got.values())) > 5


def plain_selection(text: str) -> set[int]:
    """The hashes that windows select: the least, the rightmost of equal ones."""
    base, size = int(winnow.BASE), winnow.GRAM
    short = len(text) < size
    grams = [text] if short else [text[k : k + size] for k in range(len(text) - size + 1)]
    hashes = []
    for g in grams if text else []:
        h = len(g) if short else 0
        for c in g:
            h = (h * base + ord(c) + (0 if short else 1)) & MASK
        hashes.append(int(winnow.mixed(np.array([h], np.uint64))[0] >> np.uint64(32)))
    return {min(hashes[k : k + winnow.WINDOW]) for k in range(max(1, len(hashes) - winnow.WINDOW + 1)) if hashes}


def plain_likeness(a: set[int], b: set[int]) -> float:
    return float(a == b) if not a or not b else 2 * len(a & b) / (len(a) + len(b))


def test_likeness_of_edited_and_next_texts(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 4)  # neighbours meet across ranges too
    words = ["alpha", "beta", "gamma", "delta", "ö😀", "the"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 8, 40, 200]))) for _ in range(40)]
    texts[7] = texts[8] = "same text " * 30
    texts[12] = texts[13] = None
    texts[20] = texts[19] + " and a little more of it"
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, strict=True)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in winnow.edited_fingerprints(docs.withColumn("span", F.lit("x"))).collect()}
    own = [t or "" for t in texts]
    for k, t in enumerate(own):
        following = own[(k + 1) % len(own)]
        cut = len(t) // 4
        changed = t[: len(t) - cut] + following[:cut]
        assert abs(got[k]["near_edited"] - plain_likeness(plain_selection(t), plain_selection(changed))) < 1e-12, k
        assert abs(got[k]["near_next"] - plain_likeness(plain_selection(t), plain_selection(following))) < 1e-12, k
    assert got[7]["near_next"] == got[12]["near_next"] == 1 and 0.5 < got[19]["near_next"] <= 1
