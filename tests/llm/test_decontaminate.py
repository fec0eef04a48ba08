"""Operator 13 against plain searches."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import decontaminate, fmindex
from docquarry.llm.queries import contamination_digests

rng = random.Random(8)
WORDS = ["a", "B", "c3", "été", "d", "日本"]
PIECES = [" ", ", ", "\n", "-", "_", "."]


def text(n, words=WORDS):
    return "".join(rng.choice(words) + rng.choice(PIECES) for _ in range(n))


ITEMS = [(k, text(rng.randint(1, 30))) for k in range(60)] + [(60, None), (61, ""), (62, "..."), (None, "a b c3 d a b c3 d a b c3"), (63, text(4, ["only"])), (5, "été été"), (100, "zz"), (7, "zz"), (3, "a b")]
ITEMS += [(200 + k, ITEMS[4][1].upper().replace("É", "é")) for k in range(30)] + [ITEMS[2]] * 3
OTHER = [*WORDS, "other", "words", "zz"]
DOCS = [(k, text(rng.randint(0, 60), OTHER)) for k in range(150)] + [(150, None), (151, ""), (152, "--"), (None, ITEMS[8][1])]
DOCS += [(153 + k, text(5, OTHER) + ITEMS[k][1].upper().replace("É", "é") + text(5, OTHER)) for k in range(20)] + [(180, text(30_000)), (181, "a " * 20_000), (182, ITEMS[9][1]), (182, ITEMS[9][1])]


def plain_words(t):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, window=10):
    phrases = {}
    for item, t in items:
        w = plain_words(t)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[a : a + window]), set()).add("" if item is None else str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for doc, t in docs:
        w = plain_words(t)
        hit, ids = [False] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if own := phrases.get(tuple(w[a : a + n])):
                    hit[a : a + n] = [True] * n
                    ids |= own
        out.append((doc, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(hit)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    clash = [F.lit("x").alias(c) for c in ("items", "spans", "n_words", "row")]
    return spark.createDataFrame(DOCS, "doc_id long, text string").select("*", *clash), spark.createDataFrame(ITEMS, "item_id long, text string").select("*", *clash)


@pytest.mark.parametrize("group_words", [500_000, 500])
def test_hits_equal_a_plain_search(tables, group_words):
    got = contamination_digests(decontaminate.contamination(*tables, group_words=group_words)).collect()
    assert Counter(map(tuple, got)) == Counter(expected(DOCS, ITEMS))
    assert 20 < sum(r["contaminated"] for r in got) < len(got)


def test_shards_change_nothing(tables, monkeypatch):
    long_items = [(k, t) for k, t in ITEMS if len(plain_words(t)) > 4]
    phrases = decontaminate.phrases_of([(str(k), t) for k, t in long_items], 5)
    texts = [t for _, t in DOCS]
    counts, doc, own, first, size = decontaminate.searched(texts, phrases)
    want = expected(DOCS, long_items, 5)
    ends = np.cumsum(counts)
    hits = np.bincount(np.searchsorted(ends, first, side="right"), weights=size, minlength=len(texts))
    assert counts.tolist() == [w[1] for w in want] and hits.tolist() == [w[2] for w in want]
    for k in range(0, len(texts), 7):
        alone = decontaminate.searched([texts[k]], phrases)
        assert alone[4].sum() == want[k][2]


def test_texts_without_their_spans(tables):
    found = decontaminate.contamination(*tables)
    for r, s in zip(found.collect(), decontaminate.without_spans(found).collect(), strict=True):
        t = r["text"]
        places = [m.start() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        kept, at = "", 0
        for span in r["spans"]:
            assert places.index(span["start"]) == span["word"] and len(plain_words(t[span["start"] : span["end"]])) == span["words"]
            kept, at = kept + t[at : span["start"]], span["end"]
        assert s["text"] == (kept + t[at:] if r["spans"] else t)


def test_empty_tables(tables):
    docs, items = tables
    none = contamination_digests(decontaminate.contamination(docs, items.where("false"))).collect()
    assert len(none) == len(DOCS) and not any(r["contaminated"] for r in none) and {r["n_items"] for r in none} == {0}
    assert decontaminate.contamination(docs.where("false"), items).count() == 0


@pytest.mark.parametrize("largest", [1, 2, 5, 5000])
def test_index(largest):
    generator = np.random.default_rng(largest)
    for n in (1, 2, 70, 900):
        t = generator.integers(0, largest + 1, n).astype(np.int32)
        if n == 900:
            t[100:500] = t[500:900]
            t[:60] = 1
        t[-1] = 0
        ended = lambda k: (t[k:][: np.flatnonzero(t[k:] == 0)[0]].tolist(), k + int(np.flatnonzero(t[k:] == 0)[0]))  # noqa: B023, E731
        assert fmindex.suffix_order(t, largest).tolist() == sorted(range(n), key=lambda k: ended(k) and (ended(k)[0], ended(k)[1]))  # noqa: B023
        index = fmindex.FMIndex(t, largest)
        patterns = [p for a in range(0, n, 3) for m in (1, 2, 4, 20) if 0 not in (p := t[a : a + m].tolist())] + [[largest] * 3]
        laid = np.zeros((len(patterns), 20), np.int32)
        for k, p in enumerate(patterns):
            laid[k, : len(p)] = p
        low, high = index.find(laid, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(n) if t[k : k + len(p)].tolist() == p]
