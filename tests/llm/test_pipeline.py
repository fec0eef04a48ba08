"""The pipeline's stages and run() on small tables with nulls, repeats, clashing ids and columns, and without rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docquarry.llm import mixing, quality

g = random.Random(4)
GOOD, BAD = [f"word{k}" for k in range(300)], ["zzq$$", "buy!!", "xxv%%"]


def words(own, n):
    return " ".join(g.choice(own) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(k, words(BAD if k % 5 == 0 else GOOD, 40), "en", g.choice(["big", "big", "big", "small"]), 0) for k in range(150)]
    base = rows[1][1].split()
    rows += [(200 + k, " ".join(base[:-1] + [f"new{k}"]), "en", "big", 0) for k in range(5)]  # near copies
    rows += [(300, rows[2][1], "en", "small", 0), (300, words(GOOD, 30), "en", None, 0), rows[3], (None, words(GOOD, 25), "en", "big", 0), (310, None, "en", "big", 0), (311, "", "en", "big", 0), (312, words(GOOD, 3000), "en", "big", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit("x") for c in ("score", "node", "block", "rank")}).write.parquet(f"file://{path}/documents.parquet")
    labels = [(k, int(k % 5 > 0), 0) for k in range(120)] + [(None, 1, 0), (7, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", rows


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def test_stages_and_run(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality", "near_duplicates", "mixing", "packing"]

    kept = stages["quality"](spark, docs, path)
    assert kept.columns == docs.columns
    model = quality.train_on(docs, spark.read.parquet(f"{path}/labels.parquet"))
    accepted = [r for r, s in zip(rows, model.scores([r[1] for r in rows]), strict=True) if s >= corpus_pipeline.ACCEPTED_SCORE]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((r[0], r[1]) for r in accepted)
    assert not any(r[0] is not None and r[0] < 150 and r[0] % 5 == 0 for r in accepted) and sum(r[0] is not None and r[0] < 150 for r in accepted) >= 118

    left = stages["near_duplicates"](spark, kept, path)
    assert left.columns == docs.columns
    sets, root = [shingles(r[1]) for r in accepted], [*range(len(accepted))]
    for a in range(len(accepted)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if k in (x, y) else k for k in root]
    groups = defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(accepted[k])
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    order = lambda r: (r[0] is None, r[0] or 0)
    for own in groups.values():
        least = min(map(order, own))
        assert sum(got[t] for t in {(r[0], r[1]) for r in own}) == 1 == sum(got[t] for t in {(r[0], r[1]) for r in own if order(r) == least})
    assert got.total() == len(groups) and any(len(own) > 2 for own in groups.values())
    assert (300, rows[2][1]) not in got and (300, rows[156][1]) in got  # the copy of 2 goes, the other text of that id stays

    mixed = stages["mixing"](spark, left, path)
    assert mixed.columns == docs.columns
    times = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert times.keys() == got.keys()
    tokens, taken = Counter(), Counter()
    source = {(r[0], r[1]): r[3] for r in rows}
    for t, n in got.items():
        tokens[source[t]] += n * len((t[1] or "").split())
    for t, n in times.items():
        taken[source[t]] += n * len((t[1] or "").split())
    assert all(tokens[s] <= taken[s] <= corpus_pipeline.MOST_REPEATS * tokens[s] + 1 for s in tokens)
    assert mixing.mix(left, corpus_pipeline.ENTROPY_SHARE, corpus_pipeline.MOST_REPEATS).count() == times.total()

    placed = corpus_pipeline.run(spark, path).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for (doc, text), n in times.items():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == want
    sequences = defaultdict(list)
    for r in placed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= corpus_pipeline.SEQUENCE_TOKENS


def test_no_documents(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
