"""Operators against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docquarry.llm import chat, lm, mixing, neighbours, packing, quality, records, sharding, simhash, winnow
from docquarry.llm.components import connected_components
from docquarry.llm.crc32c import masked_crc32c
from docquarry.llm.encode import encoder
from docquarry.llm.queries import TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
WORDS = ["the", "of", "Ready,", "stone.\nRiver", "ünder", "glass", "it's", "a", "17", "(well)", "日本", "north\n\nsouth", "x" * 30]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = text(6000)
ROWS = [(k, text(rng.randint(1, 60)), "en", rng.choice(["a", "a", "a", "b", None]), 0) for k in range(40)]
ROWS += [(40, None, "en", "a", 0), (41, "", "de", "b", 0), (42, LONG, "en", "c", 0), (43, LONG, "en", "c", 0), (44, "  two   spaces \n ", "en", "a", 0), (None, "no id here", "en", "a", 0)]
ROWS += [ROWS[3], ROWS[3]]  # repeated rows
CLASH = ["block", "rank", "print", "n", "score", "cell", "__doc", "tokens"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


PLAIN = Tokenizer.from_file(TOKENIZER)  # as the library gives it


def ids_of(t):
    return [*PLAIN.encode(t or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_a_plain_call(name):
    path = public_tokenizers.path(name)
    own, plain = encoder(path), Tokenizer.from_file(path)
    parts = [" ", "  ", "\n", "\n\n", "a", "Be", ".", "\t", "\xa0", "\u2003", "'s", "é", "×", "ß", "ª", "<|endoftext|>", "7", "42", "日", "\x1c", " \n", "\0", "--"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + [None, LONG]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert own.encode([]) == [] and own.encode([None, ""]) == [b"", b""]


def test_masked_checksums():
    crc32c = 0xE3069283  # of "123456789", from the standard
    assert masked_crc32c([b"123456789"])[0] == ((crc32c >> 15 | crc32c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    long = bytes(rng.randrange(256) for _ in range(3000))
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0x82F63B78 if k & 1 else 0)
        table.append(k)
    for part in (b"", b"a", b"abc", b"\0" * 8, long[:256], long[:257], long):
        c = 0xFFFFFFFF
        for b in part:
            c = table[(c ^ b) & 255] ^ c >> 8
        c ^= 0xFFFFFFFF
        assert masked_crc32c([long, part])[1] == ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_records_round_trip(spark, wide, empty, tmp_path):
    path = f"file://{tmp_path}/records"
    records.write_token_records(wide, path, TOKENIZER)
    rows = records.read_token_records(spark, path).collect()
    want = Counter((r[0], tuple(ids_of(r[1]))) for r in ROWS)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, *sorted(r[0] for r in ROWS if r[0] is not None)]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    shuffled = records.read_token_records(spark, path, shuffle_seed=3).collect()
    assert sorted(shuffled, key=lambda r: r["start"]) == rows and shuffled != rows
    damaged = next(p for p in (tmp_path / "records").glob("*.bin") if p.stat().st_size > 100)
    raw = bytearray(damaged.read_bytes())
    raw[40] ^= 1
    damaged.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        records.read_token_records(spark, path).collect()
    assert records.token_records(empty, TOKENIZER).count() == 0


def held_together(rows, capacity):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return docs, sequences


def test_packing(wide, empty):
    rows = packing.pack_documents(wide, TOKENIZER, 64, with_ids=True).collect()
    _, sequences = held_together(rows, 64)
    total = sum(len(ids_of(r[1])) for r in ROWS)
    assert total / 64 <= len(sequences) <= 1.05 * total / 64 + 2
    want = Counter()
    for r in ROWS:
        ids = ids_of(r[1])
        first = (len(ids) % 64 or 64) if len(ids) > 64 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want.update((r[0], k, a, b - a, crc(ids[a:b]), np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == want
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_best_fit_plan_covers_all_ranks():
    for _ in range(50):
        counts = {rng.randint(1, 40): rng.randint(1, 300) for _ in range(rng.randint(1, 15))}
        plan, filled, used = packing.best_fit_plan(counts, 40), defaultdict(list), defaultdict(list)
        for length, a, b, first, at in plan:
            used[length] += range(a, b)
            for k in range(b - a):
                filled[first + k].append((at, length))
        assert {k: sorted(v) for k, v in used.items()} == {k: [*range(n)] for k, n in counts.items()}
        for own in filled.values():
            assert [a for a, _ in sorted(own)] == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist() and sum(n for _, n in own) <= 40


def reach(n, links):
    root = [*range(n)]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(n)]


def test_components(spark):
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 520)] + [(600, 600 + k) for k in range(1, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: c for k, c in enumerate(reach(800, links)) if any(k in x for x in links if x[0] != x[1])}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_print(t):
    from xxhash import xxh64_intdigest

    w = (t or "").encode().lower().split()
    runs = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(wide, empty):
    rows = simhash.simhash_groups(wide).collect()
    prints = [slow_print(r[1]) for r in ROWS]
    root = reach(len(ROWS), [(a, b) for a in range(len(ROWS)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    least = {c: min((r[0] for r, k in zip(ROWS, root, strict=True) if k == c and r[0] is not None), default=None) for c in set(root)}
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(ROWS, prints, root, strict=True))
    assert simhash.simhash_groups(empty).count() == 0


def test_near_copies_stage_links_like_all_pairs(spark, monkeypatch):
    import corpus_pipeline

    g = random.Random(11)
    passage = [f"p{g.randrange(400)}" for _ in range(40)]
    rows, base = [], [[f"w{g.randrange(3000)}" for _ in range(g.randint(60, 160))] + passage for _ in range(25)]
    for b in base:
        rows.append(b)
        for _ in range(4):  # one to four edited words: likeness from about 0.75 to 0.95
            c = list(b)
            for _ in range(g.randint(1, 4)):
                c[g.randrange(len(c))] = f"n{g.randrange(10**6)}"
            rows.append(c)
    rows += [["One", "two"], ["one", "TWO"], [], []]
    for _ in range(80):  # one large group, by chains of edits
        c = list(rows[-1]) if len(rows) > 129 else [f"h{k}" for k in range(120)]
        c[g.randrange(len(c))] = f"n{g.randrange(10**6)}"
        rows.append(c)
    table = spark.createDataFrame([(k, " ".join(w), "en", "a", 0) for k, w in enumerate(rows)], DOCS)
    sets = []
    for w in (" ".join(w).lower().split() for w in rows):
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = reach(len(rows), alike)
    least = {}
    for k, r in enumerate(root):
        least.setdefault(r, k)
    assert len(alike) > 100
    kept = corpus_pipeline.near_duplicates(spark, table, "")
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    monkeypatch.setattr(simhash, "TILE", 4)  # many tiles of a cell, many keys
    monkeypatch.setattr(simhash, "TILE_BYTES", 4000)
    monkeypatch.setattr(simhash, "LANE", 2)
    grouped = defaultdict(set)
    for r in simhash.near_copy_groups(table).collect():
        grouped[r["component"]].add(r["doc_id"])
    wanted = defaultdict(set)
    for k, r in enumerate(root):
        wanted[r].add(k)
    assert sorted(map(sorted, grouped.values())) == sorted(map(sorted, wanted.values()))


def test_near_copies_stage_of_nulls_repeats_and_nothing(spark, wide, empty):
    assert simhash.without_near_copies(empty).count() == 0
    kept = simhash.without_near_copies(wide)
    assert kept.columns == wide.columns
    sets = {" ".join((r[1] or "").lower().split()): r for r in ROWS}
    assert kept.count() == len({t if len(t.split()) < 5 else frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in sets})
    assert [r for r in kept.collect() if r["doc_id"] is None and r["text"] == "no id here"]
    rows = [(5, text(50), "en", "a", 0), (5, "quite another text with other words", "en", "a", 0), (None, "alone without id", "en", "a", 0), (None, "alone without id", "en", "a", 0), (9, None, "en", "a", 0), (8, "", "en", "a", 0)]
    table = spark.createDataFrame([*rows, rows[0]], DOCS).withColumn("node", F.lit(1)).withColumn("__row", F.lit(2))
    got = Counter((r["doc_id"], r["text"]) for r in simhash.without_near_copies(table).collect())
    assert got == Counter({(r[0], r[1]): 1 for r in rows if r[0] != 9})


def test_simhash_links_like_all_pairs(spark):
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [p ^ 1 << rng.randrange(64) for p in base for _ in range(4)]
    dense = [base[0] ^ 1 << a ^ 1 << b for a in range(40) for b in range(40)]
    own = sorted({*base, *near, *dense})
    signed = [int(np.array(p, np.uint64).astype(np.int64)) for p in own]
    edges = simhash.linked_prints(spark.createDataFrame([(p,) for p in signed], "print long"), 2)
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    want = reach(len(own), [(a, b) for a in range(len(own)) for b in range(a) if (own[a] ^ own[b]).bit_count() <= 2])
    groups, wanted = defaultdict(set), defaultdict(set)
    for k, p in enumerate(signed):
        groups[got.get(p, p)].add(p)
        wanted[want[k]].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def slow_selection(t):
    if not t:
        return {}
    if len(t) < winnow.GRAM:
        return None
    mask, base, h = (1 << 64) - 1, int(winnow.BASE), []
    for k in range(len(t) - winnow.GRAM + 1):
        x = 0
        for c in t[k : k + winnow.GRAM]:
            x = x * base + ord(c) + 1 & mask
        with np.errstate(over="ignore"):
            h.append(int(winnow.mixed(np.array([x], np.uint64))[0] >> np.uint64(32)))
    found = {}
    for k in range(max(1, len(h) - winnow.WINDOW + 1)):
        own = h[k : k + winnow.WINDOW]
        at = max(j for j, x in enumerate(own) if x == min(own))
        found[k + at] = own[at]
    return found


def test_winnowing_selects_like_brute_force():
    texts = [text(rng.randint(1, 50)) for _ in range(20)] + ["", "abc", "a" * 200, "ab" * 40, "q" * 16, "日本" * 30]
    for t, (hashes, places) in zip(texts, winnow.selections(texts), strict=True):
        want = slow_selection(t)
        assert want is None and len(hashes) == 1 or dict(zip(places.tolist(), hashes.tolist(), strict=True)) == want
        back = winnow.read_fingerprint(winnow.shown((hashes, places)))
        assert back[0].tolist() == hashes.tolist() and back[1].tolist() == places.tolist()
    shared = text(30)
    a, b = winnow.selections([text(40) + shared + text(9), text(7) + shared + text(30)])
    assert {*a[0].tolist()} & {*b[0].tolist()}  # the match guarantee


def test_winnowing_of_edited_texts(spark, wide, empty, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 5)
    rows = winnow.edited_fingerprints(wide).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for r, following in zip(order, order[1:] + order[:1], strict=True):
        t, n = r[1] or "", following[1] or ""
        want[r[0], len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (42, 43)} == {r["fingerprint"] for r in rows if r["doc_id"] == 42}
    assert next(r["near_next"] for r in rows if r["doc_id"] == 42) == 1
    assert winnow.edited_fingerprints(empty).count() == 0
    alone = winnow.edited_fingerprints(spark.createDataFrame([(1, "abcdefgh", "", "", 0)], DOCS)).collect()
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_quality(spark, empty):
    good, bad = ["river", "stone", "meadow", "quiet"], ["zzq$$", "xxv%%", "buy!!"]
    rows = [(k, " ".join(rng.choice(good if k % 3 else bad) for _ in range(30)), "en", "a", 0) for k in range(400)]
    docs = spark.createDataFrame(rows + [(401, None, "", "", 0), (402, "", "", "", 0), (None, "river stone", "", "", 0), rows[0]], DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(300, None, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    unseen = [r for r in scored if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    assert sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in unseen) / len(unseen) > 0.95
    assert quality.quality_scores(empty, labels).count() == 0
    assert all(r["score"] == 0.5 for r in quality.quality_scores(docs, labels.limit(0)).collect() if not r["doc_id"] == -1)
    model = quality.train_on(docs, labels)
    kept = quality.accepted(docs.withColumn("score", F.lit("s")), model)
    assert kept.columns == [*docs.columns, "score"] and {r["score"] for r in kept.collect()} == {"s"}


def test_mixing_weights_and_blocks(spark, empty):
    rows = [(k, text(rng.randint(0, 9)), "", "big" if k % 10 < 7 else "mid" if k % 10 < 9 else None, 0) for k in range(300)]
    rows += [(400, "", "", "silent", 0), (None, "one two", "", "mid", 0), rows[1]]
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("__doc"), F.lit("b").alias("blocks"), F.lit("r").alias("range"))
    cost = lambda t: len((t or "").encode().split())
    total = sum(cost(r[1]) for r in rows)
    got = mixing.mix(docs, 0.99, 50.0, total).collect()
    tokens, taken = Counter(), Counter()
    for r in rows:
        tokens[r[3]] += cost(r[1])
    for r in got:
        taken[r["source"]] += cost(r["text"])
    weights = np.array([taken[s] for s in ("big", "mid", None)]) / total
    assert abs(-(weights * np.log(weights)).sum() / np.log(3) - 0.99) < 0.02 and taken.total() <= total
    blocks = defaultdict(Counter)
    for r in got:
        blocks[r["source"], r["mix_block"]][r["doc_id"], r["text"]] += 1
    for source in ("big", "mid", None):
        whole = Counter((r[0], r[1]) for r in rows if r[3] == source)
        own = [blocks[source, k] for k in sorted(k for s, k in blocks if s == source)]
        assert all(b == whole for b in own[:-1]) and not own[-1] - whole
    assert blocks["silent", 0] == {(400, ""): 1}
    assert all(0 <= r["mix_key"] <= 1.5 for r in got)
    assert mixing.mix(docs, 0.99, 1.2).columns == [*docs.columns, "mix_block", "mix_key"]
    covered = mixing.mix(docs, 0.99, 1.2).groupBy("source").agg(F.countDistinct("doc_id").alias("n"), F.max("mix_block").alias("b")).collect()
    assert {r["source"]: r["n"] for r in covered} == {s: len({r[0] for r in rows if r[3] == s and r[0] is not None}) for s in tokens} and max(r["b"] for r in covered) <= 1
    assert mixing.mix(empty, 0.9, 2.0, 10).count() == 0


def brute_links(rows):
    n, links = len(rows), []
    unit = [None if e is None or label is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e) else np.array(e) / np.linalg.norm(e) for _, label, e in rows]
    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links.append((a, b))
    return links


def test_near_vectors(spark):
    g = np.random.default_rng(3)
    centres = g.standard_normal((30, 16))
    rows = [(int(k), int(k % 2), [*map(float, np.float32(centres[k % 30] * g.uniform(1, 2) + g.standard_normal(16) * (0.03 if k % 3 else 1)))]) for k in range(300)]
    rows += [(300 + k, 1, [*map(float, np.float32(centres[0] + g.standard_normal(16) * 0.02))]) for k in range(60)]  # one crowded group
    rows += [(500 + k, 1, rows[1][2]) for k in range(20)]  # copies
    rows += [(600, 0, None), (601, None, rows[0][2]), (602, 0, [0.0] * 16), (603, 0, []), (604, 0, [float("nan")] * 16), (605, 0, [1.0, None] * 8), (606, 0, [1.0, 2.0]), (607, 0, [1.0, 2.0]), (None, 0, rows[0][2])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("node", F.lit("x"))
    got = neighbours.near_vectors(table).collect()
    links = brute_links(rows)
    root = reach(len(rows), links)
    degree = Counter(k for x in links for k in x)
    least = {c: min((r[0] for r, k in zip(rows, root, strict=True) if k == c and r[0] is not None), default=None) for c in set(root)}
    want = Counter((r[0], degree[k], least[root[k]], r[0] is not None and r[0] == least[root[k]]) for k, r in enumerate(rows))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert neighbours.near_vectors(table.limit(0)).count() == 0


def test_near_vectors_between_dense_groups(spark):
    """Two groups that fill all lists with their own; of the links between them none is in a list."""
    g = np.random.default_rng(8)
    axis = np.eye(24)
    angle = np.arccos(0.985)
    rows = []
    for centre in (axis[0], np.cos(angle) * axis[0] + np.sin(angle) * axis[1]):
        rows += [(len(rows) + k, 0, [*map(float, np.float32(centre + g.standard_normal(24) * 0.004))]) for k in range(40)]
    rows = [(k, label, e) for k, (_, label, e) in enumerate(rows)]
    want = Counter(k for x in brute_links(rows) for k in x)
    got = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {k: (want[k], 0) for k in range(len(rows))}
    assert min(want.values()) > 39  # links beyond the own group


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|start|>user\nhi<|end|>\n", "<\\s> <\\\\s> <s>", "[INST][\\INST]", "<<SYS>> a <</SYS>>", "", None, "ünï\ncode 日本", "\\", "<|end|", "<|im_end|>"]
    rows = [(k, j, ["user", "assistant", None, "sys\\tem"][j % 4], odd[(k + j) % len(odd)]) for k in range(15) for j in range(1 + k % 5)]
    rows += [(99, 1, "user", "tie b"), (99, 1, "user", "tie a"), (99, 1, "user", "tie a"), (None, 0, "assistant", "null tree")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    got = {r["conv_id"]: r for r in chat.chat_digests(table).collect()}
    by = defaultdict(list)
    for c, t, role, said in rows:
        by[c].append((t, role or "", said or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
    assert chat.chat_digests(table.limit(0)).count() == 0


def test_reply_trees(spark):
    tree = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.5), ("t", 5, 4, "assistant", "end", 0.8), ("t", 6, 4, "assistant", "end2", 0.7), ("t", 7, 70, "user", "orphan", 0.0), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0)]
    df = spark.createDataFrame(tree, "tree string, node long, parent long, role string, text string, score double")
    said = {(r["tree"], r["leaf"]): [(t["role"], t["text"]) for t in r["turns"]] for r in chat.format_trees(df).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert said == {("t", 2): [("user", "q"), ("assistant", "bad")], ("t", 5): [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")], ("t", 6): [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end2")], ("t", 7): [("user", "orphan")]}
    best = chat.format_trees(df, best=1).select("leaf", chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    assert [(r["leaf"], r["loss"]) for r in best] == [(5, ["good", "end"])]


def test_sharding(spark, wide, empty):
    rows = [(k, "x" * rng.randint(0, 300), "", "", 0) for k in range(200)] + [(500, "y" * 5000, "", "", 0)] + [(7, "z" * 100, "", "", 0)] * 60 + [(None, None, "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("cell", F.lit("c"))
    got = sharding.extendible_shards(docs, 2000, columns=("doc_id", "text", "cell")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    sizes, counts = Counter(), Counter()
    for r in got:
        assert len(r["shard"]) == r["depth"]
        sizes[r["shard"]] += r["n_bytes"]
        counts[r["shard"]] += 1
    assert all(n <= 2000 or counts[s] == 1 for s, n in sizes.items()) and all(sizes[r["shard"]] == r["shard_bytes"] for r in got)
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)  # a prefix code
    bits = {r[0]: bin(int(hashlib.md5(str(r[0] if r[0] is not None else "").encode()).hexdigest()[:15], 16))[2:].zfill(60) for r in rows}
    for r in got:
        assert bits[r["doc_id"]].startswith(r["shard"][:60])
        if 0 < r["depth"] <= 60:  # its parent was too large
            parent = r["shard"][:-1]
            own = [x for x in rows if bits[x[0]].startswith(parent)]
            assert len(own) > 1 and sum(len(x[1] or "") for x in own) > 2000
    path = sharding.write_shards(wide, 4000)
    back = spark.read.parquet(path).drop("__shard")
    digest = lambda df: Counter((r["doc_id"], r["shard"], r["depth"], r["n_bytes"], r["shard_bytes"]) for r in df.collect())
    assert digest(sharding.read_shards(spark, path)) == digest(sharding.extendible_shards(wide, 4000))
    assert sharding.read_shards(spark, sharding.write_shards(empty, 100)).count() == 0
    assert Counter(map(tuple, back.select(*wide.columns).collect())) == Counter(map(tuple, wide.collect()))
    assert sharding.extendible_shards(empty, 100).count() == 0


def test_language_scores(spark, wide, empty):
    import math

    got = lm.language_scores(wide, lm.is_held_out(F.col("doc_id"))).collect()
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for r in ROWS if not held(r[0]) for w in words(r[1]))
    n, v = counts.total(), len(counts)
    want = Counter()
    for r in ROWS:
        own = words(r[1])
        want[r[0], held(r[0]), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    # the scores by dictionaries, the weights from leave-one-out counts of each training token
    pairs, cells = Counter(), defaultdict(lambda: [0, 0.0, 0.0])
    trained = [words(r[1]) for r in ROWS if not held(r[0])]
    for own in trained:
        pairs.update(zip([b"\n", *own], own, strict=False))
    step = lambda p: round(lm.STEPS * math.log2(p)) + 1000 if p > 0 else 0
    level = lambda c: min(int(math.log2(c)) + 1, lm.LEVELS - 1) if c > 0 else 0
    for own in trained:
        for h, w in zip([b"\n", *own], own, strict=False):
            context = counts[h] - 1
            p1, p2 = (counts[w] - 1) / (n - 1), (pairs[h, w] - 1) / max(context, 1)
            cell = cells[level(context), step(p2), step(p1)]
            cell[:] = cell[0] + 1, cell[1] + p2, cell[2] + p1
    weights = lm.fit_weights(np.array([(k[0], c, p2 / c, p1 / c, 1 / (v + 1)) for k, (c, p2, p1) in sorted(cells.items())]))
    score = defaultdict(set)
    for r in ROWS:
        own = words(r[1])
        p = [weights[level(counts[h])] @ (pairs[h, w] / max(counts[h], 1), counts[w] / n, 1 / (v + 1)) for h, w in zip([b"\n", *own], own, strict=False)]
        score[r[0]].add(sum(map(math.log10, p)))
    assert all(min(abs(r["score"] - x) for x in score[r["doc_id"]]) < 1e-4 * max(1, abs(r["score"])) for r in got)
    assert lm.language_scores(empty, F.lit(False)).count() == 0
    nothing = lm.language_scores(wide.where("doc_id < 5"), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in nothing)


def test_fit_weights_follow_the_better_estimate():
    cells = np.array([(1, 90.0, 0.5, 0.001, 0.0001), (1, 10.0, 0.0, 0.001, 0.0001), (3, 100.0, 0.0, 0.2, 0.0001)])
    w = lm.fit_weights(cells)
    assert w[1][0] > 0.7 and w[3][1] > 0.9 and np.allclose(w.sum(axis=1), 1)


def test_tokenizer_is_not_copied():
    assert TOKENIZER == public_tokenizers.path("byte_bpe_50k.json")
