"""Edits re-make texts, alignment and consumption equal plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.functions import edits
from docquarry.operators import alignment

rng = random.Random(12)


def text(n, letters="abcde 日"):
    return "".join(rng.choice(letters) for _ in range(n))


def changed(t, times):
    for _ in range(times):
        k, n = rng.randint(0, len(t)), rng.randint(0, 12)
        t = t[:k] + text(rng.randint(0, 12)) + t[k + n :]
    return t


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, e in enumerate(b):
            new.append(row[j] + 1 if c == e else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_scripts_remake_texts():
    pairs = [("", ""), ("", "x"), ("x", ""), ("abc", "abc"), ("a" * 3000, "a" * 2500), (text(4000), text(4000))]
    pairs += [(t := text(rng.randint(0, 60)), changed(t, rng.randint(0, 5))) for _ in range(60)]
    pairs += [(t := text(20_000), changed(t, 40)) for _ in range(3)] + [(text(9000, "ab"), text(9000, "ab"))]
    for a, b in pairs:
        script = edits.edit_script(a, b)
        assert edits.applied(a, script) == b
        blocks = edits.matching_blocks(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks) and blocks == sorted(blocks)
        kept = sum(n for _, _, n in blocks)
        if len(a) * len(b) <= 4000:
            assert kept == longest_common(a, b)
        if len(a) == 20_000:
            assert kept > 19_000 and len(script) < 200


def test_edits_of_a_table(spark):
    rows = [(k, t := text(rng.randint(0, 300)), changed(t, 3)) for k in range(40)] + [(40, None, "x"), (41, "x", None), (42, None, None), (43, text(50_000), text(10))]
    df = alignment.with_edits(spark.createDataFrame(rows, "k long, a string, b string"), "a", "b")
    made = alignment.remade(alignment.remade(df, "a", "edits", True, "forth"), "b", "edits", False, "back").collect()
    assert {r["k"]: (r["forth"], r["back"]) for r in made} == {k: (b or "", a or "") for k, a, b in rows}


def plain_consumed(units, whole):
    used, out = [False] * len(whole), []
    for unit, low, high in units:
        missing, i = [], 0
        while i < len(unit):
            best, where = 0, None
            for c in range(low, high):
                n = 0
                while i + n < len(unit) and c + n < high and unit[i + n] == whole[c + n] and not used[c + n]:
                    n += 1
                if n > best:
                    best, where = n, c
            if best >= min(6, len(unit) - i):
                used[where : where + best] = [True] * best
                i += best
            else:
                missing.append(i)
                i += 1
        out.append(missing)
    return out


def test_consumption_equals_a_loop():
    for _ in range(80):
        whole = text(rng.randint(0, 120), "abc")
        units = []
        for _ in range(rng.randint(0, 6)):
            low = rng.randint(0, len(whole))
            k = rng.randint(0, max(0, len(whole) - 1))
            units.append((changed(whole[k : k + rng.randint(1, 40)], rng.randint(0, 1)), low if rng.random() < 0.5 else 0, len(whole)))
        got = alignment.consumed(units, whole)
        assert [[k for a, b in own for k in range(a, b)] for own in got] == plain_consumed(units, whole)


def plain_aligned(units, pages):
    six = lambda t: {t[k : k + 6] for k in range(len(t) - 5)}
    goods = []
    for t in units:
        hits = {p: (len(six(t) & six(x)) if len(t) >= 6 else int(t in x)) for p, x in pages.items()}
        top = max(hits.values(), default=0)
        goods.append(sorted(p for p, n in hits.items() if n and n >= 0.8 * top))
    out = []
    for k, good in enumerate(goods):
        before = next((g[0] for g in reversed(goods[:k]) if len(g) == 1), min(pages, default=0))
        after = next((g[0] for g in goods[k + 1 :] if len(g) == 1), max(pages, default=0))
        near = [p for p in good if min(before, after) - 1 <= p <= max(before, after) + 1]
        out.append(near or good)
    return out


def test_alignment_equals_a_loop(spark):
    docs = []
    for _ in range(15):
        lines = [text(rng.choice([3, 5, 20, 60]), "abcdefgh") for _ in range(12)]
        lines += [lines[2], "stamp", lines[4]]
        whole = "".join(lines)
        docs.append((lines, {k: whole[80 * k : 80 * k + 80] for k in range(-(-len(whole) // 80))}))
    units = spark.createDataFrame([(d, k, t) for d, (lines, _) in enumerate(docs) for k, t in enumerate(lines)], "doc long, unit int, text string")
    pages = spark.createDataFrame([(d, p, t) for d, (_, own) in enumerate(docs) for p, t in own.items()], "doc long, page int, text string")
    got = {(r["doc"], r["unit"]): r["pages"] for r in alignment.aligned(units, pages).collect()}
    assert got == {(d, k): x for d, (lines, own) in enumerate(docs) for k, x in enumerate(plain_aligned(lines, own))}


def test_verdicts(spark):
    body = [text(70, "abcdefgh") for _ in range(30)]
    cases = {
        1: ("\n".join(body), "".join(body), "faithful"),
        2: ("\n".join([*body, "call 555 now"]), "".join(body), "review"),
        3: ("\n".join([*body, body[3]]), "".join(body), "edges"),  # one copy does not stand for two
        4: ("\n".join([*body[:5], "zzzzzzzzzz" + body[5]]), "".join(body), "edges"),
        5: ("\n".join([*body[:5], body[5][:30] + "zzzzzzzzzz" + body[5][30:]]), "".join(body), "review"),
        6: ("\n".join(body), None, "edges"),
    }
    docs = spark.createDataFrame([(k, a, b) for k, (a, b, _) in cases.items()], "doc long, a string, b string")
    units = docs.select("doc", F.posexplode(F.split("a", "\n")).alias("unit", "text"))
    pages = docs.where("b is not null").select("doc", F.explode(F.sequence(F.lit(0), (F.length("b") / 500).cast("int"))).alias("page"), "b").select("doc", "page", F.substr("b", F.col("page") * 500 + 1, F.lit(500)).alias("text"))
    got = {r["doc"]: r for r in alignment.fidelity(units, pages).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {k: v for k, (_, _, v) in cases.items()}
    assert got[2]["digits"] == 1 and got[3]["missing"] == 70 and got[1]["missing"] == 0 and got[6]["missing"] == got[6]["chars"]
    assert alignment.fidelity(units.where("false"), pages).count() == 0
