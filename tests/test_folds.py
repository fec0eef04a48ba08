"""Decisions on types folded one after another, and headings by a stack, against loops."""

import random

from pyspark.sql import functions as F

from docquarry.operators.taxonomy import current_types, heading_paths, since_when

rng = random.Random(9)


def history(n_types, n_notes, n_decisions):
    notes = {k: f"p{rng.randrange(n_types)}" for k in range(n_notes)}
    live, steps, parts, accepted, since, now = {f"p{k}" for k in range(n_types)}, [], [], [], {}, dict(notes)
    for at in range(n_decisions):
        op = rng.choice(["accept", "merge", "merge", "split", "reject"])
        refs = rng.sample(sorted(live), min(len(live), 1 if op != "merge" else 2))
        if not refs:
            break
        live -= set(refs)
        old = min([since[r] for r in refs if r in since], default=at)
        if op == "reject":
            steps += [(r, None) for r in refs]
            now = {k: None if t in refs else t for k, t in now.items()}
        elif op == "split":
            names = [f"t{at}-0", f"t{at}-1"]
            for k, t in now.items():
                if t == refs[0]:
                    now[k] = names[rng.randrange(2)]
                    parts.append((refs[0], k, now[k]))
            used = {into for r, _, into in parts if r == refs[0]}
            live |= used
            for x in used:
                accepted.append((x, at))
                since[x] = old
        else:
            new = f"t{at}"
            live.add(new)
            accepted.append((new, at))
            since[new] = old
            steps += [(r, new) for r in refs]
            now = {k: new if t in refs else t for k, t in now.items()}
    return notes, steps, parts, accepted, now, since


def test_types_after_all_decisions(spark):
    for seed in range(3):
        rng.seed(seed)
        notes, steps, parts, accepted, now, since = history(12, 60, 25)
        tables = [spark.createDataFrame(rows, schema) for rows, schema in ((list(notes.items()), "note long, type string"), (steps, "ref string, into string"), (parts, "ref string, note long, into string"), (accepted, "type string, at long"))]
        got = {r["note"]: r["type"] for r in current_types(*tables[:3]).collect()}
        assert got == now
        links = tables[1].unionByName(tables[2].select("ref", "into").distinct())
        assert {r["type"]: r["since"] for r in since_when(tables[3], links).collect()} == since


def test_headings_at_any_depth(spark):
    docs = [(k, [rng.choice([None, 1, 2, 3, 5, 9]) for _ in range(rng.randint(0, 30))]) for k in range(20)] + [(20, None)]
    got = {(r["doc_id"], r["at"]): r["path"] for r in heading_paths(spark.createDataFrame(docs, "doc_id long, levels array<int>").withColumn("path", F.lit("x")), "levels").collect()}
    want = {}
    for k, levels in docs:
        for i in range(len(levels or ())):
            want[k, i] = [h for h in range(i + 1) if levels[h] is not None and not any(levels[j] is not None and levels[j] <= levels[h] for j in range(h + 1, i + 1))]
    assert got == want
