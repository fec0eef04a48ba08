"""Operator 7: magnitudes, enlarged lists, the audit and what follows a failed one."""

from collections import Counter

import numpy as np
import pytest

from docquarry.llm import neighbours as nb

SCHEMA = "vec_id long, label int, embedding array<double>"


def degrees(rows):
    v = np.array([e for _, _, e in rows])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([x for _, x, _ in rows])
    return ((v @ v.T >= 0.98) & (label[:, None] == label)).sum(axis=1) - 1


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(11)
    centres = g.standard_normal((60, 32))
    out = [(k, k % 2, [*map(float, centres[k // 2 % 60] + g.standard_normal(32) * (0.05 if k < 600 else 2))]) for k in range(900)]
    return out + [(900 + k, 1, [*map(float, centres[7] + g.standard_normal(32) * 0.03)]) for k in range(130)]


def test_lists_find_all_links(spark, rows):
    got = {r["vec_id"]: r["n_links"] for r in nb.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = degrees(rows)
    assert [got[k] for k in range(len(rows))] == want.tolist() and want.max() > 100  # more than the longest list


def test_audit_and_what_follows_it(spark, rows):
    weak = nb.Settings(size=1, most=1, tables=1, rounds=0, tries=0, tile=1, goal=1.0, audited=2000)
    nodes = nb.nodes_of(spark.createDataFrame([r for r in rows if r[0] < 600], SCHEMA))
    least = {r["node"]: r["least"] for r in nodes.collect()}
    want = degrees([r for r in rows if r[0] < 600])
    lists = nb.descend(nodes, None, weak)
    edges = nb.exact_edges(nodes, lists, weak)
    found = Counter(least[x] for r in edges.collect() for x in (r["a"], r["b"]))
    counted = spark.createDataFrame([(node, found[k]) for node, k in least.items()], "node long, n_links long")
    audit = nb.recall_by_degree(nodes, counted, weak)
    assert sum(x for x, _ in audit.values()) == sum(found.values()) < sum(x for _, x in audit.values()) == want.sum()
    _, exact, audits = nb.audited_links(nodes, nb.Settings(size=2, most=2, tables=1, rounds=0, tries=0, goal=1.1, audited=2000))
    assert len(audits) == 1 and {least[r["node"]]: r["n_links"] for r in exact.collect()} == {k: n for k, n in enumerate(want.tolist()) if n}


def test_magnitudes(spark):
    g = np.random.default_rng(2)
    base = g.standard_normal((6, 8))
    rows = [(10 * k + j, 0, [*map(float, (base[k] + g.standard_normal(8) * 0.01) * 10.0 ** scale)]) for k in range(6) for j, scale in enumerate((0, 200, -200, 307, -300))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nb.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: (4, r[0] // 10 * 10) for r in rows}
