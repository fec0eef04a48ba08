"""The store computes what is missing, refuses other values, and reads only what its manifest vouches for."""

import pytest
from pyspark.sql import functions as F

from docquarry.operators.retrieval import exact_cosine
from docquarry.sources.cache import Store, StoreError, recomputed


@pytest.fixture
def store(tmp_path):
    return Store(f"file://{tmp_path}/store")


def test_only_missing_inputs_are_computed(spark, store):
    seen = []

    def compute(inputs):
        seen.append(sorted(r["t"] or "" for r in inputs.collect()))
        return inputs.select("input_key", F.length(F.coalesce("t", F.lit(""))).alias("n"))

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "k int, t string")
    out, counts = recomputed(rows, ["t"], compute, "v1", store)
    assert sorted((r["k"], r["n"], r["reused"]) for r in out.collect()) == [(1, 1, False), (2, 2, False), (3, 1, False), (4, 0, False)] and counts == {"asked": 3, "computed": 3}
    more = rows.unionByName(spark.createDataFrame([(5, "ccc")], "k int, t string"))
    out, counts = recomputed(more, ["t"], compute, "v1", store)
    assert counts == {"asked": 4, "computed": 1} and {r["k"]: r["reused"] for r in out.collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}
    assert recomputed(more, ["t"], compute, "v1", store)[1]["computed"] == 0
    assert recomputed(rows, ["t"], compute, "v2", store)[1]["computed"] == 3
    assert seen == [["", "a", "bb"], ["ccc"], ["", "a", "bb"]]
    assert recomputed(rows.where("false"), ["t"], compute, "v1", Store(store.root + "-empty"))[0].count() == 0


def test_other_values_and_partial_results_are_refused(spark, store):
    row = lambda k, v: spark.createDataFrame([(k, v)], "key string, v double")
    assert store.publish(row("a", 1.0), "key") == 1 and store.publish(row("a", 1.0), "key") == 0
    for wrong in (row("a", 2.0), row(None, 1.0), row("b", 1.0).unionByName(row("b", 1.0)), row("c", 1.0).withColumn("more", F.lit(1))):
        with pytest.raises(StoreError):
            store.publish(wrong, "key")
    assert store.read(spark).count() == 1
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    with pytest.raises(StoreError):
        recomputed(rows, ["t"], lambda i: i.where("t = 'x'").select("input_key", F.lit(1).alias("n")), "v1", Store(store.root + "-2"))
    assert Store(store.root + "-2").read(spark) is None


def test_what_a_lost_writer_left_is_not_read(spark, store):
    row = lambda k: spark.createDataFrame([(k, 1.0)], "key string, v double")
    store.publish(row("a"), "key")
    row("b").write.parquet(f"{store.root}/parts/left")
    assert [r["key"] for r in store.read(spark).collect()] == ["a"]
    row("c").write.mode("append").parquet(f"{store.root}/parts/{store.parts(spark)[0]}")
    with pytest.raises(StoreError):
        store.read(spark)


def test_cosine_over_many_lanes_and_magnitudes(spark):
    import numpy as np

    g = np.random.default_rng(1)
    rows = [(k, 0 if k % 3 else 1, [*map(float, g.standard_normal(8) * 10.0 ** (k % 5 * 100 - 200))]) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, s int, v array<double>")
    got = exact_cosine(df, df.where("k % 20 = 0"), "k", "v", "s", 4, tile=7).collect()
    v = np.array([e for _, _, e in rows])
    v /= np.abs(v).max(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, 300, 20):
        own = sorted((-round(float(v[q] @ v[k]), 6), k) for k in range(300) if k != q and rows[k][1] == rows[q][1])[:4]
        want |= {(q, k, n + 1) for n, (_, k) in enumerate(own)}
    assert {(r["query"], r["k"], r["rank"]) for r in got} == want
