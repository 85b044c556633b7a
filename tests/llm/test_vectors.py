"""Embedding near-dedup against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql.group import GroupedData

from partonflow.llm import vector_graph
from partonflow.llm.components import components


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = np.concatenate([base, base[:10] + rng.normal(size=(10, 16)) * 0.05, np.repeat(base[:1], 30, 0)])
    data = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0, 2.0]), (None, [1.0] * 16), data[3]]
    got = vector_graph.near_duplicates(spark.createDataFrame([*data, *odd], "vec_id long, embedding array<double>"), shard=40, sample=100).collect()
    assert len(got) == len(data) + len(odd)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    by_id = {r["vec_id"]: r for r in got}
    assert all(by_id[k]["n_links"] == near[k].sum() - 1 for k in range(len(rows)))
    assert all(by_id[k]["component_id"] <= k for k in range(len(rows))) and by_id[60]["component_id"] == 0
    assert all(by_id[k]["n_links"] == 0 and by_id[k]["component_id"] == k for k in range(900, 905))


def test_no_group_holds_a_whole_shard(spark, monkeypatch):
    apply = GroupedData.applyInPandas

    def bounded(fn):
        def run(pdf):
            assert "v" not in pdf or len(pdf) <= 2 * 75, f"{len(pdf)} rows in one group"
            return fn(pdf)

        return run

    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, fn, schema: apply(self, bounded(fn), schema))
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(150, 16))
    rows = np.concatenate([rows, rows + rng.normal(size=rows.shape) * 0.05])
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vector_graph.near_duplicates(table, shard=50, sample=40).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    assert got == dict(enumerate(((unit @ unit.T >= 0.95).sum(1) - 1).tolist()))


def _pairs(rng, n, cosine, dims=16):
    a, b = rng.normal(size=(2, n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return np.concatenate([a, cosine * a + (1 - cosine**2) ** 0.5 * b])


def test_a_large_group_does_not_hide_lost_pairs(spark):
    rng = np.random.default_rng(8)
    rows = np.concatenate([_pairs(rng, 50, 0.952), rng.normal(size=16) + rng.normal(size=(120, 16)) * 0.01])
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    # All links of the group are found and none of the pairs: 99 % of the links, but hardly more than half of the nodes.
    result = spark.createDataFrame([(k, 119, [], [], None) for k in range(100, 220)], "rep long, links long, others array<long>, heavy array<string>, other long")
    audit = vector_graph.Audit(vector_graph.nodes(table, "vec_id", "embedding"), 220, 0.95, 256, 4096, 64)
    assert abs(audit.recall(result, None) - 120 / 220) < 1e-9


def test_no_evidence_is_not_full_recall(spark):
    rng = np.random.default_rng(9)
    rows = np.concatenate([_pairs(rng, 50, 0.952), rng.normal(size=(300, 16))])
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    # Few queries, so that next to none has a true link.
    got = vector_graph.near_duplicates(table, overlap=1, shard=40, sample=400, queries=4, most_queries=4).collect()
    assert sum(r["n_links"] > 0 for r in got if r["vec_id"] < 100) >= 94


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 51)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(21)}, 50: 50, 51: 50}
