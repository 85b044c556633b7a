"""Binning, flow, dense output, merging and scaling."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from partonflow.operators import hist
from partonflow.operators.hist import Axis

AXIS = Axis("x", 4, 0.0, 2.0)


def frame(spark, values, dataset="d"):
    return spark.createDataFrame([(dataset, v) for v in values], "dataset string, x double")


def counts(h):
    return {r["bin"]: r["n"] for r in h.collect()}


def test_edges_flow_and_nulls(spark):
    h = hist.fill(frame(spark, [-0.1, 0.0, 0.49, 0.5, 1.99, 2.0, 9.0, None]), [AXIS])
    assert counts(h) == {-1: 1, 0: 2, 1: 1, 3: 1, 4: 2}
    sides = {r["side"]: r["n"] for r in hist.flow(h, [AXIS]).collect()}
    assert sides == {"underflow": 1, "overflow": 2}
    assert counts(hist.visible(h, [AXIS])) == {0: 2, 1: 1, 3: 1}


def test_dense_has_every_bin(spark):
    h = hist.dense(hist.fill(frame(spark, [0.1, 5.0]), [AXIS]), [AXIS])
    rows = {r["bin"]: (r["lo"], r["hi"], r["n"]) for r in h.collect()}
    assert rows == {0: (0.0, 0.5, 1), 1: (0.5, 1.0, 0), 2: (1.0, 1.5, 0), 3: (1.5, 2.0, 0)}


def test_matches_numpy(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(50, 30, 4000).round(3)
    axis = Axis("x", 25, 0, 100)
    got = counts(hist.fill(frame(spark, values.tolist()), [axis]))
    inside = values[(values >= 0) & (values < 100)]
    expected, _ = np.histogram(inside, bins=25, range=(0, 100))
    assert [got.get(i, 0) for i in range(25)] == expected.tolist()


def test_weights(spark):
    df = spark.createDataFrame([("d", 0.1, 2.0), ("d", 0.2, 3.0)], "dataset string, x double, w double")
    row = hist.fill(df, [AXIS], weight="w").first()
    assert (row["n"], row["sumw"], row["sumw2"]) == (2, 5.0, 13.0)


@pytest.mark.parametrize("parts", [1, 16])
def test_split_of_the_data_does_not_matter(spark, events, parts):
    from partonflow.plans.benchmarks import BENCHMARKS

    for name in ("adl2_jet_pt", "adl6_trijet", "adl8_mt_third_lepton"):
        whole = BENCHMARKS[name].histogram(events)
        split = BENCHMARKS[name].histogram(events.repartition(parts))
        assert sorted(whole.collect()) == sorted(split.collect())


def test_merge_and_rebin(spark):
    a = hist.fill(frame(spark, [0.1, 0.6]), [AXIS])
    b = hist.fill(frame(spark, [0.2, 1.6]), [AXIS])
    merged = hist.merge(a, b)
    assert counts(merged) == {0: 2, 1: 1, 3: 1}
    assert counts(hist.rebin(merged, 2)) == {0: 3, 1: 1}


def test_scale_and_regroup(spark):
    h = hist.fill(frame(spark, [0.1, 0.1], "a").union(frame(spark, [0.1], "b")).union(frame(spark, [0.1], "c")), [AXIS])
    entries = spark.createDataFrame([("a", 4), ("b", 10), ("c", 7)], "dataset string, entries long")
    scaled = hist.scale(h, entries, {"a": 2.0, "b": 3.0}, 100.0)
    sums = {r["dataset"]: r["sumw"] for r in scaled.collect()}
    assert sums == {"a": pytest.approx(100.0), "b": pytest.approx(30.0)}
    grouped = hist.regroup(scaled, {"a": "g", "b": "g"}, "dataset", "group")
    assert grouped.first()["sumw"] == pytest.approx(130.0)
    assert grouped.count() == 1


def test_cutflow_of_nothing_is_zero(spark):
    df = frame(spark, [1.0]).withColumn("k", F.lit(None).cast("int"))
    rows = hist.cutflow(df, {"all": F.lit(1), "none": F.col("k")}).collect()
    assert [(r["step_no"], r["step"], r["n"]) for r in rows] == [(0, "all", 1), (1, "none", 0)]


def test_joint_axes(spark):
    df = spark.createDataFrame([("d", 0.1, 0.6), ("d", 0.1, None)], "dataset string, x double, y double")
    h = hist.fill_joint(df, [AXIS, Axis("y", 4, 0, 2)])
    assert [(r["x_bin"], r["y_bin"], r["n"]) for r in h.collect()] == [(0, 1, 1)]
