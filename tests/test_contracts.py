"""Inputs that the driver's tables do not hold: NULL categories, new labels, unequal branches, repeated bins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from partonflow.catalog.registry import Inputs, registered
from partonflow.operators import lookup
from partonflow.operators.accumulate import accumulate
from partonflow.operators.hist import Axis
from partonflow.sources.branches import zip_collections
from partonflow.streaming.running import last_total

SMALL = "/root/testdata/sf0.001"


def test_null_category_is_accumulated(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    out = accumulate(df, "k", ("n",), lambda chunk: {"n": len(chunk)}).collect()
    assert {r["k"]: r["n"] for r in out} == {"a": 1.0, None: 2.0}


def test_repeated_bin_is_an_error(spark):
    axis = Axis("x", 10, 0, 10)
    data = spark.createDataFrame([(1.5,), (2.5,)], "x double")
    good = spark.createDataFrame([(1, 0.5), (99, 0.1)], "bin long, factor double")
    assert sorted(r["factor"] for r in lookup.with_factor(data, axis, good).collect()) == [0.5, 1.0]
    with pytest.raises(Exception, match="two factors"):
        lookup.with_factor(data, axis, good.union(good)).collect()


def test_unequal_branches_are_an_error(spark):
    flat = spark.createDataFrame([(2, [1.0, 2.0], [1.0])], "numberjet int, jet_pt array<double>, jet_eta array<double>")
    with pytest.raises(Exception, match="differ in length"):
        zip_collections(flat).collect()


def test_new_and_missing_labels_are_kept(spark, tmp_path):
    label = F.when(F.col("o_orderkey") % 7 == 0, "6-NEW").when(F.col("o_orderkey") % 11 == 0, None)
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    orders.withColumn("o_orderpriority", label.otherwise(F.col("o_orderpriority"))).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registered()["scan_fileset"](spark, str(tmp_path)).agg(F.sum("entries")).first()[0]
    assert found == Inputs(spark, str(tmp_path)).events.count()
    assert "6-NEW" in registered()["overlay_pivot"](spark, str(tmp_path)).columns


def test_event_table_is_shared_by_sessions(spark):
    from partonflow.sources import detector

    before = Inputs(spark, SMALL).location
    detector._written.clear()
    assert Inputs(spark, SMALL).location == before


def test_unfinished_total_hides_no_earlier_one(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/batch=1")
    (tmp_path / "batch=2" / "_temporary").mkdir(parents=True)
    assert last_total(spark, str(tmp_path)).count() == 3
