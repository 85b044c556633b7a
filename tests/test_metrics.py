"""The accounts of a run against what is known of it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from partonflow.catalog.registry import Inputs
from partonflow.metrics import COUNTED_READS, accounted, columns_read, run_with_metrics, throughput
from partonflow.plans.benchmarks import BENCHMARKS, JetPt
from partonflow.sources.fileset import files_by

MIDDLE = "/root/testdata/sf0.1"


def test_a_run_reads_one_column_once(spark):
    events = Inputs(spark, MIDDLE).events
    fileset = {str(k): v for k, v in files_by(events, "dataset").items()}
    size = sum(os.path.getsize(p.removeprefix("file:")) for paths in fileset.values() for p in paths)
    results, metrics = run_with_metrics(spark, fileset, None, JetPt(), 10_000)
    n = events.count()
    assert metrics["entries"] == n
    assert metrics["columns"] == ["Jet:array<struct<pt:double>>"]
    assert 0.01 * size < metrics["bytes"] < 0.3 * size
    assert metrics["chunks"] == sum(-(-r["entries"] // 10_000) for r in results["entries"].collect())
    assert metrics["tasks"] >= len(fileset) and metrics["shuffle_bytes"] > 0
    assert 0 < metrics["cpu_seconds"] <= 1.5 * metrics["process_seconds"] + 0.5
    rates = throughput(metrics)
    assert rates["events_per_second_per_thread"] == n / metrics["process_seconds"]


def test_only_the_block_is_accounted(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.options(**COUNTED_READS).parquet(f"{tmp_path}/t")
    df.count()
    with accounted(spark) as twice:
        df.agg(F.sum("id")).collect()
        df.agg(F.sum("id")).collect()
    df.count()
    assert twice.input_records == 2000 and twice.jobs >= 2 and twice.input_bytes > 0
    with accounted(spark) as nothing:
        pass
    assert (nothing.jobs, nothing.tasks, nothing.input_bytes) == (0, 0, 0)
    spark.sparkContext.setJobGroup("outer", "kept")
    with accounted(spark):
        df.count()
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "outer"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_columns_are_those_of_the_scan(spark, inputs):
    met = BENCHMARKS["adl1_met"]
    assert columns_read(met.tally(inputs.events_for(met))) == ["MET:struct<pt:double>"]
    assert columns_read(spark.range(3).toDF("x")) == []
