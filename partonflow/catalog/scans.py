"""Reading: filesets, trees, column selection, entry limits, counts, metrics and sinks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partonflow.catalog import sql as q
from partonflow.catalog.registry import Inputs, query
from partonflow.metrics import run_with_metrics, throughput
from partonflow.plans.benchmarks import JetPt, MissingEnergy
from partonflow.sources.fileset import (
    count_chunks,
    count_entries,
    files_by,
    first_chunks,
    first_events,
    read_fileset,
    read_tree,
)
from partonflow.sources.scratch import scratch_path

# The labels of the first dataset; all others make up the second.
FIRST_DATASET = ("1-URGENT", "2-HIGH")
TWO_SQL = (
    "SELECT CASE WHEN dataset IN ('1-URGENT', '2-HIGH') THEN 'tHq' ELSE 'tHW' END AS dataset, "
    "event_id, met_pt FROM ev"
)


def two_datasets(inputs: Inputs) -> DataFrame:
    """All events as two datasets of several files each."""
    files = files_by(inputs.events, "dataset")
    fileset: dict[str, list[str]] = {"tHq": [], "tHW": []}
    for label, paths in files.items():
        fileset["tHq" if label in FIRST_DATASET else "tHW"] += paths
    return read_fileset(inputs.spark, {name: paths for name, paths in fileset.items() if paths})


@query(
    "scan_fileset",
    q.sql(
        "SELECT dataset, count(*) AS entries, CAST(sum(coalesce(n, 0)) AS BIGINT) AS jets FROM two "
        "LEFT JOIN (SELECT event_id, count(*) AS n FROM jet GROUP BY 1) USING (event_id) GROUP BY 1",
        two=TWO_SQL,
    ),
)
def scan_fileset(inputs: Inputs) -> DataFrame:
    return (
        two_datasets(inputs)
        .groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("entries"), F.sum("nJet").alias("jets"))
    )


@query(
    "union_datasets",
    q.sql("SELECT dataset, event_id, met_pt FROM two", two=TWO_SQL),
)
def union_datasets(inputs: Inputs) -> DataFrame:
    return two_datasets(inputs).select("dataset", "event_id", F.col("MET.pt").alias("met_pt"))


@query("scan_named_tree", q.sql("SELECT event_id, sample, met_pt, met_phi FROM ev"))
def scan_named_tree(inputs: Inputs) -> DataFrame:
    events = read_tree(inputs.spark, inputs.location, "Events")
    return events.select(
        "event_id", "sample", F.col("MET.pt").alias("met_pt"), F.col("MET.phi").alias("met_phi")
    )


@query("scan_columns", q.sql("SELECT event_id, pt FROM mu"))
def scan_columns(inputs: Inputs) -> DataFrame:
    """One field of one collection; the scan reads nothing else."""
    return inputs.events.select("event_id", F.explode("Muon.pt").alias("pt"))


@query("scan_select_query", q.sql("SELECT event_id, CAST(idx AS INTEGER) AS pos, pt AS jet_pt FROM jet"))
def scan_select_query(inputs: Inputs) -> DataFrame:
    """Column request on the flat branches, no filter."""
    request = inputs.branches.select("event_id", "jet_pt")
    return request.select("event_id", F.posexplode("jet_pt").alias("pos", "jet_pt"))


STOP = 1000


@query(
    "scan_entry_stop", q.sql(f"SELECT event_id, met_pt FROM ev ORDER BY event_id LIMIT {STOP}")
)
def scan_entry_stop(inputs: Inputs) -> DataFrame:
    """The entry limit itself is the feature."""
    events = inputs.events.select("event_id", F.col("MET.pt").alias("met_pt"))
    return first_events(events, STOP)


@query(
    "scan_max_chunks",
    q.sql(
        "SELECT dataset, count(*) AS entries FROM "
        "(SELECT * FROM ev ORDER BY event_id LIMIT 5000) GROUP BY 1"
    ),
)
def scan_max_chunks(inputs: Inputs) -> DataFrame:
    """Two chunks of 2,500 events; the chunk limit itself is the feature."""
    return count_entries(first_chunks(inputs.events.select("event_id", "dataset"), 2, 2500))


@query("count_entries", q.sql("SELECT dataset, count(*) AS entries FROM ev GROUP BY 1"))
def entries(inputs: Inputs) -> DataFrame:
    return count_entries(inputs.events)


@query(
    "num_chunks",
    q.sql(
        "SELECT dataset, count(DISTINCT (r - 1) // 1000) AS chunks FROM (SELECT dataset, "
        "row_number() OVER (PARTITION BY dataset ORDER BY event_id) AS r FROM ev) GROUP BY 1"
    ),
)
def num_chunks(inputs: Inputs) -> DataFrame:
    return count_chunks(inputs.events, 1000)


#: Events of a chunk where chunks are counted.
CHUNK = 1000


def all_files(inputs: Inputs) -> dict[str, list[str]]:
    """The files of the event tree under their labels."""
    return {str(label): paths for label, paths in files_by(inputs.events, "dataset").items()}


def as_rows(spark: SparkSession, metrics: dict[str, str] | dict[str, float]) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair])
    return spark.range(1).select(F.explode(pairs).alias("metric", "value"))


@query("run_metrics")
def run_metrics(inputs: Inputs) -> DataFrame:
    """Metrics of one run over all events, one row per metric."""
    _, metrics = run_with_metrics(inputs.spark, all_files(inputs), None, JetPt(), CHUNK)
    return as_rows(inputs.spark, {k: str(v) for k, v in metrics.items()})


@query(
    "run_metrics_exact",
    q.sql(
        "SELECT 'entries' AS metric, CAST(count(*) AS VARCHAR) AS value FROM ev UNION ALL "
        "SELECT 'chunks', CAST(CAST(sum(ceil(n / 1000e0)) AS BIGINT) AS VARCHAR) FROM (SELECT count(*) AS n FROM ev GROUP BY dataset) "
        "UNION ALL SELECT 'columns', '[''Jet:array<struct<pt:double>>'']'"
    ),
)
def run_metrics_exact(inputs: Inputs) -> DataFrame:
    """Those metrics of a run that do not depend on the machine."""
    return run_metrics(inputs).filter(F.col("metric").isin("entries", "chunks", "columns"))


@query("throughput_metrics")
def throughput_metrics(inputs: Inputs) -> DataFrame:
    _, metrics = run_with_metrics(inputs.spark, all_files(inputs), None, MissingEnergy(), CHUNK)
    return as_rows(inputs.spark, throughput(metrics))


@query(
    "sink_hist",
    q.dense_hist("SELECT dataset, 'MET' AS variable, met_pt AS v FROM ev", MissingEnergy.axes),
)
def sink_hist(inputs: Inputs) -> DataFrame:
    """Histogram table written to Parquet and read back."""
    path = scratch_path(inputs.spark, f"hist-{time.time_ns()}")
    MissingEnergy().dense_histogram(inputs.events).write.parquet(path)
    return inputs.spark.read.parquet(path)
