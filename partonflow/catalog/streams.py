"""Running histograms: the last total must equal the batch histogram."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.catalog import sql as q
from partonflow.catalog.registry import Inputs, query
from partonflow.plans.analysis import Analysis
from partonflow.plans.benchmarks import MissingEnergy
from partonflow.plans.dilepton import JetHt
from partonflow.sources.scratch import scratch_path
from partonflow.streaming.running import event_stream, final_histogram


#: Files of one batch.  A batch should be some minutes of work of the cluster.
FILES_PER_BATCH = 64


def _drain(inputs: Inputs, analysis: Analysis, name: str, label: dict | None = None) -> DataFrame:
    work = scratch_path(inputs.spark, f"streams/{name}-{time.time_ns()}")
    tree = f"{inputs.location}/Events"
    stream = event_stream(inputs.spark, tree, inputs.events.schema, FILES_PER_BATCH)
    if label:
        stream = stream.withColumns(label)
    return final_histogram(inputs.spark, stream, analysis, f"{work}/total", f"{work}/state")


@query(
    "stream_hist",
    q.sparse_hist(
        "SELECT 'ttbar' AS dataset, 'ht' AS variable, round(coalesce(sum(pt), 0), 6) AS v, "
        "1e0 AS w FROM ev LEFT JOIN (SELECT * FROM jet WHERE pt > 25) j "
        "ON j.event_id = ev.event_id GROUP BY ev.event_id",
        JetHt.axes,
        weight=True,
    ),
)
def stream_hist(inputs: Inputs) -> DataFrame:
    return _drain(inputs, JetHt(), "ht", {"dataset": F.lit("ttbar")})


@query(
    "stream_multi_dataset",
    q.sparse_hist("SELECT dataset, 'MET' AS variable, met_pt AS v FROM ev", MissingEnergy.axes),
)
def stream_multi_dataset(inputs: Inputs) -> DataFrame:
    """One stream for all datasets."""
    return _drain(inputs, MissingEnergy(), "met")
