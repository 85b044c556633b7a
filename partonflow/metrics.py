"""Run metrics: what a run read and how long it took, from the accounts that Spark keeps of its tasks.

The actions of a run carry a job group.  Afterwards the stages of that group's jobs
are looked up in the status store: bytes and records read, tasks, time in tasks
summed over all cores.  All attempts of a stage count, since they all ran.  So
the figures are those of the timed run itself, and no second pass is made.

Parquet files are read without vectored I/O in such a run: its threads are not
those of the tasks, and what they read would be missing from the bytes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from partonflow.plans.analysis import Analysis
from partonflow.sources.fileset import read_fileset
from partonflow.sources.scratch import settled

#: Counted by task threads only, so that bytes are complete.
COUNTED_READS = {"parquet.hadoop.vectored.io.enabled": "false"}
ENDED = {"COMPLETE", "SKIPPED", "FAILED"}
CHUNK_SIZE = 100_000


@dataclass
class Account:
    """Sums over all stages of one job group; filled when its block ends."""

    jobs: int = 0
    tasks: int = 0
    input_bytes: int = 0
    input_records: int = 0
    shuffle_bytes: int = 0
    process_seconds: float = 0.0
    cpu_seconds: float = 0.0
    seconds: float = 0.0
    stages: list[int] = field(default_factory=list)


@contextmanager
def accounted(spark: SparkSession, patience: float = 30.0) -> Iterator[Account]:
    """Account for the jobs that this thread runs inside the block.

    The store learns of the end of a task a moment later, so the block's end waits
    for all its stages, ``patience`` seconds at most.
    """
    context, account, group = spark.sparkContext, Account(), f"partonflow-{uuid.uuid4().hex}"
    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
    context.setJobGroup(group, "measured run")
    start = time.perf_counter()
    try:
        yield account
    finally:
        account.seconds = time.perf_counter() - start
        for key, value in before.items():
            context.setLocalProperty(key, value)
    _settle(spark, account, group, time.monotonic() + patience)


def _settle(spark: SparkSession, account: Account, group: str, deadline: float) -> None:
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    nothing = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def attempts(stage: int) -> list:
        found = store.stageData(stage, False, jvm.java.util.ArrayList(), False, nothing)
        return [found.apply(i) for i in range(found.size())]

    while True:
        jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if j]
        stages = sorted({s for job in jobs for s in job.stageIds})
        found = [a for s in stages for a in attempts(s)]
        if all(j.status != "RUNNING" for j in jobs) and all(a.status().toString() in ENDED for a in found):
            break
        if time.monotonic() > deadline:
            raise TimeoutError("the stages of the run have not been accounted for")
        time.sleep(0.02)
    account.jobs, account.stages = len(jobs), stages
    for a in found:
        if a.status().toString() == "SKIPPED":
            continue
        account.tasks += a.numCompleteTasks() + a.numFailedTasks()
        account.input_bytes += a.inputBytes()
        account.input_records += a.inputRecords()
        account.shuffle_bytes += a.shuffleWriteBytes()
        account.process_seconds += a.executorRunTime() / 1e3
        account.cpu_seconds += a.executorCpuTime() / 1e9


def columns_read(df: DataFrame) -> list[str]:
    """Fields that the file scans of the plan read, ``name:type`` each, partition columns left out."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    out: set[str] = set()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.nodeName().startswith("Scan") and hasattr(leaf, "requiredSchema"):
            schema = StructType.fromDDL(leaf.requiredSchema().toDDL())
            out |= {f"{f.name}:{f.dataType.simpleString()}" for f in schema}
    return sorted(out)


def run_with_metrics(
    spark: SparkSession, fileset: Mapping[str, Sequence[str]], tree: str | None, analysis: Analysis,
    chunk_size: int = CHUNK_SIZE,
) -> tuple[dict[str, DataFrame], dict]:
    """Results of an analysis over a fileset, and the metrics of the run that made them."""
    events = read_fileset(spark, fileset, tree, analysis.reads, COUNTED_READS)
    told = analysis.tally(events, full=True)
    with accounted(spark) as account:
        stored = settled(told, "tally")
    results = analysis.results(stored)
    chunks = results["entries"].agg(F.sum(F.ceil(F.col("entries") / chunk_size))).first()[0]
    metrics = {
        "entries": account.input_records,
        "chunks": int(chunks or 0),
        "columns": columns_read(told),
        "bytes": account.input_bytes,
        "shuffle_bytes": account.shuffle_bytes,
        "tasks": account.tasks,
        "process_seconds": account.process_seconds,
        "cpu_seconds": account.cpu_seconds,
        "seconds": account.seconds,
    }
    return results, metrics


def throughput(metrics: dict) -> dict[str, float]:
    """Events per second of the run, and per second of a thread at work."""
    return {
        "events_per_second": metrics["entries"] / metrics["seconds"],
        "events_per_second_per_thread": metrics["entries"] / metrics["process_seconds"],
    }
