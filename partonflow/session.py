"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(
    builder: SparkSession.Builder, shuffle_partitions: int, chunk_bytes: int = 128 << 20
) -> SparkSession.Builder:
    """Settings the queries are written for.

    ``shuffle_partitions`` is an upper limit: adaptive execution merges small
    ones.  Histogram shuffles need few; assembling the event table from tables
    of ``b`` bytes wants about ``b / 200 MB``.  ``chunk_bytes`` is the input of
    one task; larger chunks mean fewer tasks on very large tables.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.files.maxPartitionBytes": str(chunk_bytes),
        "spark.sql.session.timeZone": "UTC",
        # Building a plan with thousands of column calls is several times faster without
        # the recording of a Python call site for each of them.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder
