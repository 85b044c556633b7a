"""Correction tables: one factor per bin of a regular axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.operators.hist import Axis


def efficiency(passed: DataFrame, everything: DataFrame) -> DataFrame:
    """Ratio of two histograms of one variable as a table (bin, factor)."""
    total = everything.groupBy("bin").agg(F.sum("n").alias("total"))
    good = passed.groupBy("bin").agg(F.sum("n").alias("good"))
    return total.join(good, "bin", "left").select(
        "bin", (F.coalesce(F.col("good"), F.lit(0)) / F.col("total")).alias("factor")
    )


def efficiency_of(both: DataFrame, passed: str) -> DataFrame:
    """The same from one histogram with the decision ``passed`` as a category."""
    good = F.coalesce(F.sum(F.when(F.col(passed), F.col("n"))), F.lit(0))
    return both.groupBy("bin").agg((good / F.sum("n")).alias("factor"))


def with_factor(df: DataFrame, axis: Axis, table: DataFrame, default: float = 1.0) -> DataFrame:
    """Add the ``factor`` of the bin that the column named like the axis falls in.

    The table is keyed by bin number, so the range lookup is an equi-join.  Rows
    outside the axis and its flow bins are left out, which bounds the table by
    ``axis.bins + 2`` rows; a bin with two rows is an error, because it would
    repeat the data.
    """
    twice = F.raise_error(F.lit("two factors for one bin")).cast("double")
    table = (
        table.filter(F.col("bin").between(-1, axis.bins))
        .groupBy("bin")
        .agg(F.when(F.count(F.lit(1)) == 1, F.max("factor")).otherwise(twice).alias("factor"))
    )
    keyed = df.withColumn("bin", axis.index(axis.name))
    joined = keyed.join(table, "bin", "left")
    return joined.withColumn("factor", F.coalesce(F.col("factor"), F.lit(default))).drop("bin")
