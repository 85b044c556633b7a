"""The first N rows of a key order against a sort, and how the plan gets them."""

from __future__ import annotations

import io
import random
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from partonflow.catalog.registry import Inputs
from partonflow.operators.selection import first_rows, unused
from partonflow.sources.fileset import first_chunks, first_events


def explained(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def sort_key(row):
    return (row[0] is not None, row[0] if row[0] is not None else 0)


@pytest.mark.parametrize("buckets", [16, 4096])
@pytest.mark.parametrize("n", [0, 5, 60, 1000])
def test_equals_a_sort(spark, buckets, n):
    rng = random.Random(n)
    keys = [rng.choice([None, -(2**63), 2**63 - 1, 0, 3, rng.randint(-(10**18), 10**18), rng.randint(-5, 5)]) for _ in range(100)]
    rows = [(k, rng.randint(0, 3)) for k in keys]
    df = spark.createDataFrame(rows, "k long, _hash int").repartition(5)
    got = [tuple(r) for r in first_rows(df, n, "k", buckets).collect()]
    expected = sorted(rows, key=sort_key)[:n]
    assert Counter(k for k, _ in got) == Counter(k for k, _ in expected)
    assert not Counter(got) - Counter(rows)


def test_ties_and_equal_rows_are_settled_exactly(spark):
    hot = spark.range(900).select(F.lit(7).alias("k"), (F.col("id") % 3).alias("x"), F.lit("x").alias("_count"))
    rest = spark.range(100).select((F.col("id") - 50).cast("int").alias("k"), F.lit(9).cast("long").alias("x"), F.lit("y").alias("_count"))
    df = hot.unionByName(rest)
    for n in (57, 58, 700, 957):
        got = first_rows(df, n, "k")
        below = n if n <= 57 else 57
        assert got.count() == n
        assert got.filter("k < 7").count() == below
        again = first_rows(df.repartition(11), n, "k")
        assert got.groupBy(*df.columns).count().exceptAll(again.groupBy(*df.columns).count()).isEmpty()


def test_dates_and_timestamps(spark):
    df = spark.range(50).select(
        F.date_add(F.lit("1969-12-20").cast("date"), F.col("id").cast("int")).alias("d"),
        F.timestamp_micros(F.col("id") * 10**15 - 10**16).alias("t"),
    )
    for key in ("d", "t"):
        assert sorted(r[key] for r in first_rows(df, 13, key).collect()) == sorted(r[key] for r in df.collect())[:13]
    with pytest.raises(TypeError, match="no order by number"):
        first_rows(df.withColumn("s", F.lit("a")), 3, "s")


@pytest.mark.parametrize("n", [1000, 100_000])
def test_entry_limit_is_a_filter_on_the_scan(spark, n):
    events = Inputs(spark, "/root/testdata/sf0.1").events.select("event_id", "dataset", F.col("MET.pt").alias("met_pt"))
    df = first_events(events, n)
    plan = explained(df)
    assert "TakeOrderedAndProject" not in plan and "Sort" not in plan and "Exchange" not in plan
    assert "LessThanOrEqual(event_id" in plan
    expected = events.select("event_id").orderBy("event_id").limit(n)
    assert df.count() == n and df.select("event_id").exceptAll(expected).isEmpty()
    assert first_chunks(events, 4, n // 4).count() == n


def test_names_in_use_are_avoided():
    assert unused("_hash", ["_HASH", "a"]) == "__hash"
