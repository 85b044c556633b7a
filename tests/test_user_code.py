"""Users' functions over Arrow batches, and users' mergeable states."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partonflow.functions.vectorised import arrow_function
from partonflow.operators.accumulate import Accumulator, accumulate_state


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, 2.0, [1.0, 2.0]), (2, None, [3.0]), (3, 4.0, None), (None, 5.0, []), (5, float("nan"), [None, 1.0]), (6, 1.0, [])]
    return spark.createDataFrame(rows, "i int, x double, xs array<double>").repartition(2)


def values(df, column):
    return sorted(df.select("i", column.alias("y")).collect(), key=lambda r: (r["i"] is None, r["i"] or 0))


def test_nulls_propagate_by_default(odd):
    out = [r["y"] for r in values(odd, arrow_function(lambda i, x: i * x, "double")("i", "x"))]
    assert out[:3] == [2.0, None, 12.0] and math.isnan(out[3]) and out[4:] == [6.0, None]
    ints = [r["y"] for r in values(odd, arrow_function(lambda i: i + 1, "int")("i"))]
    assert ints == [2, 3, 4, 6, 7, None]


def test_nulls_can_be_passed(odd):
    filled = arrow_function(lambda i, x: np.nan_to_num(i, nan=-1.0) + np.nan_to_num(x), "double", nulls="pass")
    assert [r["y"] for r in values(odd, filled("i", "x"))] == [3.0, 2.0, 7.0, 5.0, 7.0, 4.0]


def test_lists_in_and_out(odd):
    def doubled(lists):
        numbers, offsets = lists
        return numbers * 2, offsets

    out = [r["y"] for r in values(odd, arrow_function(doubled, "array<double>")("xs"))]
    assert out == [[2.0, 4.0], [6.0], None, None, [], []]
    sizes = arrow_function(lambda lists: np.diff(lists[1]), "long", nulls="pass")("xs")
    assert [r["y"] for r in values(odd, sizes)] == [2, 1, 0, 2, 0, 0]


def test_a_wrong_result_is_an_error(odd):
    for function, kind in ((lambda i: i[:-1], "int"), (lambda i: ["a"] * len(i), "int")):
        with pytest.raises(Exception, match="results for|nvalid|convert"):
            odd.select(arrow_function(function, kind, nulls="pass")("i")).collect()
    with pytest.raises(ValueError, match="nulls"):
        arrow_function(len, "int", nulls="maybe")
    with pytest.raises(TypeError, match="number"):
        arrow_function(len, "struct<a:int>")


def spread() -> Accumulator:
    """Defined inside a function, so it travels to the workers by value."""

    class Spread(Accumulator):
        schema = "n long, low double, high double, total long, counts string"

        def identity(self):
            return (0, math.inf, -math.inf, 0, {})

        def add(self, state, chunk: pd.DataFrame):
            x = chunk["x"].dropna()
            return self.merge(state, (len(x), x.min() if len(x) else math.inf, x.max() if len(x) else -math.inf, int((x * 8).sum()), (x // 1).value_counts().to_dict()))

        def merge(self, a, b):
            counts = {k: a[4].get(k, 0) + b[4].get(k, 0) for k in {*a[4], *b[4]}}
            return (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], counts)

        def result(self, state):
            n, low, high, total, counts = state
            return {"n": n, "low": low, "high": high, "total": total, "counts": repr(sorted(counts.items()))}

    return Spread()


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 64), (7, 2), (40, 3)])
def test_a_state_merges_to_the_batch_result_under_any_split(spark, parts, fan_in):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.randint(0, 80) / 8])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(parts)
    got = {r["k"]: tuple(r)[1:] for r in accumulate_state(df, "k", spread(), fan_in).collect()}
    for key in ("a", "b", None):
        one = spread()
        mine = pd.DataFrame({"x": [x for k, x in rows if k == key]}, dtype=float)
        assert got[key] == tuple(one.result(one.add(one.identity(), mine)).values())
    assert len(got) == 3 and accumulate_state(df.limit(0), "k", spread()).count() == 0


def test_a_state_may_belong_to_any_kind_of_key(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x"))
    assert {r["k"]: r["n"] for r in accumulate_state(df, "k", spread()).collect()} == {0: 5, 1: 5}
