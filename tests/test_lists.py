"""Empty lists, absent values and ties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from partonflow.functions import lists
from partonflow.operators import combine

SCHEMA = "v array<double>"


def on(spark, values, column):
    df = spark.createDataFrame([(values,)], SCHEMA)
    return df.select(column.alias("out")).first()["out"]


V = "v"


def ident(x):
    return x


@pytest.mark.parametrize(
    ("values", "make", "expected"),
    [
        ([], lambda v: lists.total(v), 0.0),
        ([1.0, None, 2.5], lambda v: lists.total(v), 3.5),
        ([1.0, None], lambda v: lists.count(v), 1),
        ([1.0, None], lambda v: lists.num(v), 2),
        ([], lambda v: lists.every(v, lambda x: x > 1), True),
        ([], lambda v: lists.some(v, lambda x: x > 1), False),
        ([None, 0.5], lambda v: lists.some(v, lambda x: x > 1), False),
        ([None, 2.0], lambda v: ~lists.some(v, lambda x: x > 3), True),
        ([None, 2.0], lambda v: lists.every(v, lambda x: x > 1), False),
        ([], lambda v: lists.smallest(v), None),
        ([], lambda v: lists.largest(v), None),
        ([], lambda v: lists.argmax(v, ident), None),
        ([], lambda v: lists.fill(lists.largest(v), 0.0), 0.0),
        ([3.0, 7.0, 7.0], lambda v: lists.argmax(v, ident), 1),
        ([3.0, 1.0, 1.0], lambda v: lists.argmin(v, ident), 1),
        ([3.0, 7.0, 7.0], lambda v: lists.at_second_max(v, ident), 7.0),
        ([3.0, 7.0], lambda v: lists.at_second_max(v, ident), 3.0),
        ([3.0], lambda v: lists.at_second_max(v, ident), None),
        ([3.0], lambda v: lists.at(v, 1), None),
        ([3.0, 4.0, 5.0], lambda v: lists.without(v, F.lit(0), F.lit(2)), [4.0]),
        ([3.0, 4.0], lambda v: lists.positions(v), [0, 1]),
        ([3.0, 4.0, 50.0], lambda v: lists.count_true(v, lambda x: x > 3), 2),
    ],
)
def test_rules(spark, values, make, expected):
    assert on(spark, values, make(F.col(V))) == expected


@pytest.mark.parametrize("n", range(6))
def test_combinations_match_itertools(spark, n):
    from itertools import combinations

    values = [float(10**i) for i in range(n)]
    total = lambda *xs: sum(xs[1:], xs[0])
    pairs = on(spark, values, combine.pairs(F.col(V), total))
    triples = on(spark, values, combine.triples(F.col(V), total))
    assert pairs == [sum(c) for c in combinations(values, 2)]
    assert triples == [sum(c) for c in combinations(values, 3)]
    positions = on(spark, values, combine.arg_pairs(F.col(V)))
    assert [tuple(p) for p in positions] == list(combinations(range(n), 2))
    positions = on(spark, values, combine.arg_triples(F.col(V)))
    assert [tuple(p) for p in positions] == list(combinations(range(n), 3))


def test_cross_keeps_left_order(spark):
    df = spark.createDataFrame([([1.0, 2.0], [10.0]), ([1.0], []), ([], [1.0])], "a array<double>, b array<double>")
    add = lambda a, b: a + b
    flat = [r[0] for r in df.select(combine.cross(F.col("a"), F.col("b"), add)).collect()]
    nested = [r[0] for r in df.select(combine.cross_nested(F.col("a"), F.col("b"), add)).collect()]
    assert flat == [[11.0, 12.0], [], []]
    assert nested == [[[11.0], [12.0]], [[]], []]


def test_all_ties_at_the_minimum_stay(spark):
    df = spark.createDataFrame(
        [([(2.0, "a"), (1.0, "b"), (1.0, "c")],), ([],)], "t array<struct<d:double, x:string>>"
    )
    kept = [r[0] for r in df.select(combine.keep_at_minimum(F.col("t"), "d").x).collect()]
    assert kept == [["b", "c"], []]


@pytest.mark.parametrize(("require", "expected"), [(False, 1), (True, 0)])
def test_isolation_without_neighbours(spark, require, expected):
    p = "array<struct<eta:double, phi:double>>"
    df = spark.createDataFrame([([(0.0, 0.0)], [])], f"a {p}, b {p}")
    kept = df.select(F.size(combine.isolated(F.col("a"), F.col("b"), 0.4, require))).first()[0]
    assert kept == expected


def test_let_computes_once(spark):
    df = spark.range(1).select(lists.let(F.rand(), lambda r: r - r).alias("zero"))
    assert df.first()["zero"] == 0.0


def test_null_keys_do_not_compete(spark):
    df = spark.createDataFrame([([None, 3.0, 1.0],), ([None],), ([],)], "a array<double>")
    out = df.select(
        lists.argmin(F.col("a"), lambda x: x).alias("i"), lists.at_min(F.col("a"), lambda x: x).alias("x")
    ).collect()
    assert [tuple(r) for r in out] == [(2, 1.0), (None, None), (None, None)]
