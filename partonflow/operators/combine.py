"""Combinations inside one event: pairs, triples, cross products, matching.

Everything is an expression over list columns of the same row, so no event data
moves between partitions.  ``make`` turns a combination into the value that is
wanted; pass the final number instead of the default struct where possible, so
that a list of masses is built and not a list of particle copies.  Cut lists
before combining them: pairs grow with the square and triples with the cube.

A list that is read inside a lambda is bound once per row (:func:`lists.let`);
otherwise its defining expression would run again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from partonflow.functions import p4
from partonflow.functions.lists import let

Make = Callable[..., Column]


def _tuple(*parts: Column) -> Column:
    return F.struct(*[p.alias(f"i{n}") for n, p in enumerate(parts)])


def _after(items: Column, i: Column) -> Column:
    """Elements behind 0-based position ``i``."""
    return F.slice(items, i + 2, F.size(items))


def arg_pairs(items: Column, make: Make = lambda i, j, a, b: _tuple(i, j)) -> Column:
    """One value per pair of positions i < j, made from ``(i, j, a, b)``."""

    def combine(xs: Column) -> Column:
        return F.flatten(
            F.transform(
                xs,
                lambda a, i: F.transform(_after(xs, i), lambda b, d: make(i, i + d + 1, a, b)),
            )
        )

    return let(items, combine)


def pairs(items: Column, make: Make = _tuple) -> Column:
    """One value per unordered pair, first element before the second."""

    def combine(xs: Column) -> Column:
        return F.flatten(
            F.transform(xs, lambda a, i: F.transform(_after(xs, i), lambda b: make(a, b)))
        )

    return let(items, combine)


def arg_triples(items: Column, make: Make = lambda i, j, k, a, b, c: _tuple(i, j, k)) -> Column:
    """One value per triple of positions i < j < k, made from ``(i, j, k, a, b, c)``."""

    def combine(xs: Column) -> Column:
        return F.flatten(
            F.transform(
                xs,
                lambda a, i: F.flatten(
                    F.transform(
                        _after(xs, i),
                        lambda b, j: F.transform(
                            _after(xs, i + j + 1),
                            lambda c, k: make(i, i + j + 1, i + j + k + 2, a, b, c),
                        ),
                    )
                ),
            )
        )

    return let(items, combine)


def triples(items: Column, make: Make = _tuple) -> Column:
    """One value per unordered triple in list order."""
    return arg_triples(items, lambda i, j, k, a, b, c: make(a, b, c))


def closest_triples(items: Column, distance: Make, make: Make = _tuple) -> Column:
    """The triples tied for the smallest ``distance(a, b, c)``, in list order.

    The minimum is taken level by level, so that the longest list in between is as
    long as ``items``, not as the number of triples; then only the triples at
    that distance are made.
    """

    def smallest(xs: Column) -> Column:
        def third(a: Column, b: Column, after: Column) -> Column:
            return F.array_min(F.transform(_after(xs, after), lambda c: distance(a, b, c)))

        def second(a: Column, i: Column) -> Column:
            return F.array_min(F.transform(_after(xs, i), lambda b, j: third(a, b, i + j + 1)))

        return F.array_min(F.transform(xs, second))

    def tied(xs: Column, low: Column) -> Column:
        def third(a: Column, b: Column, after: Column) -> Column:
            at = F.filter(_after(xs, after), lambda c: distance(a, b, c) == low)
            return F.transform(at, lambda c: make(a, b, c))

        def second(a: Column, i: Column) -> Column:
            return F.flatten(F.transform(_after(xs, i), lambda b, j: third(a, b, i + j + 1)))

        return F.flatten(F.transform(xs, second))

    return let(items, lambda xs: let(smallest(xs), lambda low: tied(xs, low)))


def cross_nested(left: Column, right: Column, make: Make = _tuple) -> Column:
    """Cross pairs as one list per left element."""
    return let(
        right,
        lambda ys: F.transform(left, lambda a: F.transform(ys, lambda b: make(a, b))),
    )


def cross(left: Column, right: Column, make: Make = _tuple) -> Column:
    """Every pair across two lists of the event."""
    return F.flatten(cross_nested(left, right, make))


def nearest(items: Column, others: Column) -> Column:
    """For each element ``(dr, i)`` of the closest element of ``others``, NULL without any."""

    def closest(ys: Column) -> Column:
        return F.transform(
            items,
            lambda a: F.array_min(
                F.transform(
                    ys,
                    lambda b, i: F.struct(
                        p4.stable(p4.delta_r(a, b)).alias("dr"), i.alias("i")
                    ),
                )
            ),
        )

    return let(others, closest)


def apart(
    items: Column, others: Column, radius: float, require_neighbour: bool = False
) -> Column:
    """Per element: is it further than ``radius`` from every element of ``others``?

    With no neighbour at all the answer is yes, or no with ``require_neighbour``.
    """

    def test(ys: Column) -> Column:
        alone = F.size(ys) > 0 if require_neighbour else F.lit(True)
        return F.transform(
            items,
            lambda a: alone & F.forall(ys, lambda b: p4.stable(p4.delta_r(a, b)) > radius),
        )

    return let(others, test)


def isolated(
    items: Column, others: Column, radius: float, require_neighbour: bool = False
) -> Column:
    """Elements further than ``radius`` from every element of ``others``."""

    def test(ys: Column) -> Column:
        alone = F.size(ys) > 0 if require_neighbour else F.lit(True)
        return F.filter(
            items,
            lambda a: alone & F.forall(ys, lambda b: p4.stable(p4.delta_r(a, b)) > radius),
        )

    return let(others, test)


def keep_at_minimum(items: Column, key: str) -> Column:
    """All elements tied for the smallest value of field ``key``."""

    def best(xs: Column) -> Column:
        return let(
            F.array_min(F.transform(xs, lambda x: x[key])),
            lambda low: F.filter(xs, lambda x: x[key] == low),
        )

    return let(items, best)
