"""Reductions and selections over the list columns of one event.

Nothing here shuffles: each function is an expression on one row.  The rules
for absent values are part of the contract:

* sums over an empty list are 0, ``every`` is true, ``some`` is false;
* extrema over an empty list are NULL, and so is an index past the end;
* among equal extrema the first element wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Element = Callable[[Column], Column]


def let(value: Column, body: Element) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def num(items: Column) -> Column:
    """Length of the list."""
    return F.size(items).cast("long")


def count(values: Column) -> Column:
    """Number of elements that are not NULL."""
    return F.size(F.filter(values, lambda x: x.isNotNull())).cast("long")


def keep(items: Column, condition: Element) -> Column:
    """Elements that pass; a NULL condition counts as not passing."""
    return F.filter(items, condition)


def count_true(items: Column, condition: Element) -> Column:
    return F.size(F.filter(items, condition)).cast("long")


def total(values: Column) -> Column:
    """Sum of numbers as double, skipping NULLs."""
    return F.aggregate(
        values, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0))
    )


def total_int(values: Column) -> Column:
    """Sum of integers as long, skipping NULLs."""
    return F.aggregate(
        values, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x.cast("long"), F.lit(0))
    )


def some(items: Column, condition: Element) -> Column:
    """At least one element passes; NULL conditions count as false."""
    return F.exists(items, lambda x: F.coalesce(condition(x), F.lit(False)))


def every(items: Column, condition: Element) -> Column:
    """All elements pass; NULL conditions count as false."""
    return F.forall(items, lambda x: F.coalesce(condition(x), F.lit(False)))


def smallest(values: Column) -> Column:
    return F.array_min(values)


def largest(values: Column) -> Column:
    return F.array_max(values)


def argmin(items: Column, key: Element) -> Column:
    """Position of the smallest key, NULL if there is none; NULL keys do not compete."""
    ranked = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))
    return F.array_min(F.filter(ranked, lambda r: r["k"].isNotNull()))["i"]


def argmax(items: Column, key: Element) -> Column:
    """Position of the largest key, NULL for an empty list."""
    return -F.array_max(
        F.transform(items, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i")))
    )["i"]


def at_min(items: Column, key: Element, take: Element = lambda x: x) -> Column:
    """``take`` of the element with the smallest key; NULL keys do not compete."""
    ranked = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), take(x).alias("x")))
    return F.array_min(F.filter(ranked, lambda r: r["k"].isNotNull()))["x"]


def at_max(items: Column, key: Element, take: Element = lambda x: x) -> Column:
    """``take`` of the element with the largest key."""
    return F.array_max(
        F.transform(
            items, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), take(x).alias("x"))
        )
    )["x"]


def at_second_max(items: Column, key: Element, take: Element = lambda x: x) -> Column:
    """``take`` of the element that has the largest key once the first one is removed."""
    ranked = F.sort_array(
        F.transform(
            items, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), take(x).alias("x"))
        ),
        asc=False,
    )
    return F.get(ranked, F.lit(1))["x"]


def at(items: Column, position: int | Column) -> Column:
    """Element at a 0-based position, NULL past the end."""
    return F.get(items, F.lit(position) if isinstance(position, int) else position)


def positions(items: Column) -> Column:
    return F.transform(items, lambda _, i: i)


def indexed(items: Column) -> Column:
    """Elements paired with their position as ``(i, x)``."""
    return F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


def without(items: Column, *drop: Column) -> Column:
    """List minus the elements at the given positions."""

    def outside(taken: Column) -> Column:
        return F.filter(items, lambda _, i: ~F.array_contains(taken, i))

    return let(F.array(*drop), outside)


def fill(value: Column, default: Column | float | int) -> Column:
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))
