"""The first N rows in the order of a key, without gathering N rows of every task in one place.

The N-th smallest key is found by counting.  One aggregation counts the keys in
at most ``BUCKETS`` buckets of equal width, a power of two; the bucket that
holds the N-th key is cut up again until it is taken whole or is a single key.
For 64-bit keys that is at most six passes over the key column, each pushed
down to the range that is left, and the driver sees only bucket counts.  The rows
themselves then come from one filter on the key, which reaches the Parquet reader.

Rows that share the key at the cut are told apart by a hash of the whole row, in
the same way.  Rows that agree in that as well are equal, so it does not matter
which of them stay; they are counted and repeated.

NULL keys come first.  The result is not sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096


def as_number(df: DataFrame, key: str) -> tuple[Column, Callable[[int], Column]]:
    """The key as a long that sorts like it, and literals to compare the key itself with."""
    kind, column = df.schema[key].dataType, F.col(f"`{key}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long"), lambda x: F.date_from_unix_date(F.lit(x))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column), lambda x: F.timestamp_micros(F.lit(x))
    if isinstance(kind, T.IntegralType):
        return column.cast("long"), lambda x: F.lit(x).cast(kind)
    raise TypeError(f"key {key} of type {kind.simpleString()} has no order by number; use an integer, a date or a timestamp")


def first_rows(df: DataFrame, n: int, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The ``n`` rows with the smallest keys, all rows if there are fewer."""
    if n <= 0:
        return df.filter(F.lit(False))
    number, literal = as_number(df, key)
    column = F.col(f"`{key}`")
    total, keyed, low, high = df.agg(F.count(F.lit(1)), F.count(column), F.min(number), F.max(number)).first()
    if total <= n:
        return df
    nulls, wanted = column.isNull(), n - (total - keyed)
    if wanted <= 0:
        return _some(df.filter(nulls), n, buckets)
    while low < high:
        shift = 0
        while (high >> shift) - (low >> shift) >= buckets:
            shift += 1
        inside = df.filter((column >= literal(low)) & (column <= literal(high)))
        counts = inside.groupBy(F.shiftright(number, shift).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()
        for bucket, count in sorted((r["bucket"], r["n"]) for r in counts):
            if count >= wanted:
                break
            wanted -= count
        low, high = max(low, bucket << shift), min(high, ((bucket + 1) << shift) - 1)
        if count == wanted:
            return df.filter(nulls | (column <= literal(high)))
    before = df.filter(nulls | (column < literal(low)))
    return before.unionByName(_some(df.filter(column == literal(low)), wanted, buckets))


def _some(ties: DataFrame, n: int, buckets: int) -> DataFrame:
    """``n`` of these rows, those with the smallest hashes."""
    mark = unused("_hash", ties.columns)
    names = [f.name for f in ties.schema if not _has_map(f.dataType)]
    hashed = ties.withColumn(mark, F.xxhash64(*[F.col(f"`{c}`") for c in names]) if names else F.lit(0).cast("long"))
    total, low, high = hashed.agg(F.count(F.lit(1)), F.min(mark), F.max(mark)).first()
    if total <= n:
        return ties
    if low != high:
        return first_rows(hashed, n, mark, buckets).drop(mark)
    return _copies(ties, n)


def _copies(equal: DataFrame, n: int) -> DataFrame:
    """``n`` of rows that are equal, but for the rare ones that only share their hash."""
    count, before, copy = (unused(c, equal.columns) for c in ("_count", "_before", "_copy"))
    groups = [f"`{c}`" for c in equal.columns]
    counted = equal.groupBy(*groups).agg(F.count(F.lit(1)).alias(count))
    running = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)  # a row or two
    kept = counted.withColumn(before, F.coalesce(F.sum(count).over(running), F.lit(0))).filter(F.col(before) < n)
    copies = F.sequence(F.lit(1).cast("long"), F.least(F.col(count), n - F.col(before)))
    return kept.withColumn(copy, F.explode(copies)).select(*groups)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
