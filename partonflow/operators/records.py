"""Projection of collections: narrowing, added fields, common types, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def narrow(collection: str, *fields: str) -> Column:
    """The collection reduced to ``fields``.

    For frames whose reader could not be told which fields are wanted.  A lambda
    over a whole list of structs makes the scan read every field of the struct;
    zipping the wanted field columns first keeps nested column pruning working.
    The zip costs time per row, so prefer ``reads`` when reading from files.
    """
    return F.arrays_zip(*[F.col(f"{collection}.{f}").alias(f) for f in fields]).alias(collection)


def with_field(items: Column, name: str, value: Column) -> Column:
    """Each element with one more field."""
    return F.transform(items, lambda x: x.withField(name, value))


def as_type(items: Column, fields: dict[str, str], **constants: Column) -> Column:
    """Elements projected to one struct type, so that two collections can be joined up.

    ``fields`` maps field name to type name; ``constants`` supplies values that
    the collection itself lacks.
    """

    def project(x: Column) -> Column:
        return F.struct(
            *[
                (constants[name] if name in constants else x[name]).cast(dtype).alias(name)
                for name, dtype in fields.items()
            ]
        )

    return F.transform(items, project)


def concat(*collections: Column) -> Column:
    """Per-event concatenation of collections of one common struct type."""
    return F.concat(*collections)


def follow(items: Column, target: Column, index_field: str, name: str) -> Column:
    """Each element with the element of ``target`` its index field points at, or NULL."""
    return F.transform(items, lambda x: x.withField(name, F.get(target, x[index_field])))


def counts_differ(df: DataFrame, lists: str, count: str) -> DataFrame:
    """Events whose list length differs from the stored count."""
    return df.filter(F.size(F.col(lists)) != F.col(count))


def with_counts(events: DataFrame) -> DataFrame:
    """Events with ``n<Collection>`` of every list of records that has no stored count."""
    lists = [f.name for f in events.schema if isinstance(f.dataType, T.ArrayType)]
    return events.withColumns({f"n{c}": F.size(c) for c in lists if f"n{c}" not in events.columns})


def settle(df: DataFrame, keep: tuple[str, ...], columns: dict[str, Column], when: Column | None = None) -> DataFrame:
    """Compute ``columns`` once per row and carry ``keep`` along; NULL where ``when`` does not hold.

    Filters on computed columns are normally pushed below the projection by
    substituting the expression, once per use, which repeats list work.  A
    one-element ``inline`` is not a projection, so later steps see plain columns.
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*keep, F.inline(row) if when is None else F.inline_outer(F.when(when, row)))
