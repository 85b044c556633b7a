"""Filesets and named trees: many files under dataset labels, read as one input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from partonflow.operators.selection import first_rows

Reads = Mapping[str, Sequence[str]]


def narrowed(schema: StructType, reads: Reads) -> StructType:
    """The schema with the collections in ``reads`` cut down to the named fields."""
    fields = []
    for field in schema:
        if field.name in reads:
            element = field.dataType.elementType
            kept = StructType([f for f in element if f.name in set(reads[field.name])])
            field = StructField(field.name, ArrayType(kept), field.nullable)
        fields.append(field)
    return StructType(fields)


def read_paths(
    spark: SparkSession, paths: Sequence[str], reads: Reads | None = None,
    schema: StructType | None = None, options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Parquet paths, with the collections in ``reads`` limited to the named fields.

    A lambda over a list of structs makes a scan read every field of the struct.
    Declaring the wanted fields as the read schema avoids that, and unlike
    zipping field columns together it costs nothing per row.
    """
    reader = spark.read.options(**(options or {}))
    if reads and not schema:
        schema = spark.read.parquet(*paths).schema
    if schema:
        reader = reader.schema(narrowed(schema, reads) if reads else schema)
    return reader.parquet(*paths)


def read_tree(
    spark: SparkSession, location: str, tree: str, reads: Reads | None = None
) -> DataFrame:
    """The table called ``tree`` inside a storage location."""
    return read_paths(spark, [f"{location.rstrip('/')}/{tree}"], reads)


def read_fileset(
    spark: SparkSession,
    fileset: Mapping[str, Sequence[str]],
    tree: str | None = None,
    reads: Reads | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """All files of all datasets as one DataFrame with a ``dataset`` column.

    Paths are files or directories; with ``tree`` each is a location that holds
    the tree.  The label is a literal per branch of the union, so a filter on
    ``dataset`` removes the other branches before anything is read.
    """
    parts = []
    for name, files in fileset.items():
        paths = [f"{f.rstrip('/')}/{tree}" if tree else f for f in files]
        found = read_paths(spark, paths, reads, options=options)
        parts.append(found.withColumn("dataset", F.lit(name)))
    if not parts:
        raise ValueError("the fileset names no dataset")
    return reduce(lambda a, b: a.unionByName(b), parts)


def files_by(events: DataFrame, label: str) -> dict[str | None, list[str]]:
    """The files that hold each label, NULL included, as the reader knows them.

    The mapping comes from the file of every row, not from the way a label is
    written into a folder name; it is one row per file and label.  Where ``label`` is
    a partition column that reads no data, only the number of rows of each file.
    """
    found = events.select(label, F.col("_metadata.file_path").alias("_file")).distinct().collect()
    out: dict[str | None, list[str]] = {}
    for name, file in sorted(((r[0], r[1]) for r in found), key=lambda x: (x[0] is not None, x)):
        out.setdefault(name, []).append(unquote(file))
    return out


def first_events(events: DataFrame, stop: int, key: str = "event_id") -> DataFrame:
    """The first ``stop`` events in key order, themselves in no order."""
    return first_rows(events, stop, key)


def first_chunks(
    events: DataFrame, max_chunks: int, chunk_size: int, key: str = "event_id"
) -> DataFrame:
    """The events of the first ``max_chunks`` chunks, for quick trials."""
    return first_events(events, max_chunks * chunk_size, key)


def count_entries(events: DataFrame, by: str = "dataset") -> DataFrame:
    """Number of events per dataset."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("entries"))


def count_chunks(events: DataFrame, chunk_size: int, by: str = "dataset") -> DataFrame:
    """Number of chunks of at most ``chunk_size`` events that each dataset splits into."""
    return count_entries(events, by).select(
        by, F.ceil(F.col("entries") / F.lit(chunk_size)).cast("long").alias("chunks")
    )
