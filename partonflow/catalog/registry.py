"""Registry of queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from partonflow.plans.analysis import Analysis
from partonflow.sources.branches import zip_collections
from partonflow.sources.detector import event_location, read_branches, read_events


@dataclass(frozen=True)
class Inputs:
    """What a query can read: the tables under ``sf_dir`` and the event tree made of them."""

    spark: SparkSession
    sf_dir: str

    @property
    def location(self) -> str:
        return event_location(self.spark, self.sf_dir)

    @property
    def events(self) -> DataFrame:
        return read_events(self.spark, self.sf_dir)

    def reading(self, **collections: Sequence[str]) -> DataFrame:
        """The event tree with these collections limited to the named fields."""
        return read_events(self.spark, self.sf_dir, collections)

    def events_for(self, analysis: Analysis) -> DataFrame:
        return read_events(self.spark, self.sf_dir, analysis.reads)

    @property
    def branches(self) -> DataFrame:
        """The events as they are stored in flat branches."""
        return read_branches(self.spark, self.sf_dir)

    def zipped(self, **wanted: Sequence[str]) -> DataFrame:
        """Collections zipped from the flat branches of these fields."""
        return zip_collections(self.branches, ("event_id", "dataset"), wanted)


Query = Callable[[Inputs], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its reference SQL."""

    def add(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn

    return add


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))

    return {name: bind(fn) for name, fn in _queries.items()}


def reference_sql() -> dict[str, str]:
    return dict(_sql)
