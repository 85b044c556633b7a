"""User accumulators: named numbers that add up, and states with a merge of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Update = Callable[[pd.DataFrame], dict[str, float]]


def accumulate(df: DataFrame, by: str, fields: tuple[str, ...], update: Update) -> DataFrame:
    """Sum over all chunks of what ``update`` returns for each chunk, per value of ``by``.

    ``update`` sees one Arrow batch of one category at a time and returns the
    named numbers it adds; NULL is a category like any other.  Batches become one partial row each; the merge is
    Spark's own sum, so no category is ever gathered in one place.
    """
    schema = ", ".join([f"`{by}` string", *[f"`{f}` double" for f in fields]])

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, chunk in batch.groupby(by, dropna=False):
                added = update(chunk)
                rows.append([None if pd.isna(key) else key, *[float(added.get(f, 0.0)) for f in fields]])
            yield pd.DataFrame(rows, columns=[by, *fields])

    return (
        df.mapInPandas(partials, schema)
        .groupBy(by)
        .agg(*[F.sum(f).alias(f) for f in fields])
    )


class Accumulator:
    """A user's own mergeable state, for what sums of numbers cannot hold.

    ``add`` takes in one Arrow batch of one category, ``merge`` joins two states.
    Merging must not depend on order or grouping, and ``identity`` must change
    nothing.  A state travels pickled and must stay of bounded size.
    """

    #: Columns of the result, as DDL.
    schema: str = ""

    def identity(self):
        raise NotImplementedError

    def add(self, state, chunk: pd.DataFrame):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def result(self, state) -> dict:
        raise NotImplementedError


def accumulate_state(df: DataFrame, by: str, accumulator: Accumulator, fan_in: int = 64, levels: int = 2) -> DataFrame:
    """One row per value of ``by``, NULL included: the key and the result of all its merged states.

    Every task keeps one state per key and hands them on at its end.  They are
    merged as a tree: at each level at most ``fan_in`` states of a key meet, those
    of neighbouring tasks, and then the rest, tasks / fan_in ** levels of them.  So a
    key that is in all tasks is merged by many.
    """
    kind = df.schema[by].dataType.simpleString()

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        from pyspark import TaskContext

        states: dict = {}
        for batch in batches:
            for key, chunk in batch.groupby(by, dropna=False):
                key = None if pd.isna(key) else key
                states[key] = accumulator.add(states[key] if key in states else accumulator.identity(), chunk)
        if states:
            task = TaskContext.get().partitionId()
            yield pd.DataFrame({"key": pd.Series(list(states), dtype=object), "task": task, "state": [pickle.dumps(s) for s in states.values()]})

    def joined(frame: pd.DataFrame):
        import pickle

        state = accumulator.identity()
        for packed in frame["state"]:
            state = accumulator.merge(state, pickle.loads(packed))
        return state

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        import pickle

        return pd.DataFrame({"key": frame["key"].iloc[:1], "task": frame["task"].iloc[:1], "state": [pickle.dumps(joined(frame))]})

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        out = accumulator.result(joined(frame))
        return pd.DataFrame({by: frame["key"].iloc[:1].tolist(), **{name: [value] for name, value in out.items()}})

    schema = f"key {kind}, task int, state binary"
    states = df.mapInPandas(partials, schema)
    for _ in range(levels):
        states = states.withColumn("task", F.floor(F.col("task") / fan_in).cast("int"))
        states = states.groupBy("key", "task").applyInPandas(merged, schema)
    return states.groupBy("key").applyInPandas(finished, f"`{by}` {kind}, {accumulator.schema}")
