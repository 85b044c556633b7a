"""The analysis interface.

An analysis declares its axes and builds plans; it never touches rows.

* ``prepare(events)`` returns one row per event with the category columns and
  whatever the values and counters are computed from;
* ``values()`` gives a number or a list of numbers per axis, NULL meaning "no entry";
* ``counters()`` names the cutflow steps and what one event adds to each;
* ``candidates()`` is a cheap condition that every event with an entry meets;
* ``reads`` lists the collection fields in use;
* ``postprocess(hist)`` adjusts the merged histogram.

Rejected events stay, with NULL values, so one pass over the input gives the
histograms, the counters and the number of events of every category, also of those
where nothing passes.  Where only filled bins are wanted, ``histogram`` drops events that
are no candidates, which a reader can do by its statistics.  The same plans serve
batch and streaming input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partonflow.operators.hist import Axis, counted, cutflow, dense, entries, fill, filled, tally
from partonflow.operators.records import with_counts
from partonflow.sources.fileset import read_fileset
from partonflow.sources.scratch import settled


class Analysis:
    axes: Sequence[Axis] = ()
    by: Sequence[str] = ("dataset",)
    #: Categories of the counters.
    counted_by: Sequence[str] = ("dataset",)
    weight: str | None = None
    #: Fields of each collection in use, for readers that can skip the others.
    reads: Mapping[str, Sequence[str]] = {}
    #: Values of the categories that an event gets only by passing.
    categories: Mapping[str, Sequence[str]] = {}
    #: Column of the prepared events that is true for those with entries.
    only: str | None = None
    #: With a chunk size the cutflow also tells the number of chunks.
    chunk_size: int | None = None

    def candidates(self) -> Column | None:
        return None

    def prepare(self, events: DataFrame) -> DataFrame:
        return events

    def prepare_values(self, events: DataFrame) -> DataFrame:
        """The same where no counters are wanted; may leave out work on events that are no candidates."""
        return self.prepare(events)

    def values(self) -> dict[str, Column]:
        return {axis.name: F.col(axis.name) for axis in self.axes}

    def counters(self) -> dict[str, Column]:
        return {}

    def postprocess(self, hist: DataFrame) -> DataFrame:
        return hist

    def _measured(self, prepared: DataFrame, *more: Column) -> DataFrame:
        extra = [c for c in (self.weight, self.only) if c]
        return prepared.select(*self.by, *extra, *[v.alias(k) for k, v in self.values().items()], *more)

    def process(self, events: DataFrame) -> DataFrame:
        """The values of every candidate."""
        events, chosen = with_counts(events), self.candidates()
        return self._measured(self.prepare(events if chosen is None else events.filter(chosen)))

    def tally(self, events: DataFrame, full: bool = False, counters: bool = True) -> DataFrame:
        """Everything of one pass as one table (``operators.hist``); with event counts if ``full``, and with the counters."""
        events = with_counts(events)
        if not full:
            return tally(self._measured(self.prepare_values(events)), self.axes, self.by, self.weight, only=self.only)
        added = self.counters().values() if counters else ()
        steps = [c.cast("long").alias(f"_c{i}") for i, c in enumerate(added)]
        measured = self._measured(self.prepare(events) if added else self.prepare_values(events), *steps)
        return tally(measured, self.axes, self.by, self.weight, [F.col(f"_c{i}") for i in range(len(steps))], self.only)

    def histogram(self, events: DataFrame) -> DataFrame:
        """Merged histogram with flow bins, empty bins left out."""
        return self.postprocess(fill(self.process(events), self.axes, self.by, self.weight))

    def _dense(self, told: DataFrame) -> DataFrame:
        empty = told.filter("variable IS NULL").select(filled(told).columns)
        return dense(self.postprocess(filled(told)).unionByName(empty, allowMissingColumns=True), self.axes, self.by, self.categories)

    def dense_histogram(self, events: DataFrame) -> DataFrame:
        """Visible bins only, empty bins and categories without entries present."""
        if type(self).postprocess is Analysis.postprocess:
            return dense(self.tally(events), self.axes, self.by, self.categories)
        return self._dense(settled(self.tally(events), "tally"))

    def cutflow(self, events: DataFrame) -> DataFrame:
        return cutflow(self.prepare(with_counts(events)), self.counters(), self.counted_by, self.chunk_size)

    def results(self, told: DataFrame) -> dict[str, DataFrame]:
        """What a full, stored tally holds: the histogram, the counters if there are any, and the entry counts."""
        out = {"hist": self._dense(told), "entries": entries(told, self.counted_by)}
        if self.counters():
            out["cutflow"] = counted(told, list(self.counters()), self.counted_by, self.chunk_size)
        return out

    def run(self, events: DataFrame) -> dict[str, DataFrame]:
        """All results from one pass over the events, which is made here; they are small tables."""
        return self.results(settled(self.tally(events, full=True), "tally"))


def run(
    spark: SparkSession, fileset: Mapping[str, Sequence[str]], tree: str | None, analysis: Analysis
) -> dict[str, DataFrame]:
    """Run an analysis over the files of a fileset; ``tree`` is the table inside each location."""
    return analysis.run(read_fileset(spark, fileset, tree, analysis.reads))
