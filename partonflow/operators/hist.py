"""Histograms and counters as DataFrames.

A filled histogram is a long table

    (*categories, variable, bin, n, sumw, sumw2)

with one row per non-empty bin, ``bin`` -1 for underflow and ``bins`` for
overflow.  Any number of variables share one table: filling explodes the
(variable, bin) pairs of an event once and aggregates once, so a whole analysis
costs one scan and one shuffle, and the shuffle carries at most
``categories x bins`` rows per task because of the partial aggregation.  That
also makes a dataset that holds most of the rows harmless.

A *tally* is the same table with rows of a second kind, those with variable NULL:
they stand for events.  In the simplest case they only say that a category has
events, so that one without entries shows as zeros; a full tally gives every event
such a row, which carries the event count and the counters ``c0, c1, ...``.  So
histograms, counters and entry counts of a pass come from one scan and one shuffle
and are told apart afterwards (``filled``, ``counted``, ``entries``).

NaN is no number on an axis: like NULL it is not filled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partonflow.operators.selection import unused


@dataclass(frozen=True)
class Axis:
    """``bins`` equal half-open bins over [lo, hi)."""

    name: str
    bins: int
    lo: float
    hi: float

    @property
    def width(self) -> float:
        return (self.hi - self.lo) / self.bins

    def bin_sql(self, value: str) -> str:
        """Bin number as SQL: -1 below the range, ``bins`` above it, NULL for NULL.

        As text an axis is one expression to build, not a dozen; analyses fill many.
        """
        lo, hi, width = (f"{float(x)!r}D" for x in (self.lo, self.hi, self.width))
        return (
            f"CASE WHEN {value} < {lo} THEN -1 WHEN isnan({value}) THEN NULL WHEN {value} >= {hi} THEN {self.bins} "
            f"WHEN {value} IS NOT NULL THEN "
            f"least(CAST(floor(({value} - {lo}) / {width}) AS INT), {self.bins - 1}) END"
        )

    def index(self, column: str) -> Column:
        """Bin number of a numeric column."""
        return F.expr(self.bin_sql(f"`{column}`"))


def _entries(df: DataFrame, axes: Sequence[Axis]) -> list[str]:
    """Arrays of (axis, v), one per axis, ``axis`` being its number."""
    parts = []
    for number, axis in enumerate(axes):
        value, entry = f"`{axis.name}`", f"named_struct('axis', {number}, 'v', CAST({{}} AS DOUBLE))"
        if isinstance(df.schema[axis.name].dataType, T.ArrayType):
            parts.append(f"transform({value}, v -> {entry.format('v')})")
        else:
            parts.append(f"array({entry.format(value)})")
    return parts


def _values(df: DataFrame, axes: Sequence[Axis]) -> str:
    """Generator of (axis, v): one row per entry."""
    if len(axes) == 1:
        value = f"`{axes[0].name}`"
        listed = isinstance(df.schema[axes[0].name].dataType, T.ArrayType)
        return f"explode({value if listed else f'array({value})'}) AS v"
    return f"inline(concat({', '.join(_entries(df, axes))}))"


def _binned(axes: Sequence[Axis], number: str) -> list[Column]:
    """``variable`` and ``bin`` of rows (axis, v)."""
    names = " ".join(f"WHEN {i} THEN '{a.name}'" for i, a in enumerate(axes))
    bins = " ".join(f"WHEN {i} THEN {a.bin_sql('v')}" for i, a in enumerate(axes))
    return [F.expr(f"CASE {number} {names} END").alias("variable"), F.expr(f"CASE {number} {bins} END").alias("bin")]


def _sums(weight: str | None) -> list[Column]:
    n = F.count(F.lit(1))
    if not weight:
        return [n.alias("n"), n.cast("double").alias("sumw"), n.cast("double").alias("sumw2")]
    return [n.alias("n"), F.sum("w").alias("sumw"), F.sum(F.col("w") * F.col("w")).alias("sumw2")]


def fill(
    df: DataFrame,
    axes: Sequence[Axis],
    by: Sequence[str] = ("dataset",),
    weight: str | None = None,
) -> DataFrame:
    """Histogram of the columns named like the axes; list columns fill once per element.

    Values are exploded first and binned afterwards, so that binning runs in
    generated code.  The generator also keeps the NULL test from being pushed
    into the expression of the value, which would compute it twice.
    """
    carried = [F.col(weight).cast("double").alias("w")] if weight else []
    values = df.select(*by, *carried, F.expr(_values(df, axes))).filter("v IS NOT NULL AND NOT isnan(v)")
    number = "CAST(0 AS INT)" if len(axes) == 1 else "axis"
    rows = values.select(*by, *(["w"] if weight else []), *_binned(axes, number))
    return rows.groupBy(*by, "variable", "bin").agg(*_sums(weight))


def tally(
    df: DataFrame,
    axes: Sequence[Axis],
    by: Sequence[str] = ("dataset",),
    weight: str | None = None,
    counters: Sequence[Column] | None = None,
    only: str | None = None,
) -> DataFrame:
    """Histogram and event rows of one pass.

    Without ``counters`` an event row says no more than that its category has
    events.  With them (an empty list will do) every event adds one to ``n`` of the
    event row of its category and what the counters say to ``c0, c1, ...``.
    ``only`` names a column that is true for events that have entries at all.
    """
    if counters is None and len(axes) == 1:
        listed = isinstance(df.schema[axes[0].name].dataType, T.ArrayType)
        value = f"`{axes[0].name}`" if listed else f"array(`{axes[0].name}`)"
        entries = f"explode_outer({f'CASE WHEN `{only}` THEN {value} END' if only else value}) AS v"
        rows = df.select(*by, *([F.col(weight).cast("double").alias("w")] if weight else []), F.expr(entries))
        number = "CASE WHEN v IS NULL OR isnan(v) THEN -1 ELSE 0 END"
        return rows.select(*by, *(["w"] if weight else []), *_binned(axes, number)).groupBy(*by, "variable", "bin").agg(*_sums(weight))
    entries = f"concat({', '.join(_entries(df, axes))})" if axes else "NULL"
    if only:
        entries = f"CASE WHEN `{only}` THEN {entries} END"
    if counters is not None:
        alone = "array(named_struct('axis', -1, 'v', CAST(NULL AS DOUBLE)))"
        entries = f"concat({alone}, coalesce({entries}, array()))" if axes else alone
    carried = [F.col(weight).cast("double").alias("w")] if weight else []
    added = [c.cast("long").alias(f"c{i}") for i, c in enumerate(counters or ())]
    values = df.select(*by, *carried, *added, F.expr(f"inline_outer({entries})"))
    event = "axis = -1" if counters is not None else "axis IS NULL OR v IS NULL OR isnan(v)"
    rows = values.filter("axis = -1 OR (v IS NOT NULL AND NOT isnan(v))") if counters is not None else values
    ones = [F.expr(f"CASE WHEN axis = -1 THEN c{i} END").alias(f"c{i}") for i in range(len(added))]
    named = _binned(axes, f"CASE WHEN {event} THEN -1 ELSE axis END") if axes else [
        F.lit(None).cast("string").alias("variable"), F.lit(None).cast("int").alias("bin")
    ]
    marked = rows.select(*by, *(["w"] if weight else []), *ones, *named)
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(len(added))]
    return marked.groupBy(*by, "variable", "bin").agg(*_sums(weight), *sums)


def filled(told: DataFrame) -> DataFrame:
    """The histogram rows of a tally."""
    return told.filter("variable IS NOT NULL").drop(*[c for c in told.columns if c[0] == "c" and c[1:].isdigit()])


def entries(told: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Number of events per category of a full tally, counted before any cut."""
    return told.filter("variable IS NULL").groupBy(*by).agg(F.sum("n").alias("entries"))


def counted(told: DataFrame, steps: Sequence[str], by: Sequence[str] = ("dataset",), chunk_size: int | None = None) -> DataFrame:
    """The counters of a full tally as rows (*by, step_no, step, n).

    ``chunk_size`` adds the number of chunks that a category's events split into.
    """
    sums = told.filter("variable IS NULL").groupBy(*by).agg(
        F.sum("n").alias("_events"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(steps))]
    )
    rows = [(s, F.col(f"c{i}")) for i, s in enumerate(steps)]
    if chunk_size:
        rows.append(("number of chunks", F.ceil(F.col("_events") / chunk_size).cast("long")))
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), c.alias("n")) for i, (s, c) in enumerate(rows)]))
    return sums.select(*by, listed.alias("row")).select(*by, "row.*")


def _axis_value(axes: Sequence[Axis], pick: Callable[[Axis], str]) -> Column:
    """SQL value chosen by the variable of the row."""
    cases = " ".join(f"WHEN '{a.name}' THEN {pick(a)}" for a in axes)
    return F.expr(f"CASE variable {cases} END")


def edges(hist: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Add the ``lo`` and ``hi`` edge of each visible bin."""
    low = _axis_value(axes, lambda a: f"{float(a.lo)!r}D + bin * {a.width!r}D")
    high = _axis_value(axes, lambda a: f"{float(a.lo)!r}D + (bin + 1) * {a.width!r}D")
    return hist.withColumns({"lo": low, "hi": high})


def visible(hist: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Rows inside the axis range, with their edges."""
    bins = _axis_value(axes, lambda a: str(a.bins))
    return edges(hist.filter((F.col("bin") >= 0) & (F.col("bin") < bins)), axes)


def flow(hist: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Entries outside the axis range, labelled ``underflow`` / ``overflow``."""
    bins = _axis_value(axes, lambda a: str(a.bins))
    side = F.when(F.col("bin") < 0, "underflow").when(F.col("bin") >= bins, "overflow")
    return hist.withColumn("side", side).filter(F.col("side").isNotNull())


def _everywhere(told: DataFrame, axes: Sequence[Axis], declared: Mapping[str, Sequence[str]]) -> DataFrame:
    """Event rows turned into empty rows of every variable, and of every declared category that they leave open."""
    event = F.col("variable").isNull()
    names = F.array(*[F.lit(a.name) for a in axes])
    out = told.withColumn("variable", F.explode(F.when(event, names).otherwise(F.array("variable"))))
    for column, values in declared.items():
        open_ = F.col("bin").isNull() & F.col(column).isNull()
        out = out.withColumn(column, F.explode(F.when(open_, F.array(*map(F.lit, values))).otherwise(F.array(column))))
    return out


def dense(
    told: DataFrame, axes: Sequence[Axis], by: Sequence[str] = ("dataset",), declared: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Every visible bin of every category, empty ones as 0.

    Of a histogram those are the categories that it holds; of a tally all that have
    events.  ``declared`` lists the values of categories that events get only by
    passing the cuts.  The bins of one category are folded into a map (at most
    ``bins + 2`` entries) and read back per bin number, which needs no cross join.
    """
    cell = F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct("n", "sumw", "sumw2")))
    last = _axis_value(axes, lambda a: str(a.bins - 1))
    rows = _everywhere(told, axes, declared or {})
    per_category = rows.groupBy(*by, "variable").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    spread = per_category.select(
        *by, "variable", "cells", F.explode(F.sequence(F.lit(0), last)).alias("bin")
    )
    cell = F.try_element_at("cells", F.col("bin"))
    filled = spread.select(
        *by,
        "variable",
        "bin",
        F.coalesce(cell["n"], F.lit(0)).cast("long").alias("n"),
        F.coalesce(cell["sumw"], F.lit(0.0)).alias("sumw"),
        F.coalesce(cell["sumw2"], F.lit(0.0)).alias("sumw2"),
    )
    return edges(filled, axes)


def scaled(
    told: DataFrame, cross_sections: dict[str, float], luminosity: float, category: str = "dataset"
) -> DataFrame:
    """The histogram of a full tally times luminosity x cross-section / number of events of its category.

    Both come from the tally, so no second pass counts the events.  The window is
    over merged rows, at most the bins of a category.  Categories without a cross-section drop out.
    """
    xsec = F.try_element_at(lookup_map(cross_sections), F.col(category))
    events = F.sum(F.when(F.col("variable").isNull(), F.col("n"))).over(Window.partitionBy(category))
    weighted = told.withColumn("weight", F.lit(float(luminosity)) * xsec / events)
    return (
        filled(weighted)
        .filter("weight IS NOT NULL")
        .withColumn("sumw", F.col("sumw") * F.col("weight"))
        .withColumn("sumw2", F.col("sumw2") * F.col("weight") * F.col("weight"))
        .drop("weight")
    )


def merge(*hists: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Sum of partial histograms, whatever the split of the events was."""
    union = hists[0]
    for h in hists[1:]:
        union = union.unionByName(h)
    return union.groupBy(*by, "variable", "bin").agg(
        F.sum("n").alias("n"), F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2")
    )


def rebin(hist: DataFrame, factor: int, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Merge ``factor`` neighbouring visible bins."""
    coarse = hist.withColumn("bin", F.floor(F.col("bin") / F.lit(factor)).cast("int"))
    return merge(coarse, by=by)


def lookup_map(values: dict[str, float | str]) -> Column:
    """Literal map from configuration."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def scale(
    hist: DataFrame,
    entries: DataFrame,
    cross_sections: dict[str, float],
    luminosity: float,
    category: str = "dataset",
) -> DataFrame:
    """Histogram times luminosity x cross-section / entries of its category.

    ``entries`` has one row per category, (category, entries), counted before
    any cut.  Categories without a cross-section drop out.
    """
    xsec = F.try_element_at(lookup_map(cross_sections), F.col(category))
    weights = entries.select(
        category, (F.lit(float(luminosity)) * xsec / F.col("entries")).alias("weight")
    ).filter(F.col("weight").isNotNull())
    return (
        hist.join(weights, category)
        .withColumn("sumw", F.col("sumw") * F.col("weight"))
        .withColumn("sumw2", F.col("sumw2") * F.col("weight") * F.col("weight"))
        .drop("weight")
    )


def regroup(
    hist: DataFrame, groups: dict[str, str], category: str, new: str, by: Sequence[str] = ()
) -> DataFrame:
    """Merge categories into named groups; categories without a group drop out."""
    label = F.try_element_at(lookup_map(groups), F.col(category))
    named = hist.withColumn(new, label).filter(F.col(new).isNotNull())
    return merge(named.drop(category), by=(new, *by))


def stacked(
    hist: DataFrame, category: str = "dataset", within: Sequence[str] = ("variable", "bin")
) -> DataFrame:
    """Running total over the categories of each bin, in category order.

    The window holds one row per category, so its size does not grow with the data.
    """
    w = Window.partitionBy(*within).orderBy(category).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return hist.withColumn("stacked", F.sum("n").over(w))


def overlaid(
    hist: DataFrame, categories: Sequence[str], category: str = "dataset"
) -> DataFrame:
    """One column per category, one row per bin; the missing category, None, is the column ``(none)``."""
    missing = unused("(none)", [c for c in categories if c is not None])
    names = [missing if c is None else c for c in categories]
    named = hist.withColumn(category, F.coalesce(category, F.lit(missing)))
    return named.groupBy("variable", "bin").pivot(category, names).agg(F.sum("n")).na.fill(0)


def cutflow(
    df: DataFrame, steps: dict[str, Column], by: Sequence[str] = ("dataset",), chunk_size: int | None = None
) -> DataFrame:
    """Counters as rows (*by, step_no, step, n).

    Each step is the number that one event adds.  All counters come from one
    aggregation over one scan.
    """
    return counted(tally(df, (), by, counters=list(steps.values())), list(steps), by, chunk_size)


def fill_joint(
    df: DataFrame,
    axes: Sequence[Axis],
    by: Sequence[str] = ("dataset",),
    weight: str | None = None,
) -> DataFrame:
    """Histogram with several regular axes at once, one ``<axis>_bin`` column each.

    The axis columns hold numbers; rows where any of them is NULL are not filled.
    """
    bins = [a.index(a.name).alias(f"{a.name}_bin") for a in axes]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*by, F.inline(F.array(F.struct(*bins, w.alias("w"))))).na.drop(
        subset=[f"{a.name}_bin" for a in axes]
    )
    return rows.groupBy(*by, *[f"{a.name}_bin" for a in axes]).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("w").alias("sumw"),
        F.sum(F.col("w") * F.col("w")).alias("sumw2"),
    )
