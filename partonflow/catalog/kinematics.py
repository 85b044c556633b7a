"""Kinematic functions, one query per function, and the user-code interfaces."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partonflow.catalog import sql as q
from partonflow.catalog.combinations import MUONS, P4, PAIRS, muon_vectors
from partonflow.catalog.elements import POS, leptons, per_event
from partonflow.catalog.registry import Inputs, query
from partonflow.functions import lists, p4
from partonflow.functions.vectorised import arrow_function
from partonflow.operators import combine
from partonflow.operators.accumulate import Accumulator, accumulate, accumulate_state
from partonflow.operators.hist import Axis, lookup_map
from partonflow.operators.records import settle
from partonflow.plans.analysis import Analysis

#: Every muon pair of an event, with the positions of both.
PAIR_ROWS = "a.event_id, CAST(a.idx AS INTEGER) AS i, CAST(b.idx AS INTEGER) AS j"


def muon_pairs(events: DataFrame, muons: Column, **values: Callable[[Column, Column], Column]) -> DataFrame:
    """A row (event_id, i, j, values) for every pair of muons i < j; the values are functions of both."""

    def row(i: Column, j: Column, a: Column, b: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), *[p4.stable(f(a, b)).alias(n) for n, f in values.items()])

    both = events.filter(F.col("nMuon") >= 2)
    return both.select("event_id", F.inline(combine.arg_pairs(muons, row)))


def of_vectors(inputs: Inputs, **values: Callable[[Column, Column], Column]) -> DataFrame:
    return muon_pairs(inputs.reading(**MUONS), muon_vectors(), **values)


def of_fields(inputs: Inputs, fields: tuple[str, ...], value: Callable[[Column, Column], Column]) -> DataFrame:
    return muon_pairs(inputs.reading(Muon=fields), F.col("Muon"), value=value)


def one_value(df: DataFrame, value: Column) -> DataFrame:
    return per_event(df, value=p4.stable(value))


@query(
    "p4_xyz", q.sql(f"SELECT {POS}, round(px, 6) AS x, round(py, 6) AS y, round(pz, 6) AS z FROM jet")
)
def p4_xyz(inputs: Inputs) -> DataFrame:
    vectors = p4.with_cartesian(F.col("Jet"))
    rows = inputs.reading(Jet=P4).select("event_id", F.posexplode(vectors).alias("pos", "v"))
    return rows.select(
        "event_id", "pos", *[F.round(f"v.{c}", 6).alias(c[1]) for c in ("px", "py", "pz")]
    )


@query("p4_energy", q.sql(f"SELECT {POS}, round(e, 6) AS energy FROM jet"))
def p4_energy(inputs: Inputs) -> DataFrame:
    energies = F.transform("Jet", p4.energy)
    rows = inputs.reading(Jet=P4).select("event_id", F.posexplode(energies).alias("pos", "energy"))
    return rows.withColumn("energy", F.round("energy", 6))


@query(
    "p4_add",
    q.sql(
        f"SELECT {PAIR_ROWS}, round(a.px + b.px, 6) AS px, round(a.py + b.py, 6) AS py, "
        f"round(a.pz + b.pz, 6) AS pz, round(a.e + b.e, 6) AS e {PAIRS}"
    ),
)
def p4_add(inputs: Inputs) -> DataFrame:
    parts = {c: (lambda a, b, c=c: p4.add(a, b)[c]) for c in p4.COMPONENTS}
    return of_vectors(inputs, **parts)


@query("p4_mass", q.sql(f"SELECT {PAIR_ROWS}, {q.mass('a', 'b')} AS value {PAIRS}"))
def p4_mass(inputs: Inputs) -> DataFrame:
    return of_vectors(inputs, value=p4.mass)


@query("p4_pt_of_sum", q.sql(f"SELECT {PAIR_ROWS}, {q.pt('a', 'b')} AS value {PAIRS}"))
def p4_pt_of_sum(inputs: Inputs) -> DataFrame:
    return of_vectors(inputs, value=p4.pt)


@query(
    "delta_phi_wrapped",
    q.sql(f"SELECT {PAIR_ROWS}, round({q.dphi('a.phi', 'b.phi')}, 6) AS value {PAIRS}"),
)
def delta_phi_wrapped(inputs: Inputs) -> DataFrame:
    return of_fields(inputs, ("phi",), lambda a, b: p4.delta_phi(a["phi"], b["phi"]))


@query("delta_phi_raw", q.sql(f"SELECT {PAIR_ROWS}, round(abs(a.phi - b.phi), 6) AS value {PAIRS}"))
def delta_phi_raw(inputs: Inputs) -> DataFrame:
    return of_fields(inputs, ("phi",), lambda a, b: p4.delta_phi_raw(a["phi"], b["phi"]))


@query("delta_r", q.sql(f"SELECT {PAIR_ROWS}, {q.dr('a', 'b')} AS value {PAIRS}"))
def delta_r(inputs: Inputs) -> DataFrame:
    return of_fields(inputs, ("eta", "phi"), p4.delta_r)


@query("delta_eta", q.sql(f"SELECT {PAIR_ROWS}, round(abs(a.eta - b.eta), 6) AS value {PAIRS}"))
def delta_eta(inputs: Inputs) -> DataFrame:
    return of_fields(inputs, ("eta",), p4.delta_eta)


MT_SQL = f"round(sqrt(2e0 * met_pt * pt * (1e0 - cos({q.dphi('met_phi', 'phi')}))), 6)"


@query("transverse_mass", q.sql(f"SELECT {POS}, {MT_SQL} AS value FROM ev JOIN mu USING (event_id)"))
def transverse_mass(inputs: Inputs) -> DataFrame:
    """MET with every muon."""
    muons = inputs.reading(Muon=("pt", "phi"))
    rows = muons.select("event_id", F.col("MET").alias("m"), F.posexplode("Muon").alias("pos", "a"))
    mt = p4.transverse_mass(F.col("m.pt"), F.col("a.pt"), p4.delta_phi(F.col("m.phi"), F.col("a.phi")))
    return rows.select("event_id", "pos", p4.stable(mt).alias("value"))


@query(
    "elementwise_max",
    q.sql(
        "SELECT a.event_id, CAST(a.idx AS INTEGER) AS i, CAST(b.idx AS INTEGER) AS j, CAST(c.idx AS INTEGER) AS k, "
        "greatest(a.btag, b.btag, c.btag) AS value FROM jet a JOIN jet b "
        "ON a.event_id = b.event_id AND a.idx < b.idx JOIN jet c ON c.event_id = b.event_id AND b.idx < c.idx"
    ),
)
def elementwise_max(inputs: Inputs) -> DataFrame:
    """Largest b-tag of every jet triple."""

    def row(i: Column, j: Column, k: Column, a: Column, b: Column, c: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), k.alias("k"), p4.elementwise_max(a, b, c).alias("value"))

    three = inputs.events.filter(F.col("nJet") >= 3)
    return three.select("event_id", F.inline(combine.arg_triples(F.col("Jet.btag"), row)))


@query(
    "math_functions",
    q.sql(
        f"SELECT event_id, round(abs(met_phi), 6) AS a, round(sqrt(met_pt), 6) AS s, "
        f"round(cos(met_phi), 6) AS c, round(met_phi / {q.PI}, 6) AS turns FROM ev"
    ),
)
def math_functions(inputs: Inputs) -> DataFrame:
    """abs, sqrt, cos and pi."""
    phi = F.col("MET.phi")
    return per_event(
        inputs.events,
        a=p4.stable(F.abs(phi)),
        s=p4.stable(F.sqrt("MET.pt")),
        c=p4.stable(F.cos(phi)),
        turns=p4.stable(phi / F.pi()),
    )


@query(
    "scalar_sum_ht",
    q.per_event(
        "round(coalesce(sum(pt), 0), 6)", "jet ON jet.event_id = ev.event_id AND jet.pt > 25"
    ),
)
def scalar_sum_ht(inputs: Inputs) -> DataFrame:
    hard = lists.keep(F.col("Jet.pt"), lambda pt: pt > 25)
    return one_value(inputs.events, lists.total(hard))


@query(
    "total_charge",
    q.per_event(
        "CAST(coalesce(sum(charge), 0) AS BIGINT)",
        "obj ON obj.event_id = ev.event_id AND obj.coll > 0",
    ),
)
def total_charge(inputs: Inputs) -> DataFrame:
    charges = F.concat(F.col("Muon.charge"), F.col("Electron.charge"))
    return per_event(inputs.events, value=lists.total_int(charges))


@query(
    "flavour_code",
    q.sql(
        "SELECT event_id, CASE sum(coll - 1) WHEN 0 THEN 'mumu' WHEN 1 THEN 'emu' ELSE 'ee' END "
        "AS kind FROM obj WHERE coll > 0 GROUP BY 1 HAVING count(*) = 2"
    ),
)
def flavour_code(inputs: Inputs) -> DataFrame:
    """Sum of flavour tags of events with two leptons: 0 mumu, 1 emu, 2 ee."""
    events = inputs.reading(Muon=("pt",), Electron=("pt",))
    two = events.filter(F.col("nMuon") + F.col("nElectron") == 2)
    tagged = settle(two, ("event_id",), {"l": leptons("pt")})
    code = lists.total_int(F.col("l.flavor"))
    return per_event(tagged, kind=F.when(code == 0, "mumu").when(code == 1, "emu").otherwise("ee"))


# --- user code --------------------------------------------------------------------


class MuonSpectrum(Analysis):
    """Example of a user analysis: pt and abs(eta) of all muons, as entries per unit of the axis."""

    axes = (Axis("muon_pt", 60, 0, 120), Axis("muon_abs_eta", 25, 0, 2.5))
    reads = {"Muon": ("pt", "eta")}

    def values(self) -> dict[str, Column]:
        return {"muon_pt": F.col("Muon.pt"), "muon_abs_eta": F.transform("Muon.eta", F.abs)}

    def postprocess(self, histogram: DataFrame) -> DataFrame:
        """Sums of weights divided by the width of a bin."""
        width = F.element_at(lookup_map({a.name: a.width for a in self.axes}), F.col("variable"))
        return histogram.withColumn("sumw", F.col("sumw") / width).withColumn("sumw2", F.col("sumw2") / (width * width))


@query(
    "processor_api",
    q.sql(
        "SELECT dataset, variable, bin, n, sumw / width AS sumw, sumw2 / (width * width) AS sumw2 FROM hist",
        fills="SELECT dataset, 'muon_pt' AS variable, pt AS v FROM mu JOIN ev USING (event_id) "
        "UNION ALL SELECT dataset, 'muon_abs_eta', abs(eta) FROM mu JOIN ev USING (event_id)",
        **q.binned(MuonSpectrum.axes, ("dataset",)),
    ),
)
def processor_api(inputs: Inputs) -> DataFrame:
    return MuonSpectrum().histogram(inputs.events_for(MuonSpectrum()))


@query(
    "accumulator_udaf",
    q.sql(
        "SELECT dataset, CAST(count(*) AS DOUBLE) AS events, "
        "CAST(count(*) FILTER (met_pt > 100) AS DOUBLE) AS hard, "
        "CAST(coalesce(sum(n) FILTER (met_pt > 100), 0) AS DOUBLE) AS hard_jets FROM ev LEFT JOIN "
        "(SELECT event_id, count(*) AS n FROM jet GROUP BY 1) USING (event_id) GROUP BY 1"
    ),
)
def accumulator_udaf(inputs: Inputs) -> DataFrame:
    """User accumulator over Arrow batches, merged by Spark."""

    def numbers(chunk: pd.DataFrame) -> dict[str, float]:
        hard = chunk["met"] > 100
        return {"events": len(chunk), "hard": hard.sum(), "hard_jets": chunk["jets"][hard].sum()}

    rows = inputs.events.select(
        "dataset", F.col("MET.pt").alias("met"), F.col("nJet").alias("jets")
    )
    return accumulate(rows, "dataset", ("events", "hard", "hard_jets"), numbers)


class MetSpread(Accumulator):
    """A user's own histogram of MET, with the smallest and the largest value and a sum in whole thousandths."""

    schema = "n long, low double, high double, total long, fullest int, in_fullest long"
    bins, width = 40, 5.0

    def identity(self) -> dict:
        return {"low": None, "high": None, "total": 0, "counts": {}}

    def add(self, state: dict, chunk: pd.DataFrame) -> dict:
        met = chunk["met"].dropna().to_numpy()
        if not len(met):
            return state
        numbers, n = np.unique(np.minimum(met // self.width, self.bins).astype(int), return_counts=True)
        added = {"low": met.min(), "high": met.max(), "total": int(np.floor(met * 1000 + 0.5).astype(np.int64).sum())}
        return self.merge(state, added | {"counts": dict(zip(numbers.tolist(), n.tolist()))})

    def merge(self, a: dict, b: dict) -> dict:
        known = lambda k: [s[k] for s in (a, b) if s[k] is not None]
        counts = {k: a["counts"].get(k, 0) + b["counts"].get(k, 0) for k in {*a["counts"], *b["counts"]}}
        low, high = min(known("low"), default=None), max(known("high"), default=None)
        return {"low": low, "high": high, "total": a["total"] + b["total"], "counts": counts}

    def result(self, state: dict) -> dict:
        counts = state["counts"]
        fullest = min(counts, key=lambda k: (-counts[k], k), default=None)
        return {
            "n": sum(counts.values()), "low": state["low"], "high": state["high"], "total": state["total"],
            "fullest": fullest, "in_fullest": counts.get(fullest, 0),
        }


@query(
    "accumulator_state",
    q.sql(
        "SELECT dataset, CAST(sum(c) AS BIGINT) AS n, min(low) AS low, max(high) AS high, CAST(sum(t) AS BIGINT) AS total, "
        "CAST(arg_min(b, (-c, b)) AS INTEGER) AS fullest, max(c) AS in_fullest FROM (SELECT dataset, "
        "CAST(least(floor(met_pt / 5e0), 40) AS INTEGER) AS b, count(*) AS c, min(met_pt) AS low, max(met_pt) AS high, "
        "sum(CAST(floor(met_pt * 1000 + 0.5e0) AS BIGINT)) AS t FROM ev GROUP BY 1, 2) GROUP BY 1"
    ),
)
def accumulator_state(inputs: Inputs) -> DataFrame:
    """A user state that is more than sums, merged as a tree."""
    return accumulate_state(inputs.events.select("dataset", F.col("MET.pt").alias("met")), "dataset", MetSpread())


def closest(masses: Column, target: float) -> Column:
    """User helper: smallest distance of a list of masses from a target."""
    return F.array_min(F.transform(masses, lambda m: p4.stable(F.abs(m - target))))


@query(
    "helper_function",
    q.sql(
        f"SELECT a.event_id, min(round(abs({q.mass('a', 'b')} - 91.2e0), 6)) AS distance "
        f"{PAIRS} GROUP BY 1"
    ),
)
def helper_function(inputs: Inputs) -> DataFrame:
    """A Python function from Column to Column used inside a query."""
    masses = combine.pairs(muon_vectors(), lambda a, b: p4.stable(p4.mass(a, b)))
    two = inputs.reading(**MUONS).filter(F.col("nMuon") >= 2)
    return per_event(two, distance=closest(masses, 91.2))


def numpy_transverse_mass(pt_a, phi_a, pt_b, phi_b):
    d_phi = np.mod(phi_a - phi_b + np.pi, 2.0 * np.pi) - np.pi
    return np.sqrt(2.0 * pt_a * pt_b * (1.0 - np.cos(d_phi))).round(6)


@query(
    "compiled_udf",
    q.sql(f"SELECT event_id, {POS[10:]}, {MT_SQL} AS mt FROM ev JOIN mu USING (event_id)"),
)
def compiled_udf(inputs: Inputs) -> DataFrame:
    """Plain numpy over Arrow batches of exploded muons."""
    muons = inputs.reading(Muon=("pt", "phi")).select("event_id", "MET", F.posexplode("Muon").alias("pos", "m"))
    mt = arrow_function(numpy_transverse_mass, "double")
    return muons.select("event_id", "pos", mt("MET.pt", "MET.phi", "m.pt", "m.phi").alias("mt"))


def running_fraction(lists):
    """Share of a list's sum that is reached at each element."""
    values, offsets = lists
    sums = np.concatenate([[0.0], np.cumsum(values)])
    sizes = np.diff(offsets)
    start, total = np.repeat(sums[offsets[:-1]], sizes), np.repeat(sums[offsets[1:]] - sums[offsets[:-1]], sizes)
    return ((sums[1:] - start) / np.where(total == 0, 1, total)).round(5), offsets


@query(
    "compiled_udf_lists",
    q.sql(
        f"SELECT {POS}, round(sum(pt) OVER (PARTITION BY event_id ORDER BY idx) / sum(pt) OVER (PARTITION BY event_id), 5) AS share FROM jet"
    ),
)
def compiled_udf_lists(inputs: Inputs) -> DataFrame:
    """A function of lists, on the lists as they are stored."""
    share = arrow_function(running_fraction, "array<double>")("Jet.pt")
    return inputs.events.select("event_id", F.posexplode(share).alias("pos", "share"))
