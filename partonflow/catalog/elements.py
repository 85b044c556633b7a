"""Collections and their elements: schema, projection, cuts and per-event reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partonflow.catalog import sql as q
from partonflow.catalog.registry import Inputs, query
from partonflow.functions import lists, p4
from partonflow.operators import records
from partonflow.plans import single_top as st
from partonflow.plans.benchmarks import LEPTON_TYPE
from partonflow.sources.branches import mismatched


def per_event(events: DataFrame, **columns: Column) -> DataFrame:
    return events.select("event_id", *[c.alias(n) for n, c in columns.items()])


def rows_of(events: DataFrame, items: Column, *fields: str) -> DataFrame:
    """One row per list element: event_id, pos and the wanted fields."""
    exploded = events.select("event_id", F.posexplode(items).alias("pos", "x"))
    return exploded.select("event_id", "pos", *[F.col(f"x.{f}").alias(f) for f in fields])


POS = "event_id, CAST(idx AS INTEGER) AS pos"

# --- schema and projection --------------------------------------------------------


@query(
    "zip_collections",
    q.sql(f"SELECT {POS}, pt, eta, phi, round(e, 6) AS energy, CAST(charge AS INTEGER) AS ch FROM mu"),
)
def zip_collections(inputs: Inputs) -> DataFrame:
    fields = ("pt", "eta", "phi", "energy", "ch")
    rows = rows_of(inputs.zipped(muon=fields), F.col("muon"), *fields)
    return rows.withColumn("energy", F.round("energy", 6))


@query("rename_energy", q.sql(f"SELECT {POS}, round(e, 6) AS energy FROM el"))
def rename_energy(inputs: Inputs) -> DataFrame:
    """The branch ``electron_e`` under its collection name ``energy``."""
    return rows_of(inputs.zipped(electron=("energy",)), F.col("electron"), "energy").withColumn(
        "energy", F.round("energy", 6)
    )


@query("singleton_record", q.sql("SELECT event_id, met_pt AS pt, met_phi AS phi FROM ev"))
def singleton_record(inputs: Inputs) -> DataFrame:
    return inputs.zipped(met=("pt", "phi")).select("event_id", "met.pt", "met.phi")


@query(
    "counts_check",
    q.sql(
        "SELECT dataset, count(*) AS events, CAST(sum(coalesce(n, 0)) AS BIGINT) AS stored, "
        "CAST(0 AS BIGINT) AS mismatches FROM ev LEFT JOIN "
        "(SELECT event_id, count(*) AS n FROM mu GROUP BY 1) USING (event_id) GROUP BY 1"
    ),
)
def counts_check(inputs: Inputs) -> DataFrame:
    """Stored counts against list sizes; the check of all branches must find nothing."""
    flat = inputs.branches
    wrong = F.when(mismatched(flat.columns), 1)
    return flat.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("events"), F.sum("numbermuon").alias("stored"), F.count(wrong).alias("mismatches")
    )


@query("field_access", q.sql(f"SELECT {POS}, eta FROM jet"))
def field_access(inputs: Inputs) -> DataFrame:
    return inputs.events.select("event_id", F.posexplode("Jet.eta").alias("pos", "eta"))


@query(
    "with_field",
    q.sql(f"SELECT {POS}, pt, CAST(coll - 1 AS INTEGER) AS flavor FROM obj WHERE coll > 0"),
)
def with_field(inputs: Inputs) -> DataFrame:
    """Muons with flavor 0 and electrons with flavor 1, from one scan."""

    def tagged(name: str, flavor: int) -> Column:
        return records.with_field(F.col(name), "flavor", F.lit(flavor))

    events = inputs.reading(Muon=("pt",), Electron=("pt",))
    rows = events.select("event_id", F.explode(F.array(tagged("Muon", 0), tagged("Electron", 1))).alias("items"))
    return rows_of(rows, F.col("items"), "pt", "flavor")


@query(
    "with_name",
    q.sql(f"SELECT {POS}, pt, eta, phi, mass, charge, 1 AS flavor FROM el"),
)
def with_name(inputs: Inputs) -> DataFrame:
    """Electrons retyped to the common lepton struct."""
    items = records.as_type(F.col("Electron"), LEPTON_TYPE, flavor=F.lit(1))
    events = inputs.reading(Electron=("pt", "eta", "phi", "mass", "charge"))
    return rows_of(events, items, *LEPTON_TYPE)


def leptons(*fields: str) -> Column:
    """Muons, then electrons, as one list."""
    types = {f: LEPTON_TYPE[f] for f in fields} | {"flavor": "int"}

    def retyped(name: str, flavor: int) -> Column:
        return records.as_type(F.col(name), types, flavor=F.lit(flavor))

    return records.concat(retyped("Muon", 0), retyped("Electron", 1))


LEP = {
    "lep": "SELECT *, coll - 1 AS flavor, row_number() OVER "
    "(PARTITION BY event_id ORDER BY coll, idx) - 1 AS pos FROM obj WHERE coll > 0"
}


@query(
    "concat_collections",
    q.sql(
        "SELECT event_id, CAST(pos AS INTEGER) AS pos, pt, charge, "
        "CAST(flavor AS INTEGER) AS flavor FROM lep",
        **LEP,
    ),
)
def concat_collections(inputs: Inputs) -> DataFrame:
    events = inputs.reading(Muon=("pt", "charge"), Electron=("pt", "charge"))
    return rows_of(events, leptons("pt", "charge"), "pt", "charge", "flavor")


@query(
    "slice_position",
    q.sql("SELECT ev.event_id, pt FROM ev LEFT JOIN jet ON jet.event_id = ev.event_id AND idx = 1"),
)
def slice_position(inputs: Inputs) -> DataFrame:
    """Second element of each list, NULL if there is none."""
    return per_event(inputs.events, pt=lists.at(F.col("Jet.pt"), 1))


@query(
    "slice_event_elem",
    q.sql("SELECT ev.event_id, pt, eta FROM ev LEFT JOIN mu ON mu.event_id = ev.event_id AND idx = 0 "
          "WHERE ev.event_id = 1"),
)
def slice_event_elem(inputs: Inputs) -> DataFrame:
    """First muon of one event; addressing one event is the feature."""
    one = inputs.events.filter(F.col("event_id") == 1)
    return per_event(one, pt=lists.at(F.col("Muon.pt"), 0), eta=lists.at(F.col("Muon.eta"), 0))


@query("flatten", q.sql("SELECT dataset, pt FROM jet JOIN ev USING (event_id)"))
def flatten(inputs: Inputs) -> DataFrame:
    return inputs.events.select("dataset", F.explode("Jet.pt").alias("pt"))


@query("local_index", q.sql("SELECT event_id, CAST(idx AS INTEGER) AS i FROM el"))
def local_index(inputs: Inputs) -> DataFrame:
    return inputs.events.select("event_id", F.explode(lists.positions(F.col("Electron.pt"))).alias("i"))


@query(
    "fill_none",
    q.per_event("coalesce(max(pt), 0e0)", "jet ON jet.event_id = ev.event_id"),
)
def fill_none(inputs: Inputs) -> DataFrame:
    return per_event(inputs.events, value=lists.fill(lists.largest(F.col("Jet.pt")), 0.0))


@query(
    "cross_reference",
    q.sql(
        "SELECT m.event_id, CAST(m.idx AS INTEGER) AS pos, j.pt AS jet_pt FROM mu m LEFT JOIN jet j "
        "ON j.event_id = m.event_id AND j.idx = m.jet_idx"
    ),
)
def cross_reference(inputs: Inputs) -> DataFrame:
    """The jet that each muon's index field points at."""
    events = inputs.reading(Muon=("jetIdx",), Jet=("pt",))
    linked = records.follow(F.col("Muon"), F.col("Jet"), "jetIdx", "jet")
    rows = rows_of(events, linked, "jet")
    return rows.select("event_id", "pos", F.col("jet.pt").alias("jet_pt"))


@query(
    "where",
    q.sql(f"SELECT {POS}, CASE WHEN charge > 0 THEN pt ELSE -pt END AS signed_pt FROM mu"),
)
def where(inputs: Inputs) -> DataFrame:
    signed = F.transform(
        "Muon",
        lambda x: F.struct(F.when(x["charge"] > 0, x["pt"]).otherwise(-x["pt"]).alias("signed_pt")),
    )
    return rows_of(inputs.reading(Muon=("pt", "charge")), signed, "signed_pt")


# --- cuts -------------------------------------------------------------------------


@query("mask_elements", q.sql("SELECT event_id, pt FROM jet WHERE pt > 40"))
def mask_elements(inputs: Inputs) -> DataFrame:
    kept = lists.keep(F.col("Jet.pt"), lambda pt: pt > 40)
    return inputs.events.select("event_id", F.explode(kept).alias("pt"))


@query("mask_events", q.sql("SELECT DISTINCT event_id FROM el"))
def mask_events(inputs: Inputs) -> DataFrame:
    return inputs.events.filter(F.col("nElectron") >= 1).select("event_id")


@query(
    "mask_events_from_elements",
    q.sql("SELECT event_id FROM jet WHERE pt > 40 GROUP BY 1 HAVING count(*) >= 2"),
)
def mask_events_from_elements(inputs: Inputs) -> DataFrame:
    enough = lists.count_true(F.col("Jet.pt"), lambda pt: pt > 40) >= 2
    return inputs.events.filter(F.col("nJet") >= 2).filter(enough).select("event_id")


@query(
    "mask_exact_count", q.sql("SELECT event_id FROM mu GROUP BY 1 HAVING count(*) = 2")
)
def mask_exact_count(inputs: Inputs) -> DataFrame:
    return inputs.events.filter(F.col("nMuon") == 2).select("event_id")


@query(
    "mask_charge_sum",
    q.sql(
        "SELECT ev.event_id FROM ev LEFT JOIN mu ON mu.event_id = ev.event_id "
        "GROUP BY 1 HAVING coalesce(sum(charge), 0) = 0"
    ),
)
def mask_charge_sum(inputs: Inputs) -> DataFrame:
    """No muons at all sum to 0 and pass."""
    return inputs.events.filter(lists.total_int(F.col("Muon.charge")) == 0).select("event_id")


@query(
    "mask_and_or_not",
    q.sql(
        "SELECT ev.event_id FROM ev LEFT JOIN obj ON obj.event_id = ev.event_id GROUP BY 1 HAVING "
        "(count(*) FILTER (coll = 1) >= 1 OR count(*) FILTER (coll = 2) >= 2) "
        "AND NOT count(*) FILTER (coll = 0) >= 3"
    ),
)
def mask_and_or_not(inputs: Inputs) -> DataFrame:
    some = (F.col("nMuon") >= 1) | (F.col("nElectron") >= 2)
    return inputs.events.filter(some & ~(F.col("nJet") >= 3)).select("event_id")


@query(
    "mask_two_range",
    q.sql(
        f"SELECT {POS} FROM el WHERE (mva_iso > 0.6e0 AND abs(eta) < 1.479e0) OR "
        "(mva_iso > 0.7e0 AND abs(eta) > 1.479e0 AND abs(eta) < 2.5e0)"
    ),
)
def mask_two_range(inputs: Inputs) -> DataFrame:
    """Threshold by eta region; positions are those of the unfiltered list."""
    events = inputs.reading(Electron=("eta", "mvaFall17V2noIso"))

    def passes(e: Column) -> Column:
        mva = e["x"]["mvaFall17V2noIso"]
        return st.by_region(e["x"]["eta"], mva > 0.6, mva > 0.7)

    kept = lists.keep(lists.indexed(F.col("Electron")), passes)
    return events.select("event_id", F.explode(kept).alias("k")).select(
        "event_id", F.col("k.i").alias("pos")
    )


@query(
    "mask_tiered",
    q.sql(
        "SELECT ev.event_id, count(*) FILTER (l) AS loose, count(*) FILTER (l AND t) AS tight "
        "FROM ev LEFT JOIN (SELECT event_id, abs(eta) < 2.4e0 AND pt > 5 AND loose_id AS l, "
        "pt > 15 AND medium_id AS t FROM mu) m ON m.event_id = ev.event_id GROUP BY 1"
    ),
)
def mask_tiered(inputs: Inputs) -> DataFrame:
    """Tight is loose plus more cuts."""
    events = inputs.reading(Muon=("pt", "eta", "looseId", "mediumId"))
    loose = lists.keep(F.col("Muon"), lambda x: (F.abs(x["eta"]) < 2.4) & (x["pt"] > 5) & x["looseId"])
    tiers = records.settle(events, ("event_id",), {"loose": loose})
    tight = lists.count_true(F.col("loose"), lambda x: (x["pt"] > 15) & x["mediumId"])
    return per_event(tiers, loose=lists.num(F.col("loose")), tight=tight)


@query(
    "mask_other_column",
    q.sql(
        "SELECT event_id, met_pt FROM ev WHERE event_id IN "
        "(SELECT event_id FROM mu WHERE abs(eta) < 1)"
    ),
)
def mask_other_column(inputs: Inputs) -> DataFrame:
    """MET of events chosen by their muons."""
    central = lists.some(F.col("Muon.eta"), lambda eta: F.abs(eta) < 1)
    return inputs.events.filter(central).select("event_id", F.col("MET.pt").alias("met_pt"))


@query("mask_range", q.sql("SELECT event_id, pt FROM jet WHERE pt >= 20 AND pt < 60"))
def mask_range(inputs: Inputs) -> DataFrame:
    kept = lists.keep(F.col("Jet.pt"), lambda pt: (pt >= 20) & (pt < 60))
    return inputs.events.select("event_id", F.explode(kept).alias("pt"))


# --- reductions over the list of one event ----------------------------------------

ON_JET = "jet ON jet.event_id = ev.event_id"


@query("list_num", q.per_event("count(jet.event_id)", ON_JET))
def list_num(inputs: Inputs) -> DataFrame:
    return per_event(inputs.events, value=lists.num(F.col("Jet.pt")))


@query(
    "list_count",
    q.per_event(
        "count(jet.pt)",
        "mu ON mu.event_id = ev.event_id LEFT JOIN jet ON jet.event_id = mu.event_id "
        "AND jet.idx = mu.jet_idx",
    ),
)
def list_count(inputs: Inputs) -> DataFrame:
    """Muons with an existing jet; absent ones are NULL and not counted."""
    jets = F.col("Jet.pt")
    linked = F.transform("Muon.jetIdx", lambda i: F.get(jets, i))
    return per_event(inputs.events, value=lists.count(linked))


@query("list_sum", q.per_event("round(coalesce(sum(pt), 0), 6)", ON_JET))
def list_sum(inputs: Inputs) -> DataFrame:
    return per_event(inputs.events, value=p4.stable(lists.total(F.col("Jet.pt"))))


@query("list_count_true", q.per_event("count(*) FILTER (abs(eta) < 1)", ON_JET))
def list_count_true(inputs: Inputs) -> DataFrame:
    return per_event(
        inputs.events, value=lists.count_true(F.col("Jet.eta"), lambda eta: F.abs(eta) < 1)
    )


@query("list_any", q.per_event("CAST(coalesce(bool_or(pt > 60), false) AS INTEGER)", ON_JET))
def list_any(inputs: Inputs) -> DataFrame:
    return per_event(
        inputs.events, value=lists.some(F.col("Jet.pt"), lambda pt: pt > 60).cast("int")
    )


@query("list_all", q.per_event("CAST(coalesce(bool_and(pt > 30), true) AS INTEGER)", ON_JET))
def list_all(inputs: Inputs) -> DataFrame:
    """True for an empty list."""
    return per_event(
        inputs.events, value=lists.every(F.col("Jet.pt"), lambda pt: pt > 30).cast("int")
    )


@query("list_min", q.per_event("min(eta)", ON_JET))
def list_min(inputs: Inputs) -> DataFrame:
    return per_event(inputs.events, value=lists.smallest(F.col("Jet.eta")))


@query("list_max", q.per_event("max(eta)", ON_JET))
def list_max(inputs: Inputs) -> DataFrame:
    return per_event(inputs.events, value=lists.largest(F.col("Jet.eta")))


def ranked(table: str, order: str) -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {order}, idx) AS r FROM {table}"
    )


@query(
    "list_argmin",
    q.sql(
        "SELECT ev.event_id, CAST(idx AS INTEGER) AS value FROM ev LEFT JOIN ranked k "
        "ON k.event_id = ev.event_id AND r = 1",
        ranked=ranked("jet", "abs(eta)"),
    ),
)
def list_argmin(inputs: Inputs) -> DataFrame:
    return per_event(inputs.events, value=lists.argmin(F.col("Jet.eta"), F.abs))


@query(
    "list_argmax",
    q.sql(
        "SELECT ev.event_id, CAST(idx AS INTEGER) AS value, pt FROM ev LEFT JOIN ranked k "
        "ON k.event_id = ev.event_id AND r = 1",
        ranked=ranked("jet", "btag DESC"),
    ),
)
def list_argmax(inputs: Inputs) -> DataFrame:
    """Position of the largest b-tag and the pt found there; many jets tie."""
    best = lists.argmax(F.col("Jet.btag"), lambda b: b)
    return per_event(inputs.events, value=best, pt=lists.at(F.col("Jet.pt"), best))


@query(
    "list_second_max",
    q.sql(
        "SELECT ev.event_id, eta AS value FROM ev LEFT JOIN ranked k "
        "ON k.event_id = ev.event_id AND r = 2",
        ranked=ranked("jet", "btag DESC"),
    ),
)
def list_second_max(inputs: Inputs) -> DataFrame:
    second = lists.at_second_max(F.col("Jet"), lambda j: j["btag"], lambda j: j["eta"])
    return per_event(inputs.reading(Jet=("btag", "eta")), value=second)


# --- totals over all events -------------------------------------------------------


@query("agg_num_events", q.sql("SELECT dataset, count(*) AS n FROM ev GROUP BY 1"))
def agg_num_events(inputs: Inputs) -> DataFrame:
    return inputs.events.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_total_elements",
    q.sql("SELECT dataset, count(jet.event_id) AS n FROM ev LEFT JOIN jet USING (event_id) GROUP BY 1"),
)
def agg_total_elements(inputs: Inputs) -> DataFrame:
    return inputs.events.groupBy("dataset").agg(F.sum(lists.num(F.col("Jet.pt"))).alias("n"))


@query(
    "agg_total_true",
    q.sql(
        "SELECT dataset, count(*) FILTER (abs(eta) < 1) AS n FROM ev LEFT JOIN jet USING (event_id) "
        "GROUP BY 1"
    ),
)
def agg_total_true(inputs: Inputs) -> DataFrame:
    central = lists.count_true(F.col("Jet.eta"), lambda eta: F.abs(eta) < 1)
    return inputs.events.groupBy("dataset").agg(F.sum(central).alias("n"))
