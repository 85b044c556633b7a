"""The eight benchmark queries on events with jets, muons, electrons and MET.

Shape of every query: declare the collection fields in use, test the stored counts
first (where only filled bins are wanted that comparison reaches the Parquet
reader), and only then run list expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partonflow.functions import lists, p4
from partonflow.operators import combine
from partonflow.operators.hist import Axis
from partonflow.operators.records import as_type, concat, settle
from partonflow.plans.analysis import Analysis

# Reference masses in GeV.
TOP_MASS = 172.5
Z_MASS = 91.2


class MissingEnergy(Analysis):
    """MET of all events."""

    axes = (Axis("MET", 50, 0, 100),)

    def __init__(self, chunk_size: int | None = None):
        self.chunk_size = chunk_size

    def values(self) -> dict[str, Column]:
        return {"MET": F.col("MET.pt")}

    def counters(self) -> dict[str, Column]:
        return {"all events": F.lit(1)}


class JetPt(Analysis):
    """pt of all jets."""

    axes = (Axis("Jet_pt", 100, 15, 60),)

    def values(self) -> dict[str, Column]:
        return {"Jet_pt": F.col("Jet.pt")}

    def counters(self) -> dict[str, Column]:
        return {"all events": F.lit(1), "all jets": lists.count(F.col("Jet.pt"))}


class CentralJetPt(Analysis):
    """pt of jets with abs(eta) < 1."""

    axes = (Axis("Jet_pt", 100, 15, 60),)
    reads = {"Jet": ("pt", "eta")}

    def prepare(self, events: DataFrame) -> DataFrame:
        jets = events.select("dataset", "Jet")
        return jets.withColumn("good", lists.keep(F.col("Jet"), lambda j: F.abs(j["eta"]) < 1))

    def values(self) -> dict[str, Column]:
        return {"Jet_pt": F.col("good.pt")}

    def counters(self) -> dict[str, Column]:
        central = lists.count_true(F.col("Jet"), lambda j: F.abs(j["eta"]) < 1)
        return {
            "all events": F.lit(1),
            "number of jets": lists.num(F.col("Jet")),
            "abs(eta) < 1": central,
            "final good jets": lists.num(F.col("good")),
        }


class MissingEnergyTwoJets(Analysis):
    """MET of events with at least two jets above 40."""

    axes = (Axis("MET_pt", 50, 0, 125),)

    def candidates(self) -> Column:
        return F.col("nJet") >= 2

    def _passes(self) -> Column:
        return lists.count_true(F.col("Jet.pt"), lambda pt: pt > 40) >= 2

    def values(self) -> dict[str, Column]:
        return {"MET_pt": F.when(self.candidates() & self._passes(), F.col("MET.pt"))}

    def counters(self) -> dict[str, Column]:
        return {"all events": F.lit(1), "final events": self._passes().cast("int")}


class MissingEnergyDimuon(Analysis):
    """MET of events with an opposite-charge muon pair of mass in [60, 120)."""

    axes = (Axis("MET", 50, 1, 100),)
    reads = {"Muon": ("pt", "eta", "phi", "mass", "charge")}

    def candidates(self) -> Column:
        return F.col("nMuon") >= 2

    def prepare(self, events: DataFrame) -> DataFrame:
        muons = p4.with_cartesian(F.col("Muon"), "charge")
        masses = combine.pairs(
            muons, lambda a, b: F.when(a["charge"] != b["charge"], p4.stable(p4.mass(a, b)))
        )
        found = lists.some(masses, lambda m: (m >= 60) & (m < 120))
        passes = F.when(self.candidates(), found).otherwise(False)
        return settle(events, ("dataset", "nMuon", "MET"), {"passes": passes})

    def values(self) -> dict[str, Column]:
        return {"MET": F.when(F.col("passes"), F.col("MET.pt"))}

    def counters(self) -> dict[str, Column]:
        return {
            "all events": F.lit(1),
            "all muons": F.col("nMuon"),
            "final events": F.col("passes").cast("int"),
        }


class Trijet(Analysis):
    """pt and largest b-tag of the jet triple with mass closest to the top mass."""

    axes = (Axis("Jet_pt", 50, 15, 200), Axis("b_tag", 50, 0, 1))

    def __init__(self, tag: str = "btag", target: float = TOP_MASS):
        self.tag, self.target = tag, target
        self.reads = {"Jet": ("pt", "eta", "phi", "mass", tag)}

    def candidates(self) -> Column:
        return F.col("nJet") >= 3

    def prepare(self, events: DataFrame) -> DataFrame:
        jets = lists.keep(F.col("Jet"), lambda j: j["pt"] > 30)

        def distance(a: Column, b: Column, c: Column) -> Column:
            return p4.stable(F.abs(F.lit(self.target) - p4.stable(p4.mass(a, b, c))))

        def chosen(a: Column, b: Column, c: Column) -> Column:
            tag = p4.elementwise_max(a[self.tag], b[self.tag], c[self.tag])
            return F.struct(p4.stable(p4.pt(a, b, c)).alias("pt"), tag.alias("tag"))

        best = combine.closest_triples(p4.with_cartesian(jets, self.tag), distance, chosen)
        return settle(events, ("dataset",), {"best": F.when(self.candidates(), best)})

    def values(self) -> dict[str, Column]:
        return {"Jet_pt": F.col("best.pt"), "b_tag": F.col("best.tag")}


class IsolatedJetHt(Analysis):
    """Sum of pt of jets above 30 that are further than 0.4 from every lepton above 10."""

    axes = (Axis("Jet_pt", 100, 15, 200),)
    reads = {c: ("pt", "eta", "phi") for c in ("Jet", "Muon", "Electron")}

    def __init__(self, radius: float = 0.4, require_lepton: bool = False):
        self.radius, self.require_lepton = radius, require_lepton

    def prepare(self, events: DataFrame) -> DataFrame:
        def above(collection: str, cut: float) -> Column:
            return lists.keep(F.col(collection), lambda x: x["pt"] > cut)

        picked = events.select(
            "dataset",
            "nJet",
            above("Jet", 30).alias("jets"),
            above("Muon", 10).alias("muons"),
            above("Electron", 10).alias("electrons"),
        )
        def far(leptons: str) -> Column:
            return combine.apart(
                F.col("jets"), F.col(leptons), self.radius, self.require_lepton
            )

        flags = F.arrays_zip(
            F.col("jets.pt").alias("pt"), far("muons").alias("m"), far("electrons").alias("e")
        )
        return picked.select(
            "dataset",
            "nJet",
            flags.alias("jets"),
            F.size("muons").alias("n_muons"),
            F.size("electrons").alias("n_electrons"),
        )

    def values(self) -> dict[str, Column]:
        kept = lists.keep(F.col("jets"), lambda j: j["m"] & j["e"])
        return {"Jet_pt": p4.stable(lists.total(F.transform(kept, lambda j: j["pt"])))}

    def counters(self) -> dict[str, Column]:
        jets = F.col("jets")
        both = lists.count_true(jets, lambda j: j["m"] & j["e"])
        return {
            "all events": F.lit(1),
            "all jets": F.col("nJet"),
            "jets with pt > 30": lists.num(jets),
            "muons with pt > 10": F.col("n_muons"),
            "electrons with pt > 10": F.col("n_electrons"),
            "jet-muon pairs": lists.count_true(jets, lambda j: j["m"]),
            "jet-electron pairs": lists.count_true(jets, lambda j: j["e"]),
            "jet-lepton pairs": both,
            "final jets": both,
        }


LEPTON_TYPE = {
    "pt": "double",
    "eta": "double",
    "phi": "double",
    "mass": "double",
    "charge": "int",
    "flavor": "int",
}


class ThirdLeptonMt(Analysis):
    """Transverse mass of MET and the hardest lepton outside the best Z candidate."""

    axes = (Axis("massT", 50, 15, 250),)
    reads = {c: ("pt", "eta", "phi", "mass", "charge") for c in ("Muon", "Electron")}

    def prepare(self, events: DataFrame) -> DataFrame:
        def selected(collection: str, flavor: int, eta: float) -> Column:
            good = lists.keep(F.col(collection), lambda x: (x["pt"] > 10) & (F.abs(x["eta"]) < eta))
            return as_type(good, LEPTON_TYPE, flavor=F.lit(flavor))

        leptons = events.select(
            "dataset",
            "MET",
            selected("Muon", 0, 2.4).alias("muons"),
            selected("Electron", 1, 2.5).alias("electrons"),
        ).withColumn("leptons", concat(F.col("muons"), F.col("electrons")))
        rest = leptons.withColumn(
            "rest", F.when(F.size("leptons") >= 3, self._outside_pair(F.col("leptons")))
        )
        return rest.withColumn("lep", lists.at_max(F.col("rest"), lambda x: x["pt"]))

    def _outside_pair(self, leptons: Column) -> Column:
        """Leptons outside the same-flavour opposite-charge pair closest to the Z mass."""
        vectors = p4.with_cartesian(leptons, "charge", "flavor")

        def scored(i: Column, j: Column, a: Column, b: Column) -> Column:
            signal = (a["flavor"] == b["flavor"]) & (a["charge"] != b["charge"])
            off = p4.stable(F.abs(p4.stable(p4.mass(a, b)) - Z_MASS))
            return F.when(signal, F.struct(off.alias("d"), i.alias("i0"), j.alias("i1")))

        def rest(best: Column) -> Column:
            return F.when(best.isNotNull(), lists.without(leptons, best["i0"], best["i1"]))

        return lists.let(F.array_min(combine.arg_pairs(vectors, scored)), rest)

    def candidates(self) -> Column:
        return F.col("nMuon") + F.col("nElectron") >= 3

    def values(self) -> dict[str, Column]:
        d_phi = p4.delta_phi(F.col("MET.phi"), F.col("lep.phi"))
        return {"massT": p4.stable(p4.transverse_mass(F.col("MET.pt"), F.col("lep.pt"), d_phi))}

    def counters(self) -> dict[str, Column]:
        n = F.size("leptons")
        return {
            "all events": F.lit(1),
            "all muons": F.size("muons"),
            "all electrons": F.size("electrons"),
            "trileptons": F.when(n >= 3, n).otherwise(0),
            "number of final leading leptons": F.coalesce(F.size("rest"), F.lit(0)),
        }


BENCHMARKS: dict[str, Analysis] = {
    "adl1_met": MissingEnergy(chunk_size=1000),
    "adl2_jet_pt": JetPt(),
    "adl3_jet_pt_eta": CentralJetPt(),
    "adl4_met_2jets": MissingEnergyTwoJets(),
    "adl5_met_dimuon": MissingEnergyDimuon(),
    "adl6_trijet": Trijet(),
    "adl7_jet_iso_ht": IsolatedJetHt(),
    "adl8_mt_third_lepton": ThirdLeptonMt(),
}
