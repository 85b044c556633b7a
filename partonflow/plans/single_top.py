"""Associated single top and Higgs production: multi-lepton event selection.

Loose leptons carry a ``tight`` flag instead of being kept in a second list, so
a tight list is always a filter of the loose one.  Events that cannot pass are
dropped on their stored counts before any list work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partonflow.functions import lists, p4
from partonflow.operators import combine
from partonflow.operators.hist import Axis, regroup, scaled
from partonflow.operators.records import concat, settle, with_counts
from partonflow.plans.analysis import Analysis

# Working points, masses and the weights of the simulated samples.
LOOSE_BTAG = 0.5425
MEDIUM_BTAG = 0.8484
Z_MASS = 91.18
BARREL_END = 1.479
ENDCAP_END = 2.5
LUMINOSITY = 35900.0
CROSS_SECTIONS = {
    "tHq": 0.7927,
    "tHW": 0.1472,
    "ttW": 0.6105,
    "ttWJets": 0.2043,
    "ttZ": 0.2529,
    "ttZJets": 0.5297,
    "ttH": 0.2151,
    "WZ": 4.4296,
    "ZZ": 1.256,
    "ZZZ": 0.01398,
    "WWZ": 0.1651,
    "WZZ": 0.05565,
    "tttt": 0.009103,
    "WpWp": 0.03711,
}
GROUPS = {
    "tHq": "tHq",
    "tHW": "tHW",
    "ttW": "ttW",
    "ttWJets": "ttW",
    "ttZ": "ttZ",
    "ttZJets": "ttZ",
    "ttH": "ttH",
    "WZ": "WZ",
    "ZZ": "ZZ",
    "ZZZ": "VVV",
    "WWZ": "VVV",
    "WZZ": "VVV",
    "tttt": "tttt",
    "WpWp": "WpWp",
}
MUON_FIELDS = (
    "pt", "eta", "phi", "mass", "charge", "dxy", "dz", "sip3d", "miniPFRelIso_all",
    "looseId", "mediumId", "tightCharge", "mvaTTH",
)
ELECTRON_FIELDS = (
    "pt", "eta", "phi", "mass", "charge", "dxy", "dz", "lostHits", "miniPFRelIso_all",
    "mvaFall17V2noIso", "tightCharge", "convVeto", "mvaTTH", "sieie", "hoe", "eInvMinusPInv",
)


READS = {
    "Jet": ("pt", "eta", "btagCSVV2"),
    "Muon": MUON_FIELDS,
    "Electron": ELECTRON_FIELDS,
}


def by_region(eta: Column, barrel: Column, endcap: Column) -> Column:
    """A cut that differs between barrel and endcap; the boundary itself passes neither."""
    a = F.abs(eta)
    return ((a < BARREL_END) & barrel) | ((a > BARREL_END) & (a < ENDCAP_END) & endcap)


def _near_vertex(x: Column) -> Column:
    close = (F.abs(x["dxy"]) < 0.05) & (F.abs(x["dz"]) < 0.1)
    return close & (x["miniPFRelIso_all"] < 0.4)


def loose_muon(x: Column) -> Column:
    good = (x["pt"] > 5) & (F.abs(x["eta"]) < 2.4) & (x["sip3d"] < 8) & x["looseId"]
    return good & _near_vertex(x)


def tight_muon(x: Column, min_tight_charge: int) -> Column:
    """Cuts on top of the loose ones."""
    good = (x["pt"] > 15) & x["mediumId"] & (x["mvaTTH"] > 0.9)
    return good & (x["tightCharge"] > min_tight_charge)


def loose_electron(x: Column) -> Column:
    good = (x["pt"] > 7) & (F.abs(x["eta"]) < ENDCAP_END) & (x["lostHits"] < 2)
    mva = x["mvaFall17V2noIso"]
    return good & _near_vertex(x) & by_region(x["eta"], mva > 0, mva > 0.7)


def tight_electron(x: Column, min_tight_charge: int) -> Column:
    """Cuts on top of the loose ones."""
    good = (x["pt"] > 15) & (x["lostHits"] == 0) & x["convVeto"] & (x["mvaTTH"] > 0.9)
    slope = x["eInvMinusPInv"]
    shape = by_region(
        x["eta"],
        (x["sieie"] < 0.011) & (x["hoe"] < 0.1) & (slope < 0.01) & (slope > -0.05),
        (x["sieie"] < 0.03) & (x["hoe"] < 0.07) & (slope < 0.005) & (slope > -0.05),
    )
    return good & shape & (x["tightCharge"] > min_tight_charge)


def _lepton(x: Column, flavor: int, tight: Column) -> Column:
    fields = [x[f].alias(f) for f in ("pt", "eta", "phi", "charge")]
    parts = (p4.px(x), p4.py(x), p4.pz(x), p4.energy(x))
    vector = [c.alias(n) for n, c in zip(p4.COMPONENTS, parts)]
    return F.struct(*fields, *vector, F.lit(flavor).alias("flavor"), tight.alias("tight"))


def medium_b(j: Column) -> Column:
    return (F.abs(j["eta"]) < 2.4) & (j["btagCSVV2"] > MEDIUM_BTAG)


def light(j: Column) -> Column:
    central_or_hard = (F.abs(j["eta"]) < 2.4) | ((j["pt"] > 40) & (F.abs(j["eta"]) > 2.4))
    return central_or_hard & (j["btagCSVV2"] <= LOOSE_BTAG)


#: What :func:`objects` can build, with the collection each part is read from.
PARTS = {"muons": "Muon", "electrons": "Electron", "all_jets": "Jet"}


def objects(
    events: DataFrame, min_tight_charge: int = 0, parts: Sequence[str] = tuple(PARTS), when: Column | None = None
) -> DataFrame:
    """Selected leptons and jets of every event, of none where ``when`` does not hold.

    Only the collections of the named parts are read.  The events need a ``dataset``;
    an ``event_id`` is carried along if there is one.
    """

    def leptons(collection, flavor, loose, tight) -> Column:
        kept = lists.keep(F.col(collection), loose)
        return F.transform(kept, lambda x: _lepton(x, flavor, tight(x, min_tight_charge)))

    made = {
        "muons": lambda: leptons("Muon", 0, loose_muon, tight_muon),
        "electrons": lambda: leptons("Electron", 1, loose_electron, tight_electron),
        "all_jets": lambda: F.col("Jet"),
    }
    kept = tuple(c for c in ("event_id", "dataset") if c in events.columns)
    picked = settle(events, kept, {part: made[part]() for part in parts}, when)
    more = {}
    if "muons" in parts and "electrons" in parts:
        more["leptons"] = concat(F.col("muons"), F.col("electrons"))
    if "all_jets" in parts:
        more["jets"] = lists.keep(F.col("all_jets"), lambda j: j["pt"] > 25)
    return picked.withColumns(more)


def pair_masses_all_at_least(leptons: Column, low: float) -> Column:
    """There is a pair, and no pair is lighter than ``low``."""
    masses = combine.pairs(leptons, lambda a, b: p4.stable(p4.mass(a, b)))
    return (F.size(leptons) >= 2) & F.forall(masses, lambda m: m >= low)


def dilepton_passes(tight: Column) -> Column:
    """Two same-charge leptons, one above 25, an ee pair away from the Z."""

    def good(_i: Column, _j: Column, a: Column, b: Column) -> Column:
        off_z = p4.stable(F.abs(p4.stable(p4.mass(a, b)) - Z_MASS)) > 10
        hard = (a["pt"] > 25) | (b["pt"] > 25)
        return (a["charge"] == b["charge"]) & hard & ((a["flavor"] + b["flavor"] < 2) | off_z)

    return (F.size(tight) == 2) & F.exists(combine.arg_pairs(tight, good), lambda ok: ok)


def trilepton_passes(tight: Column) -> Column:
    """Three leptons, one above 25, no opposite-sign same-flavour pair near the Z."""

    def near_z(a: Column, b: Column) -> Column:
        close = p4.stable(F.abs(F.lit(Z_MASS) - p4.stable(p4.mass(a, b)))) < 15
        return (a["flavor"] == b["flavor"]) & (a["charge"] != b["charge"]) & close

    hard = F.exists(tight, lambda x: x["pt"] > 25)
    veto = F.exists(combine.pairs(tight, near_z), lambda hit: hit)
    return (F.size(tight) == 3) & hard & ~veto


def classify(picked: DataFrame) -> DataFrame:
    """Add the tight list, the selection flags and the channel (NULL if rejected)."""
    columns = {
        "tight": lists.keep(F.col("leptons"), lambda x: x["tight"]),
        "has_b": lists.count_true(F.col("jets"), medium_b) >= 1,
        "has_light": lists.count_true(F.col("jets"), light) >= 1,
    }
    carried = tuple(
        c for c in ("event_id", "dataset", "muons", "electrons", "leptons", "jets", "all_jets") if c in picked.columns
    )
    df = settle(picked, carried, columns)
    tight = F.col("tight")
    flavor = lists.total_int(F.transform(tight, lambda x: x["flavor"]))
    candidate = F.col("has_b") & F.col("has_light") & F.size(tight).isin(2, 3)
    passes = candidate & (dilepton_passes(tight) | trilepton_passes(tight))
    passes = passes & pair_masses_all_at_least(F.col("leptons"), 12)
    named = (
        F.when(F.size(tight) == 3, "lll")
        .when(flavor == 0, "mumu")
        .when(flavor == 1, "emu")
        .otherwise("ee")
    )
    channel = {"channel": F.when(passes, named)}
    return settle(df, (*carried, "tight", "has_b", "has_light"), channel)


def possible() -> Column:
    """Stored counts that every event of a channel has at least."""
    return (F.col("nJet") >= 2) & (F.col("nMuon") + F.col("nElectron") >= 2)


def select(events: DataFrame, min_tight_charge: int = 0) -> DataFrame:
    """Events in one of the four channels."""
    chosen = with_counts(events).filter(possible())
    return classify(objects(chosen, min_tight_charge)).filter(F.col("channel").isNotNull())


CHANNELS = ("lll", "mumu", "emu", "ee")


class Selection(Analysis):
    """What the analyses of this selection share: values of selected events, computed for those only."""

    by: Sequence[str] = ("channel",)
    reads = READS
    only = "selected"
    channels: Sequence[str] = CHANNELS

    def __init__(self, min_tight_charge: int = 0):
        self.min_tight_charge = min_tight_charge
        self.categories = {"channel": self.channels}

    def candidates(self) -> Column:
        return possible()

    def prepare(self, events: DataFrame) -> DataFrame:
        return self._judged(events, None)

    def prepare_values(self, events: DataFrame) -> DataFrame:
        return self._judged(events, possible())

    def _judged(self, events: DataFrame, when: Column | None) -> DataFrame:
        """Every event with its channel; the channel of an event that is not selected is NULL."""
        judged = classify(objects(events, self.min_tight_charge, when=when))
        selected = F.coalesce(F.col("channel").isin(*self.channels), F.lit(False))
        return self.measured(judged.withColumn("channel", F.when(selected, F.col("channel"))).withColumn("selected", selected))

    def measured(self, judged: DataFrame) -> DataFrame:
        return judged

    def observables(self) -> dict[str, Column]:
        raise NotImplementedError

    def values(self) -> dict[str, Column]:
        return {k: F.when(F.col("selected"), v) for k, v in self.observables().items()}


class SingleTop(Selection):
    """Ten observables in the channels lll, mumu, emu and ee."""

    by = ("dataset", "channel")
    axes = (
        Axis("3rdLepton_pT", 18, 0, 90),
        Axis("subleadLepton_pT", 18, 0, 144),
        Axis("fwdJet_leadbJet", 18, 0, 6),
        Axis("fwdJet_subleadbJet", 18, 0, 6),
        Axis("fwdJet_closestLepton", 18, 0, 6),
        Axis("highpT_sslp", 18, 0, 3.5),
        Axis("jetMaxEta", 18, 0, 5),
        Axis("minDelR", 18, 0, 4),
        Axis("nJet25", 6, 2, 8),
        Axis("nJetEta1", 7, 1, 8),
        Axis("TotalCharge", 5, -2, 3),
    )

    def measured(self, judged: DataFrame) -> DataFrame:
        selected, tight = F.col("selected"), F.col("tight")
        pairs = combine.pairs(
            tight,
            lambda a, b: F.struct(
                p4.stable(p4.pt(a, b)).alias("pt"),
                p4.stable(p4.delta_phi_raw(a["phi"], b["phi"])).alias("dphi"),
                p4.stable(p4.delta_r(a, b)).alias("dr"),
            ),
        )
        return judged.withColumns(
            {
                "lights": F.when(selected, lists.keep(F.col("jets"), lambda j: j["btagCSVV2"] <= LOOSE_BTAG)),
                "bs": F.when(selected, lists.keep(F.col("jets"), lambda j: j["btagCSVV2"] > MEDIUM_BTAG)),
                "pairs": F.when(selected, pairs),
            }
        ).withColumn("fwd", lists.largest(F.col("lights.eta")))

    def observables(self) -> dict[str, Column]:
        tight, fwd = F.col("tight"), F.col("fwd")
        three = F.col("channel") == "lll"
        hard_lights = F.filter("lights", lambda j: j["pt"] > 40)
        lead_b = lists.at_max(F.col("bs"), lambda j: j["pt"], lambda j: j["eta"])
        second_b = lists.at_second_max(F.col("bs"), lambda j: j["pt"], lambda j: j["eta"])
        lepton_gap = F.array_min(F.transform(tight, lambda x: p4.stable(fwd - x["eta"])))
        hardest = F.array_max(F.transform(hard_lights, lambda j: F.abs(j["eta"])))
        return {
            "3rdLepton_pT": F.when(three, F.array_min("tight.pt")),
            "subleadLepton_pT": F.when(~three, F.get("tight", F.lit(1))["pt"]),
            "fwdJet_leadbJet": p4.stable(F.abs(fwd - lead_b)),
            "fwdJet_subleadbJet": p4.stable(F.abs(fwd - second_b)),
            "fwdJet_closestLepton": lepton_gap,
            "highpT_sslp": lists.at_max(F.col("pairs"), lambda p: p["pt"], lambda p: p["dphi"]),
            "jetMaxEta": F.coalesce(hardest, F.lit(0.0)),
            "minDelR": F.array_min("pairs.dr"),
            "nJet25": lists.count_true(F.col("jets"), lambda j: F.abs(j["eta"]) < 2.4),
            "nJetEta1": lists.count_true(F.col("lights"), lambda j: F.abs(j["eta"]) > 1),
            "TotalCharge": lists.total_int(F.col("tight.charge")),
        }

    def counters(self) -> dict[str, Column]:
        """All but the first count objects, not events."""
        channel, n_tight, n_jets = F.col("channel"), F.size("tight"), F.size("jets")
        two = channel.isin("mumu", "ee", "emu")

        def counted(condition: Column, amount: Column) -> Column:
            return F.when(condition, amount).otherwise(0)

        def tight_in(collection: str) -> Column:
            return lists.count_true(F.col(collection), lambda x: x["tight"])

        return {
            "all events": F.lit(1),
            "loose muons": F.size("muons"),
            "tight muons": tight_in("muons"),
            "loose electrons": F.size("electrons"),
            "tight electrons": tight_in("electrons"),
            "jets > 25": n_jets,
            "tight_ll": counted(two, n_tight),
            "tights_2mu": counted(channel == "mumu", n_tight),
            "tights_2e": counted(channel == "ee", n_tight),
            "tights_emu": counted(channel == "emu", n_tight),
            "jets through dilepton mask": counted(two, n_jets),
            "tight_lll": counted(channel == "lll", n_tight),
            "jets through trilepton mask": counted(channel == "lll", n_jets),
        }

    def scaled_of(self, told: DataFrame) -> DataFrame:
        """Histogram of a full tally weighted to the luminosity and merged into groups.

        The weights use the number of all events of a dataset, before any cut.
        """
        weighted = scaled(told, CROSS_SECTIONS, LUMINOSITY)
        return regroup(weighted, GROUPS, "dataset", "scaled", ("channel",))

    def scaled(self, events: DataFrame) -> DataFrame:
        return self.scaled_of(self.tally(events, full=True, counters=False))

    def results(self, told: DataFrame) -> dict[str, DataFrame]:
        return super().results(told) | {"scaled": self.scaled_of(told)}


class SecondLeptonPt(Selection):
    """pt of the second lepton in the mumu and ee channels, stricter charge cut."""

    axes = (Axis("pt2", 20, 0, 150),)
    channels = ("mumu", "ee")

    def __init__(self):
        super().__init__(1)

    def observables(self) -> dict[str, Column]:
        return {"pt2": F.get("tight", F.lit(1))["pt"]}


class ForwardJetGap(Selection):
    """Eta gap between the max-eta light jet and the max-pt b jet, mumu channel, all jets."""

    axes = (Axis("etadiff", 20, 0, 6),)
    channels = ("mumu",)

    def __init__(self):
        super().__init__(1)

    def observables(self) -> dict[str, Column]:
        lights = F.filter("all_jets", lambda j: j["btagCSVV2"] <= LOOSE_BTAG)
        bs = F.filter("all_jets", lambda j: j["btagCSVV2"] > MEDIUM_BTAG)
        fwd = F.array_max(F.transform(lights, lambda j: j["eta"]))
        lead = lists.at_max(bs, lambda j: j["pt"], lambda j: j["eta"])
        return {"etadiff": p4.stable(F.abs(lead - fwd))}
