"""The larger analyses: pair masses, scalar sums, and the multi-lepton selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.catalog import sql as q
from partonflow.catalog.registry import Inputs, query
from partonflow.functions import lists
from partonflow.operators.hist import cutflow
from partonflow.plans import single_top as st
from partonflow.plans.benchmarks import MissingEnergy
from partonflow.plans.dilepton import JetHt, SameFlavourMass, ZPeak

# --- one or two leptons, jets, MET ------------------------------------------------

MET = MissingEnergy()


@query(
    "met_multi_dataset",
    q.sparse_hist(
        "SELECT CASE WHEN dataset IN ('1-URGENT', '2-HIGH') THEN 'tHq' ELSE 'tHW' END AS dataset, "
        "'MET' AS variable, met_pt AS v FROM ev",
        MET.axes,
        where="bin >= 0 AND bin < bins",
    ),
)
def met_multi_dataset(inputs: Inputs) -> DataFrame:
    """MET of two datasets, each read from several directories."""
    from partonflow.catalog.scans import two_datasets

    hist = MET.histogram(two_datasets(inputs))
    return hist.filter((F.col("bin") >= 0) & (F.col("bin") < MET.axes[0].bins))


TWO = f"""SELECT a.event_id, {q.mass("a", "b")} AS m
FROM mu a JOIN mu b ON a.event_id = b.event_id AND a.idx = 0 AND b.idx = 1
WHERE a.charge + b.charge = 0
  AND a.event_id IN (SELECT event_id FROM mu GROUP BY 1 HAVING count(*) = 2)"""


@query(
    "zpeak",
    q.dense_hist(
        "SELECT dataset, 'dimu_mass' AS variable, m AS v FROM ev JOIN two USING (event_id)",
        ZPeak.axes,
        two=TWO,
    ),
)
def zpeak(inputs: Inputs) -> DataFrame:
    return ZPeak().dense_histogram(inputs.events_for(ZPeak()))


@query(
    "agc_dilepton",
    q.dense_hist(
        f"""SELECT CASE a.coll WHEN 1 THEN 'mumu' ELSE 'ee' END AS lepton,
  'dilep_mass' AS variable, {q.mass("a", "b")} AS v
FROM hard a JOIN hard b ON a.event_id = b.event_id AND a.coll = b.coll AND a.idx < b.idx
JOIN exact x ON x.event_id = a.event_id AND x.coll = a.coll
WHERE a.charge + b.charge = 0""",
        SameFlavourMass.axes,
        by=("lepton",),
        hard="SELECT * FROM obj WHERE coll > 0 AND pt > 10",
        exact="SELECT event_id, coll FROM hard GROUP BY 1, 2 HAVING count(*) = 2",
        cats="SELECT * FROM (VALUES ('mumu'), ('ee')) t(lepton)",
    ),
)
def agc_dilepton(inputs: Inputs) -> DataFrame:
    return SameFlavourMass().dense_histogram(inputs.zipped(**SameFlavourMass.reads))


@query(
    "ttbar_ht",
    q.dense_hist(
        "SELECT dataset, 'ht' AS variable, round(coalesce(sum(pt), 0), 6) AS v, 1e0 AS w FROM ev "
        "LEFT JOIN (SELECT * FROM jet WHERE pt > 25) j ON j.event_id = ev.event_id "
        "GROUP BY dataset, ev.event_id",
        JetHt.axes,
        weight=True,
    ),
)
def ttbar_ht(inputs: Inputs) -> DataFrame:
    return JetHt().dense_histogram(inputs.events)


# --- multi-lepton selection -------------------------------------------------------


def _region(barrel: str, endcap: str) -> str:
    return (
        f"((abs(eta) < 1.479e0 AND {barrel}) OR "
        f"(abs(eta) > 1.479e0 AND abs(eta) < 2.5e0 AND {endcap}))"
    )


VERTEX = "abs(dxy) < 0.05e0 AND abs(dz) < 0.1e0 AND iso < 0.4e0"
LOOSE_MU = f"pt > 5 AND abs(eta) < 2.4e0 AND {VERTEX} AND sip3d < 8 AND loose_id"
LOOSE_EL = (
    f"pt > 7 AND abs(eta) < 2.5e0 AND {VERTEX} AND lost_hits < 2 AND "
    + _region("mva_iso > 0", "mva_iso > 0.7e0")
)


def _tight(charge: int) -> str:
    both = f"pt > 15 AND tight_charge > {charge} AND mva_tth > 0.9e0"
    slope = "slope > -0.05e0 AND slope <"
    shape = " AND ".join(
        [
            _region("sieie < 0.011e0", "sieie < 0.03e0"),
            _region("hoe < 0.1e0", "hoe < 0.07e0"),
            _region(f"{slope} 0.01e0", f"{slope} 0.005e0"),
        ]
    )
    return (
        f"CASE WHEN coll = 1 THEN {both} AND medium_id "
        f"ELSE {both} AND lost_hits = 0 AND conv_veto AND {shape} END"
    )


def selection(charge: int = 0) -> dict[str, str]:
    """CTEs of the event selection; ``chosen(event_id, channel)`` is the result."""
    return {
        "loose": f"""SELECT *, coll - 1 AS flavor, {_tight(charge)} AS tight,
  row_number() OVER (PARTITION BY event_id ORDER BY coll, idx) - 1 AS pos
FROM obj WHERE (coll = 1 AND {LOOSE_MU}) OR (coll = 2 AND {LOOSE_EL})""",
        "tlep": """SELECT * REPLACE (
  row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS pos) FROM loose WHERE tight""",
        "j25": "SELECT * FROM jet WHERE pt > 25",
        "jmask": """SELECT event_id FROM j25 GROUP BY 1 HAVING
  count(*) FILTER (abs(eta) < 2.4e0 AND btag > 0.8484e0) >= 1 AND
  count(*) FILTER ((abs(eta) < 2.4e0 OR (pt > 40 AND abs(eta) > 2.4e0)) AND btag <= 0.5425e0) >= 1""",
        "jmedium": """SELECT event_id FROM j25 GROUP BY 1 HAVING
  count(*) FILTER (abs(eta) < 2.4e0 AND btag > 0.8484e0) >= 1""",
        "jlight": """SELECT event_id FROM j25 GROUP BY 1 HAVING
  count(*) FILTER ((abs(eta) < 2.4e0 OR (pt > 40 AND abs(eta) > 2.4e0)) AND btag <= 0.5425e0) >= 1""",
        "lmask": f"""SELECT a.event_id FROM loose a JOIN loose b
  ON a.event_id = b.event_id AND a.pos < b.pos
GROUP BY 1 HAVING min({q.mass("a", "b")}) >= 12""",
        "tpair": f"""SELECT a.event_id, a.pos AS i, b.pos AS j, {q.mass("a", "b")} AS m,
  {q.pt("a", "b")} AS pt, round(abs(a.phi - b.phi), 6) AS dphi, {q.dr("a", "b")} AS dr,
  a.charge = b.charge AS same, a.flavor = b.flavor AS sf, a.flavor + b.flavor AS ftype
FROM tlep a JOIN tlep b ON a.event_id = b.event_id AND a.pos < b.pos""",
        "tcount": """SELECT event_id, count(*) AS n, sum(flavor) AS fsum, max(pt) AS top,
  min(pt) AS low, sum(charge) AS charge FROM tlep GROUP BY 1""",
        "dilep": """SELECT c.event_id FROM tcount c JOIN tpair p ON p.event_id = c.event_id
WHERE c.n = 2 AND top > 25 AND same AND (ftype < 2 OR round(abs(m - 91.18e0), 6) > 10)""",
        "trilep": """SELECT c.event_id FROM tcount c WHERE n = 3 AND top > 25 AND NOT EXISTS (
  SELECT 1 FROM tpair p WHERE p.event_id = c.event_id AND sf AND NOT same
    AND round(abs(91.18e0 - m), 6) < 15)""",
        "chosen": """SELECT c.event_id, CASE WHEN n = 3 THEN 'lll' WHEN fsum = 0 THEN 'mumu'
  WHEN fsum = 1 THEN 'emu' ELSE 'ee' END AS channel
FROM tcount c WHERE c.event_id IN (SELECT event_id FROM dilep UNION SELECT event_id FROM trilep)
  AND c.event_id IN (SELECT event_id FROM jmask) AND c.event_id IN (SELECT event_id FROM lmask)""",
    }


EV = "SELECT event_id, sample AS dataset FROM ev"

VALUES = {
    "light": "SELECT * FROM j25 WHERE btag <= 0.5425e0",
    "bjet": """SELECT event_id, eta, row_number() OVER (PARTITION BY event_id
  ORDER BY pt DESC, idx) AS r FROM j25 WHERE btag > 0.8484e0""",
    "lightsum": """SELECT event_id, max(eta) AS fwd,
  max(CASE WHEN pt > 40 THEN abs(eta) END) AS maxeta,
  count(*) FILTER (abs(eta) > 1) AS neta1 FROM light GROUP BY 1""",
    "gap": """SELECT t.event_id, min(round(fwd - eta, 6)) AS gap FROM tlep t
JOIN lightsum s ON s.event_id = t.event_id GROUP BY 1""",
    "toppair": """SELECT event_id, dphi FROM (SELECT *, row_number() OVER (PARTITION BY event_id
  ORDER BY pt DESC, i, j) AS r FROM tpair) WHERE r = 1""",
    "mindr": "SELECT event_id, min(dr) AS dr FROM tpair GROUP BY 1",
    "n25": "SELECT event_id, count(*) FILTER (abs(eta) < 2.4e0) AS n25 FROM j25 GROUP BY 1",
    "evs": EV,
    "obs": """SELECT ch.event_id, evs.dataset, channel,
  CASE WHEN channel = 'lll' THEN c.low END AS third,
  CASE WHEN channel <> 'lll' THEN t1.pt END AS sublead,
  round(abs(fwd - b1.eta), 6) AS lead_gap, round(abs(fwd - b2.eta), 6) AS sub_gap,
  gap, dphi, coalesce(maxeta, 0e0) AS maxeta, dr, n25, neta1, c.charge
FROM chosen ch JOIN evs ON evs.event_id = ch.event_id JOIN tcount c ON c.event_id = ch.event_id
LEFT JOIN tlep t1 ON t1.event_id = ch.event_id AND t1.pos = 1
LEFT JOIN lightsum s ON s.event_id = ch.event_id
LEFT JOIN bjet b1 ON b1.event_id = ch.event_id AND b1.r = 1
LEFT JOIN bjet b2 ON b2.event_id = ch.event_id AND b2.r = 2
LEFT JOIN gap ON gap.event_id = ch.event_id
LEFT JOIN toppair p ON p.event_id = ch.event_id
LEFT JOIN mindr d ON d.event_id = ch.event_id
LEFT JOIN n25 ON n25.event_id = ch.event_id""",
}
NAMED = {
    "3rdLepton_pT": "third",
    "subleadLepton_pT": "sublead",
    "fwdJet_leadbJet": "lead_gap",
    "fwdJet_subleadbJet": "sub_gap",
    "fwdJet_closestLepton": "gap",
    "highpT_sslp": "dphi",
    "jetMaxEta": "maxeta",
    "minDelR": "dr",
    "nJet25": "n25",
    "nJetEta1": "neta1",
    "TotalCharge": "charge",
}
FILLS = " UNION ALL ".join(
    f"SELECT dataset, channel, '{name}' AS variable, CAST({column} AS DOUBLE) AS v FROM obs"
    for name, column in NAMED.items()
)
TOP = st.SingleTop()


def samples(inputs: Inputs, *collections: str) -> DataFrame:
    """Events labelled by simulated sample, with the fields of the selection in these collections, all by default."""
    reads = {c: f for c, f in st.READS.items() if c in (collections or st.READS)}
    return inputs.reading(**reads).withColumn("dataset", F.col("sample"))


LEPTONS = ("muons", "electrons")


@query(
    "thq_objects",
    q.counters(
        "SELECT dataset, lm, tm, le, te FROM evs LEFT JOIN (SELECT event_id, "
        "count(*) FILTER (coll = 1) AS lm, count(*) FILTER (coll = 1 AND tight) AS tm, "
        "count(*) FILTER (coll = 2) AS le, count(*) FILTER (coll = 2 AND tight) AS te "
        "FROM loose GROUP BY 1) USING (event_id)",
        {
            "loose muons": "lm",
            "tight muons": "tm",
            "loose electrons": "le",
            "tight electrons": "te",
        },
        **selection(),
        evs=EV,
    ),
)
def thq_objects(inputs: Inputs) -> DataFrame:
    def tight_in(collection):
        return lists.count_true(F.col(collection), lambda x: x["tight"])

    steps = {
        "loose muons": F.size("muons"),
        "tight muons": tight_in("muons"),
        "loose electrons": F.size("electrons"),
        "tight electrons": tight_in("electrons"),
    }
    return cutflow(st.objects(samples(inputs), parts=LEPTONS), steps)


@query(
    "thq_jet_masks",
    q.sql(
        "SELECT event_id, CAST(event_id IN (SELECT event_id FROM jmedium) AS INTEGER) AS has_b, "
        "CAST(event_id IN (SELECT event_id FROM jlight) AS INTEGER) AS has_light FROM ev",
        **selection(),
    ),
)
def thq_jet_masks(inputs: Inputs) -> DataFrame:
    picked = st.objects(samples(inputs), parts=("all_jets",))
    return picked.select(
        "event_id",
        (lists.count_true(F.col("jets"), st.medium_b) >= 1).cast("int").alias("has_b"),
        (lists.count_true(F.col("jets"), st.light) >= 1).cast("int").alias("has_light"),
    )


@query(
    "thq_loose_mass_veto",
    q.sql("SELECT event_id FROM lmask", **selection()),
)
def thq_loose_mass_veto(inputs: Inputs) -> DataFrame:
    picked = st.objects(samples(inputs).filter(F.col("nMuon") + F.col("nElectron") >= 2), parts=LEPTONS)
    return picked.filter(st.pair_masses_all_at_least(F.col("leptons"), 12)).select("event_id")


def _tight_only(inputs: Inputs) -> DataFrame:
    picked = st.objects(samples(inputs).filter(F.col("nMuon") + F.col("nElectron") >= 2), parts=LEPTONS)
    return picked.select(
        "event_id", lists.keep(F.col("leptons"), lambda x: x["tight"]).alias("tight")
    )


@query("thq_dilepton", q.sql("SELECT event_id FROM dilep", **selection()))
def thq_dilepton(inputs: Inputs) -> DataFrame:
    return _tight_only(inputs).filter(st.dilepton_passes(F.col("tight"))).select("event_id")


@query("thq_trilepton", q.sql("SELECT event_id FROM trilep", **selection()))
def thq_trilepton(inputs: Inputs) -> DataFrame:
    return _tight_only(inputs).filter(st.trilepton_passes(F.col("tight"))).select("event_id")


@query("thq_channels", q.sql("SELECT event_id, channel FROM chosen", **selection()))
def thq_channels(inputs: Inputs) -> DataFrame:
    return st.select(samples(inputs)).select("event_id", "channel")


@query(
    "thq_observables",
    q.sparse_hist(FILLS, TOP.axes, ("dataset", "channel"), **selection(), **VALUES),
)
def thq_observables(inputs: Inputs) -> DataFrame:
    """All histograms of all channels from one scan; flow bins included."""
    return TOP.histogram(samples(inputs))


@query(
    "thq_cutflow",
    q.counters(
        "SELECT dataset, lm, tm, le, te, n25, channel, n FROM evs LEFT JOIN (SELECT event_id, "
        "count(*) FILTER (coll = 1) AS lm, count(*) FILTER (coll = 1 AND tight) AS tm, "
        "count(*) FILTER (coll = 2) AS le, count(*) FILTER (coll = 2 AND tight) AS te "
        "FROM loose GROUP BY 1) USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS n25 "
        "FROM j25 GROUP BY 1) USING (event_id) LEFT JOIN chosen USING (event_id) "
        "LEFT JOIN tcount USING (event_id)",
        {
            "all events": "1",
            "loose muons": "lm",
            "tight muons": "tm",
            "loose electrons": "le",
            "tight electrons": "te",
            "jets > 25": "n25",
            "tight_ll": "CASE WHEN channel <> 'lll' THEN n END",
            "tights_2mu": "CASE WHEN channel = 'mumu' THEN n END",
            "tights_2e": "CASE WHEN channel = 'ee' THEN n END",
            "tights_emu": "CASE WHEN channel = 'emu' THEN n END",
            "jets through dilepton mask": "CASE WHEN channel <> 'lll' THEN n25 END",
            "tight_lll": "CASE WHEN channel = 'lll' THEN n END",
            "jets through trilepton mask": "CASE WHEN channel = 'lll' THEN n25 END",
        },
        **selection(),
        evs=EV,
    ),
)
def thq_cutflow(inputs: Inputs) -> DataFrame:
    return TOP.cutflow(samples(inputs))


WEIGHTS = (
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{name}', {xsec!r}e0, '{st.GROUPS[name]}')" for name, xsec in st.CROSS_SECTIONS.items()
    )
    + ") w(dataset, xsec, scaled)"
)


@query(
    "thq_scaled",
    q.sql(
        """SELECT scaled, channel, variable, bin, CAST(sum(n) AS BIGINT) AS n,
  round(sum(sumw * weight), 6) AS sumw, round(sum(sumw2 * weight * weight), 6) AS sumw2
FROM hist JOIN scales USING (dataset) GROUP BY ALL""",
        **selection(),
        **VALUES,
        fills=FILLS,
        **q.binned(TOP.axes, ("dataset", "channel")),
        weights=WEIGHTS,
        scales="""SELECT dataset, scaled, 35900e0 * xsec / entries AS weight FROM weights JOIN
  (SELECT sample AS dataset, count(*) AS entries FROM ev GROUP BY 1) USING (dataset)""",
    ),
)
def thq_scaled(inputs: Inputs) -> DataFrame:
    hist = TOP.scaled(samples(inputs))
    return hist.withColumns({c: F.round(c, 6) for c in ("sumw", "sumw2")})


@query(
    "tut_second_pt",
    q.dense_hist(
        "SELECT channel, 'pt2' AS variable, pt AS v FROM chosen JOIN tlep USING (event_id) "
        "WHERE pos = 1 AND channel IN ('mumu', 'ee')",
        st.SecondLeptonPt.axes,
        by=("channel",),
        cats="SELECT * FROM (VALUES ('mumu'), ('ee')) t(channel)",
        **selection(1),
    ),
)
def tut_second_pt(inputs: Inputs) -> DataFrame:
    return st.SecondLeptonPt().dense_histogram(samples(inputs))


@query(
    "tut_etadiff",
    q.dense_hist(
        """SELECT channel, 'etadiff' AS variable, round(abs(b.eta - l.eta), 6) AS v FROM chosen
JOIN (SELECT event_id, max(eta) AS eta FROM jet WHERE btag <= 0.5425e0 GROUP BY 1) l USING (event_id)
JOIN (SELECT event_id, eta, row_number() OVER (PARTITION BY event_id ORDER BY pt DESC, idx) AS r
  FROM jet WHERE btag > 0.8484e0) b USING (event_id) WHERE r = 1 AND channel = 'mumu'""",
        st.ForwardJetGap.axes,
        by=("channel",),
        cats="SELECT 'mumu' AS channel",
        **selection(1),
    ),
)
def tut_etadiff(inputs: Inputs) -> DataFrame:
    return st.ForwardJetGap().dense_histogram(samples(inputs))


EXPLORED = {
    "events": "1",
    "muons": "nm",
    "muons with pt > 10": "nmh",
    "electrons": "ne",
    "events with an electron": "CASE WHEN ne >= 1 THEN 1 END",
    "electrons in events with an electron": "CASE WHEN ne >= 1 THEN ne END",
}


@query(
    "explore_counts",
    q.counters(
        "SELECT dataset, nm, nmh, ne FROM ev LEFT JOIN (SELECT event_id, "
        "count(*) FILTER (coll = 1) AS nm, count(*) FILTER (coll = 1 AND pt > 10) AS nmh, "
        "count(*) FILTER (coll = 2) AS ne FROM obj GROUP BY 1) USING (event_id)",
        EXPLORED,
    ),
)
def explore_counts(inputs: Inputs) -> DataFrame:
    """Sizes before and after cuts on elements and on events."""
    some_electron = F.col("nElectron") >= 1
    steps = {
        "events": F.lit(1),
        "muons": F.col("nMuon"),
        "muons with pt > 10": lists.count_true(F.col("Muon.pt"), lambda pt: pt > 10),
        "electrons": F.col("nElectron"),
        "events with an electron": some_electron.cast("int"),
        "electrons in events with an electron": F.when(some_electron, F.col("nElectron")),
    }
    return cutflow(inputs.events, steps)
