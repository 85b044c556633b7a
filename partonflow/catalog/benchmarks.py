"""Benchmark queries: histogram and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from partonflow.catalog import sql as q
from partonflow.catalog.registry import Inputs, query
from partonflow.plans.benchmarks import BENCHMARKS


def _axes(name: str):
    return BENCHMARKS[name].axes


DIMUON = f"""SELECT a.event_id, {q.mass("a", "b")} AS m FROM mu a
JOIN mu b ON a.event_id = b.event_id AND a.idx < b.idx AND a.charge <> b.charge"""

TRIJET = f"""SELECT *, round(abs(172.5e0 - m), 6) AS d FROM (
  SELECT a.event_id, {q.mass("a", "b", "c")} AS m, {q.pt("a", "b", "c")} AS pt,
    greatest(a.btag, b.btag, c.btag) AS tag
  FROM jet a JOIN jet b ON a.event_id = b.event_id AND a.idx < b.idx
  JOIN jet c ON c.event_id = b.event_id AND b.idx < c.idx
  WHERE a.pt > 30 AND b.pt > 30 AND c.pt > 30)"""

ISOLATION = f"""SELECT j.event_id, j.idx, j.pt,
  coalesce(min(CASE WHEN l.coll = 1 THEN {q.dr("j", "l")} END), 1e9) > 0.4 AS m,
  coalesce(min(CASE WHEN l.coll = 2 THEN {q.dr("j", "l")} END), 1e9) > 0.4 AS e
FROM jet j LEFT JOIN obj l ON l.event_id = j.event_id AND l.coll > 0 AND l.pt > 10
WHERE j.pt > 30 GROUP BY j.event_id, j.idx, j.pt"""

LEPTONS = """SELECT *, coll - 1 AS flavor,
  row_number() OVER (PARTITION BY event_id ORDER BY coll, idx) - 1 AS pos
FROM obj WHERE pt > 10 AND ((coll = 1 AND abs(eta) < 2.4) OR (coll = 2 AND abs(eta) < 2.5))"""
CROWDED = "SELECT event_id, count(*) AS n FROM lep GROUP BY 1 HAVING count(*) >= 3"
ZPAIR = f"""SELECT event_id, i, j FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, i, j) AS r FROM (
    SELECT a.event_id, a.pos AS i, b.pos AS j, round(abs({q.mass("a", "b")} - 91.2e0), 6) AS d
    FROM lep a JOIN lep b ON a.event_id = b.event_id AND a.pos < b.pos
    JOIN crowded c ON c.event_id = a.event_id
    WHERE a.flavor = b.flavor AND a.charge <> b.charge)) WHERE r = 1"""
REST = """SELECT l.* FROM lep l JOIN zpair z ON l.event_id = z.event_id
  AND l.pos <> z.i AND l.pos <> z.j"""
THIRD = """SELECT * FROM (SELECT *,
  row_number() OVER (PARTITION BY event_id ORDER BY pt DESC, pos) AS r FROM rest) WHERE r = 1"""
THIRD_CTES = {"lep": LEPTONS, "crowded": CROWDED, "zpair": ZPAIR, "rest": REST, "third": THIRD}

HIST_SQL = {
    "adl1_met": q.dense_hist(
        "SELECT dataset, 'MET' AS variable, met_pt AS v FROM ev", _axes("adl1_met")
    ),
    "adl2_jet_pt": q.dense_hist(
        "SELECT dataset, 'Jet_pt' AS variable, pt AS v FROM jet JOIN ev USING (event_id)",
        _axes("adl2_jet_pt"),
    ),
    "adl3_jet_pt_eta": q.dense_hist(
        "SELECT dataset, 'Jet_pt' AS variable, pt AS v FROM jet JOIN ev USING (event_id) "
        "WHERE abs(eta) < 1",
        _axes("adl3_jet_pt_eta"),
    ),
    "adl4_met_2jets": q.dense_hist(
        "SELECT dataset, 'MET_pt' AS variable, met_pt AS v FROM ev WHERE event_id IN "
        "(SELECT event_id FROM jet WHERE pt > 40 GROUP BY 1 HAVING count(*) >= 2)",
        _axes("adl4_met_2jets"),
    ),
    "adl5_met_dimuon": q.dense_hist(
        "SELECT dataset, 'MET' AS variable, met_pt AS v FROM ev WHERE event_id IN "
        "(SELECT event_id FROM dimuon WHERE m >= 60 AND m < 120)",
        _axes("adl5_met_dimuon"),
        dimuon=DIMUON,
    ),
    "adl6_trijet": q.dense_hist(
        "SELECT dataset, 'Jet_pt' AS variable, pt AS v FROM best JOIN ev USING (event_id) "
        "UNION ALL SELECT dataset, 'b_tag', tag FROM best JOIN ev USING (event_id)",
        _axes("adl6_trijet"),
        trijet=TRIJET,
        best="SELECT t.* FROM trijet t JOIN (SELECT event_id, min(d) AS d FROM trijet GROUP BY 1) m "
        "ON t.event_id = m.event_id AND t.d = m.d",
    ),
    "adl7_jet_iso_ht": q.dense_hist(
        "SELECT dataset, 'Jet_pt' AS variable, round(coalesce(sum(pt), 0), 6) AS v FROM ev "
        "LEFT JOIN (SELECT * FROM iso WHERE m AND e) k ON k.event_id = ev.event_id "
        "GROUP BY dataset, ev.event_id",
        _axes("adl7_jet_iso_ht"),
        iso=ISOLATION,
    ),
    "adl8_mt_third_lepton": q.dense_hist(
        f"SELECT dataset, 'massT' AS variable, round(sqrt(2e0 * met_pt * t.pt * "
        f"(1e0 - cos({q.dphi('met_phi', 't.phi')}))), 6) AS v "
        "FROM third t JOIN ev USING (event_id)",
        _axes("adl8_mt_third_lepton"),
        **THIRD_CTES,
    ),
}

#: Fixed value of the query: chunks of 1,000 events.
CHUNKS = "CASE WHEN rn % 1000 = 1 THEN 1 ELSE 0 END"
N_JETS = "SELECT event_id, count(*) AS n FROM jet GROUP BY 1"
COUNTER_SQL = {
    "adl1_met": q.counters("SELECT dataset, row_number() OVER (PARTITION BY dataset) AS rn FROM ev", {"all events": "1", "number of chunks": CHUNKS}),
    "adl2_jet_pt": q.counters(
        "SELECT dataset, n FROM ev LEFT JOIN nj USING (event_id)",
        {"all events": "1", "all jets": "n"},
        nj=N_JETS,
    ),
    "adl3_jet_pt_eta": q.counters(
        "SELECT dataset, n, c FROM ev LEFT JOIN nj USING (event_id) LEFT JOIN "
        "(SELECT event_id, count(*) AS c FROM jet WHERE abs(eta) < 1 GROUP BY 1) USING (event_id)",
        {"all events": "1", "number of jets": "n", "abs(eta) < 1": "c", "final good jets": "c"},
        nj=N_JETS,
    ),
    "adl4_met_2jets": q.counters(
        "SELECT dataset, f FROM ev LEFT JOIN (SELECT event_id, 1 AS f FROM jet WHERE pt > 40 "
        "GROUP BY 1 HAVING count(*) >= 2) USING (event_id)",
        {"all events": "1", "final events": "f"},
    ),
    "adl5_met_dimuon": q.counters(
        "SELECT dataset, n, f FROM ev LEFT JOIN (SELECT event_id, count(*) AS n FROM mu GROUP BY 1) "
        "USING (event_id) LEFT JOIN (SELECT DISTINCT event_id, 1 AS f FROM dimuon "
        "WHERE m >= 60 AND m < 120) USING (event_id)",
        {"all events": "1", "all muons": "n", "final events": "f"},
        dimuon=DIMUON,
    ),
    "adl7_jet_iso_ht": q.counters(
        "SELECT dataset, n, nm, ne, g, gm, ge, gb FROM ev LEFT JOIN nj USING (event_id) "
        "LEFT JOIN (SELECT event_id, count(*) FILTER (coll = 1) AS nm, "
        "count(*) FILTER (coll = 2) AS ne FROM obj WHERE coll > 0 AND pt > 10 GROUP BY 1) "
        "USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS g, count(*) FILTER (m) AS gm, "
        "count(*) FILTER (e) AS ge, count(*) FILTER (m AND e) AS gb FROM iso GROUP BY 1) "
        "USING (event_id)",
        {
            "all events": "1",
            "all jets": "n",
            "jets with pt > 30": "g",
            "muons with pt > 10": "nm",
            "electrons with pt > 10": "ne",
            "jet-muon pairs": "gm",
            "jet-electron pairs": "ge",
            "jet-lepton pairs": "gb",
            "final jets": "gb",
        },
        nj=N_JETS,
        iso=ISOLATION,
    ),
    "adl8_mt_third_lepton": q.counters(
        "SELECT dataset, nm, ne, c.n AS n3, nr FROM ev LEFT JOIN (SELECT event_id, "
        "count(*) FILTER (coll = 1) AS nm, count(*) FILTER (coll = 2) AS ne FROM lep GROUP BY 1) "
        "USING (event_id) LEFT JOIN crowded c USING (event_id) LEFT JOIN "
        "(SELECT event_id, count(*) AS nr FROM rest GROUP BY 1) USING (event_id)",
        {
            "all events": "1",
            "all muons": "nm",
            "all electrons": "ne",
            "trileptons": "n3",
            "number of final leading leptons": "nr",
        },
        **THIRD_CTES,
    ),
}


def _register(name: str) -> None:
    analysis = BENCHMARKS[name]

    @query(name, HIST_SQL[name])
    def histogram(inputs: Inputs) -> DataFrame:
        return analysis.dense_histogram(inputs.events_for(analysis))

    if name in COUNTER_SQL:

        @query(f"{name}_cutflow", COUNTER_SQL[name])
        def counted(inputs: Inputs) -> DataFrame:
            return analysis.cutflow(inputs.events_for(analysis))


for _name in BENCHMARKS:
    _register(_name)
