"""Pairs, triples, cross products and matching inside one event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partonflow.catalog import sql as q
from partonflow.catalog.elements import LEP, leptons, per_event
from partonflow.catalog.registry import Inputs, query
from partonflow.functions import lists, p4
from partonflow.operators import combine, hist, lookup
from partonflow.operators.hist import Axis
from partonflow.operators.records import settle

P4 = ("pt", "eta", "phi", "mass")
PAIRS = "FROM mu a JOIN mu b ON a.event_id = b.event_id AND a.idx < b.idx"
LEP_PAIRS = "FROM lep a JOIN lep b ON a.event_id = b.event_id AND a.pos < b.pos"


MUONS = {"Muon": (*P4, "charge")}


def muon_vectors(*keep: str) -> Column:
    return p4.with_cartesian(F.col("Muon"), *keep)


@query(
    "pairs_self",
    q.sql(
        f"SELECT a.event_id, count(*) AS pairs, round(sum(a.pt), 6) AS first, "
        f"round(sum(b.pt), 6) AS second {PAIRS} GROUP BY 1"
    ),
)
def pairs_self(inputs: Inputs) -> DataFrame:
    """Unordered muon pairs, reduced to their number and the pt sums of either side."""
    two = inputs.reading(Muon=("pt", "eta")).filter(F.col("nMuon") >= 2)
    df = settle(two, ("event_id",), {"p": combine.pairs(F.col("Muon"))})
    return per_event(
        df,
        pairs=lists.num(F.col("p")),
        first=p4.stable(lists.total(F.col("p.i0.pt"))),
        second=p4.stable(lists.total(F.col("p.i1.pt"))),
    )


@query(
    "pairs_self_values",
    q.sql(f"SELECT a.event_id, round(max(a.pt - b.pt), 6) AS spread {LEP_PAIRS} GROUP BY 1", **LEP),
)
def pairs_self_values(inputs: Inputs) -> DataFrame:
    """Pairs of one field: largest pt difference, first minus second."""
    two = inputs.events.filter(F.col("nMuon") + F.col("nElectron") >= 2)
    pts = F.concat(F.col("Muon.pt"), F.col("Electron.pt"))
    pairs = combine.pairs(pts)
    spread = F.array_max(F.transform(pairs, lambda p: p["i0"] - p["i1"]))
    return per_event(two, spread=p4.stable(spread))


@query(
    "triples_self",
    q.sql(
        f"SELECT a.event_id, count(*) AS triples, max({q.mass('a', 'b', 'c')}) AS heaviest "
        "FROM jet a JOIN jet b ON a.event_id = b.event_id AND a.idx < b.idx "
        "JOIN jet c ON c.event_id = b.event_id AND b.idx < c.idx GROUP BY 1"
    ),
)
def triples_self(inputs: Inputs) -> DataFrame:
    three = inputs.reading(Jet=P4).filter(F.col("nJet") >= 3)
    masses = combine.triples(
        p4.with_cartesian(F.col("Jet")), lambda a, b, c: p4.stable(p4.mass(a, b, c))
    )
    df = settle(three, ("event_id",), {"m": masses})
    return per_event(df, triples=lists.num(F.col("m")), heaviest=F.array_max("m"))


@query(
    "argpairs_self",
    q.sql(
        f"SELECT a.event_id, CAST(sum(a.pos * 100 + b.pos) AS BIGINT) AS code, "
        f"round(sum(a.pt - b.pt), 6) AS looked_up {LEP_PAIRS} GROUP BY 1",
        **LEP,
    ),
)
def argpairs_self(inputs: Inputs) -> DataFrame:
    """Position pairs first, values looked up afterwards."""
    two = inputs.events.filter(F.col("nMuon") + F.col("nElectron") >= 2)
    pts = F.concat(F.col("Muon.pt"), F.col("Electron.pt"))
    df = settle(settle(two, ("event_id",), {"pts": pts}), ("event_id", "pts"), {
        "p": combine.arg_pairs(F.col("pts"))
    })
    values = F.transform("p", lambda p: F.get("pts", p["i0"]) - F.get("pts", p["i1"]))
    code = lists.total_int(F.transform("p", lambda p: p["i0"] * 100 + p["i1"]))
    return per_event(df, code=code, looked_up=p4.stable(lists.total(values)))


@query(
    "argtriples_self",
    q.sql(
        "SELECT a.event_id, CAST(sum(a.pos * 10000 + b.pos * 100 + c.pos) AS BIGINT) AS code, "
        f"count(*) AS triples {LEP_PAIRS} JOIN lep c ON c.event_id = b.event_id AND b.pos < c.pos "
        "GROUP BY 1",
        **LEP,
    ),
)
def argtriples_self(inputs: Inputs) -> DataFrame:
    three = inputs.events.filter(F.col("nMuon") + F.col("nElectron") >= 3)
    pts = F.concat(F.col("Muon.pt"), F.col("Electron.pt"))
    df = settle(three, ("event_id",), {"t": combine.arg_triples(pts)})
    codes = F.transform("t", lambda t: t["i0"] * 10000 + t["i1"] * 100 + t["i2"])
    return per_event(df, code=lists.total_int(codes), triples=lists.num(F.col("t")))


JET_MUON = "FROM jet j JOIN mu m ON m.event_id = j.event_id"


@query(
    "cross_pairs",
    q.sql(
        f"SELECT j.event_id, count(*) AS pairs, round(max(abs(j.eta - m.eta)), 6) AS widest "
        f"{JET_MUON} GROUP BY 1"
    ),
)
def cross_pairs(inputs: Inputs) -> DataFrame:
    """Every jet with every muon of the event."""
    events = inputs.reading(Jet=("eta",), Muon=("eta",))
    both = events.filter((F.col("nJet") >= 1) & (F.col("nMuon") >= 1))
    gaps = combine.cross(F.col("Jet"), F.col("Muon"), p4.delta_eta)
    df = settle(both, ("event_id",), {"g": gaps})
    return per_event(df, pairs=lists.num(F.col("g")), widest=p4.stable(F.array_max("g")))


@query(
    "cross_pairs_nested",
    q.sql(
        "SELECT j.event_id, CAST(j.idx AS INTEGER) AS pos, count(m.event_id) AS pairs, "
        "round(coalesce(sum(m.pt), 0), 6) AS muon_pt FROM jet j LEFT JOIN mu m "
        "ON m.event_id = j.event_id GROUP BY 1, 2"
    ),
)
def cross_pairs_nested(inputs: Inputs) -> DataFrame:
    """Pairs grouped by jet; a jet without muons keeps an empty group."""
    nested = combine.cross_nested(F.col("Jet.pt"), F.col("Muon.pt"))
    groups = inputs.events.select("event_id", F.posexplode(nested).alias("pos", "g"))
    return groups.select(
        "event_id",
        "pos",
        lists.num(F.col("g")).alias("pairs"),
        p4.stable(lists.total(F.col("g.i1"))).alias("muon_pt"),
    )


@query(
    "cross_scalar_list",
    q.sql(
        f"SELECT l.event_id, CAST(l.pos AS INTEGER) AS pos, "
        f"round({q.dphi('met_phi', 'l.phi')}, 6) AS dphi FROM lep l JOIN ev USING (event_id)",
        **LEP,
    ),
)
def cross_scalar_list(inputs: Inputs) -> DataFrame:
    """The MET record with every lepton."""
    phis = F.concat(F.col("Muon.phi"), F.col("Electron.phi"))
    angles = F.transform(phis, lambda phi: p4.stable(p4.delta_phi(F.col("MET.phi"), phi)))
    return inputs.events.select("event_id", F.posexplode(angles).alias("pos", "dphi"))


@query(
    "nearest_match",
    q.sql(
        "SELECT j.event_id, CAST(j.idx AS INTEGER) AS pos, dr, CAST(i AS INTEGER) AS muon FROM jet j "
        "LEFT JOIN near n ON n.event_id = j.event_id AND n.idx = j.idx AND r = 1",
        near=f"""SELECT *, row_number() OVER (PARTITION BY event_id, idx ORDER BY dr, i) AS r FROM (
  SELECT j.event_id, j.idx, m.idx AS i, {q.dr("j", "m")} AS dr {JET_MUON})""",
    ),
)
def nearest_match(inputs: Inputs) -> DataFrame:
    """Closest muon of each jet."""
    events = inputs.reading(Jet=("eta", "phi"), Muon=("eta", "phi"))
    found = combine.nearest(F.col("Jet"), F.col("Muon"))
    rows = events.select("event_id", F.posexplode(found).alias("pos", "n"))
    return rows.select("event_id", "pos", "n.dr", F.col("n.i").alias("muon"))


@query(
    "isolation_filter",
    q.sql(
        "SELECT j.event_id, j.pt FROM jet j WHERE NOT EXISTS (SELECT 1 FROM obj l "
        f"WHERE l.coll > 0 AND l.event_id = j.event_id AND {q.dr('j', 'l')} <= 0.4)"
    ),
)
def isolation_filter(inputs: Inputs) -> DataFrame:
    """Jets further than 0.4 from every lepton."""
    events = inputs.reading(
        Jet=("pt", "eta", "phi"), Muon=("eta", "phi"), Electron=("eta", "phi")
    )
    kept = combine.isolated(F.col("Jet"), leptons("eta", "phi"), 0.4)
    return events.select("event_id", F.explode(kept).alias("j")).select("event_id", "j.pt")


def window_pair() -> Column:
    """Opposite-charge muon pair with mass in [60, 120)."""
    masses = combine.pairs(
        muon_vectors("charge"),
        lambda a, b: F.when(a["charge"] != b["charge"], p4.stable(p4.mass(a, b))),
    )
    return lists.some(masses, lambda m: (m >= 60) & (m < 120))


WINDOW_SQL = (
    f"EXISTS (SELECT 1 {PAIRS} WHERE a.event_id = ev.event_id AND a.charge <> b.charge "
    f"AND {q.mass('a', 'b')} >= 60 AND {q.mass('a', 'b')} < 120)"
)


@query("semi_exists_pair", q.sql(f"SELECT event_id FROM ev WHERE {WINDOW_SQL}"))
def semi_exists_pair(inputs: Inputs) -> DataFrame:
    two = inputs.reading(**MUONS).filter(F.col("nMuon") >= 2)
    return two.filter(window_pair()).select("event_id")


@query("anti_exists_pair", q.sql(f"SELECT event_id FROM ev WHERE NOT {WINDOW_SQL}"))
def anti_exists_pair(inputs: Inputs) -> DataFrame:
    return inputs.reading(**MUONS).filter((F.col("nMuon") < 2) | ~window_pair()).select("event_id")


@query(
    "mask_veto",
    q.sql(
        "SELECT event_id FROM ev WHERE event_id IN (SELECT event_id FROM mu) AND NOT EXISTS "
        f"(SELECT 1 {PAIRS} WHERE a.event_id = ev.event_id AND a.charge <> b.charge "
        f"AND round(abs({q.mass('a', 'b')} - 91.18e0), 6) < 15)"
    ),
)
def mask_veto(inputs: Inputs) -> DataFrame:
    """Events with muons, none of whose opposite-charge pairs is near the Z mass."""
    offs = combine.pairs(
        muon_vectors("charge"),
        lambda a, b: F.when(
            a["charge"] != b["charge"], p4.stable(F.abs(p4.stable(p4.mass(a, b)) - 91.18))
        ),
    )
    veto = lists.some(offs, lambda d: d < 15)
    return inputs.reading(**MUONS).filter(F.col("nMuon") >= 1).filter(~veto).select("event_id")


BEST = {
    "best": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, i, j)
  AS r FROM (SELECT a.event_id, a.idx AS i, b.idx AS j, {q.mass("a", "b")} AS m,
  round(abs({q.mass("a", "b")} - 91.2e0), 6) AS d {PAIRS} WHERE a.charge <> b.charge)) WHERE r = 1"""
}


def best_pair() -> Column:
    """Opposite-charge muon pair closest to the Z mass: (d, i, j, m), first one wins."""

    def scored(i: Column, j: Column, a: Column, b: Column) -> Column:
        m = p4.stable(p4.mass(a, b))
        return F.when(
            a["charge"] != b["charge"],
            F.struct(
                p4.stable(F.abs(m - 91.2)).alias("d"), i.alias("i"), j.alias("j"), m.alias("m")
            ),
        )

    return F.array_min(combine.arg_pairs(muon_vectors("charge"), scored))


@query("closest_to_target", q.sql("SELECT event_id, m, d FROM best", **BEST))
def closest_to_target(inputs: Inputs) -> DataFrame:
    df = settle(inputs.reading(**MUONS).filter(F.col("nMuon") >= 2), ("event_id",), {"best": best_pair()})
    return df.filter(F.col("best").isNotNull()).select("event_id", "best.m", "best.d")


@query(
    "exclude_by_index",
    q.sql(
        "SELECT k.event_id, mu.pt FROM best k JOIN mu ON mu.event_id = k.event_id "
        "AND mu.idx <> k.i AND mu.idx <> k.j",
        **BEST,
    ),
)
def exclude_by_index(inputs: Inputs) -> DataFrame:
    """Muons outside the chosen pair."""
    df = settle(
        inputs.reading(**MUONS).filter(F.col("nMuon") >= 3),
        ("event_id",),
        {"best": best_pair(), "pts": F.col("Muon.pt")},
    ).filter(F.col("best").isNotNull())
    rest = lists.without(F.col("pts"), F.col("best.i"), F.col("best.j"))
    return df.select("event_id", F.explode(rest).alias("pt"))


@query(
    "best_by_key",
    q.sql(
        "SELECT event_id, pt, dphi FROM (SELECT *, row_number() OVER "
        "(PARTITION BY event_id ORDER BY pt DESC, i, j) AS r FROM p) WHERE r = 1",
        p=f"SELECT a.event_id, a.idx AS i, b.idx AS j, {q.pt('a', 'b')} AS pt, "
        f"round(abs(a.phi - b.phi), 6) AS dphi {PAIRS}",
    ),
)
def best_by_key(inputs: Inputs) -> DataFrame:
    """Muon pair with the largest pt."""
    pairs = combine.pairs(
        p4.with_cartesian(F.col("Muon"), "phi"),
        lambda a, b: F.struct(
            p4.stable(p4.pt(a, b)).alias("pt"),
            p4.stable(p4.delta_phi_raw(a["phi"], b["phi"])).alias("dphi"),
        ),
    )
    best = lists.at_max(pairs, lambda p: p["pt"])
    df = settle(inputs.reading(**MUONS).filter(F.col("nMuon") >= 2), ("event_id",), {"best": best})
    return df.select("event_id", "best.*")


TAG_AXIS = Axis("pt", 20, 0, 100)
TAGGED = "SELECT event_id, pt, btag > 0.5e0 AS tagged, least(floor(pt / 5e0), 20) AS bin FROM jet"


@query(
    "lookup_binned",
    q.sql(
        "SELECT dataset, round(sum(factor), 6) AS corrected, count(*) AS jets FROM tagged "
        "JOIN eff USING (bin) JOIN ev USING (event_id) GROUP BY 1",
        tagged=TAGGED,
        eff="SELECT bin, CAST(count(*) FILTER (tagged) AS DOUBLE) / count(*) AS factor "
        "FROM tagged GROUP BY 1",
    ),
)
def lookup_binned(inputs: Inputs) -> DataFrame:
    """Tagging efficiency per pt bin, measured and then looked up for every jet."""
    jets = inputs.reading(Jet=("pt", "btag")).select("dataset", F.explode("Jet").alias("j"))
    rows = jets.select("dataset", "j.pt", "j.btag")
    # Both histograms of the efficiency are one pass, with the decision as a category.
    both = hist.fill(rows.withColumn("tagged", F.col("btag") > 0.5), [TAG_AXIS], ("tagged",))
    table = lookup.efficiency_of(both, "tagged")
    corrected = lookup.with_factor(rows, TAG_AXIS, table)
    return corrected.groupBy("dataset").agg(
        F.round(F.sum("factor"), 6).alias("corrected"), F.count(F.lit(1)).alias("jets")
    )
