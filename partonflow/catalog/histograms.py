"""Filling, merging, scaling and reshaping histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.catalog import sql as q
from partonflow.catalog.registry import Inputs, query
from partonflow.functions import lists
from partonflow.operators import hist
from partonflow.operators.hist import Axis
from partonflow.plans import single_top as st
from partonflow.plans.benchmarks import MissingEnergy

MET = MissingEnergy()
MET_AXES = MET.axes
MET_FILLS = "SELECT dataset, 'MET' AS variable, met_pt AS v FROM ev"
VISIBLE = "bin >= 0 AND bin < bins"
VISIBLE_SELECT = (
    "variable, bin, first + bin * width AS lo, first + (bin + 1) * width AS hi, n, sumw, sumw2 "
    f"FROM hist WHERE {VISIBLE}"
)


@query(
    "hist_1d",
    q.sql(
        f"SELECT dataset, {VISIBLE_SELECT}", fills=MET_FILLS, **q.binned(MET_AXES, ("dataset",))
    ),
)
def hist_1d(inputs: Inputs) -> DataFrame:
    return hist.visible(MET.histogram(inputs.events), MET_AXES)


PT = Axis("lepton_pt", 40, 0, 120)


@query(
    "hist_cat_axis",
    q.sparse_hist(
        "SELECT dataset, CASE coll WHEN 1 THEN 'mu' ELSE 'e' END AS lepton, "
        "'lepton_pt' AS variable, pt AS v FROM obj JOIN ev USING (event_id) WHERE coll > 0",
        [PT],
        ("dataset", "lepton"),
    ),
)
def hist_cat_axis(inputs: Inputs) -> DataFrame:
    """Two category axes: dataset and lepton kind."""
    kinds = F.explode(
        F.array(
            F.struct(F.lit("mu").alias("lepton"), F.col("Muon.pt").alias("lepton_pt")),
            F.struct(F.lit("e").alias("lepton"), F.col("Electron.pt").alias("lepton_pt")),
        )
    )
    rows = inputs.events.select("dataset", kinds.alias("k")).select("dataset", "k.*")
    return hist.fill(rows, [PT], ("dataset", "lepton"))


JOINT = (Axis("pt", 10, 0, 100), Axis("eta", 10, -2.5, 2.5), Axis("btag", 4, 0, 1))


@query(
    "hist_multi_axis",
    q.sql(
        "SELECT dataset, pt_bin, eta_bin, btag_bin, count(*) AS n, CAST(count(*) AS DOUBLE) AS sumw, "
        "CAST(count(*) AS DOUBLE) AS sumw2 FROM b GROUP BY ALL",
        b="SELECT dataset, CAST(CASE WHEN pt < 0 THEN -1 WHEN pt >= 100 THEN 10 "
        "ELSE floor(pt / 10e0) END AS INTEGER) AS pt_bin, CAST(CASE WHEN eta < -2.5e0 THEN -1 "
        "WHEN eta >= 2.5e0 THEN 10 ELSE floor((eta + 2.5e0) / 0.5e0) END AS INTEGER) AS eta_bin, "
        "CAST(CASE WHEN btag < 0 THEN -1 WHEN btag >= 1 THEN 4 ELSE floor(btag / 0.25e0) END "
        "AS INTEGER) AS btag_bin FROM jet JOIN ev USING (event_id)",
    ),
)
def hist_multi_axis(inputs: Inputs) -> DataFrame:
    jets = inputs.reading(Jet=("pt", "eta", "btag")).select("dataset", F.explode("Jet").alias("j"))
    return hist.fill_joint(jets.select("dataset", "j.pt", "j.eta", "j.btag"), JOINT)


@query("hist_dense", q.dense_hist(MET_FILLS, MET_AXES))
def hist_dense(inputs: Inputs) -> DataFrame:
    return hist.dense(MET.tally(inputs.events), MET_AXES)


@query(
    "hist_weighted",
    q.sql(
        "SELECT dataset, variable, bin, n, round(sumw, 5) AS sumw, round(sumw2, 3) AS sumw2 "
        "FROM hist",
        fills="SELECT dataset, 'MET' AS variable, met_pt AS v, coalesce(w, 0e0) AS w FROM ev "
        "LEFT JOIN (SELECT event_id, sum(pt) AS w FROM jet GROUP BY 1) USING (event_id)",
        **q.binned(MET_AXES, ("dataset",), weight=True),
    ),
)
def hist_weighted(inputs: Inputs) -> DataFrame:
    """MET weighted by the scalar sum of jet pt, which has five decimals."""
    rows = inputs.events.select(
        "dataset", F.col("MET.pt").alias("MET"), lists.total(F.col("Jet.pt")).alias("w")
    )
    filled = hist.fill(rows, MET_AXES, weight="w")
    return filled.withColumns({"sumw": F.round("sumw", 5), "sumw2": F.round("sumw2", 3)})


@query(
    "hist_many_fills",
    q.sparse_hist(
        "SELECT dataset, 'lepton_pt' AS variable, pt AS v FROM obj JOIN ev USING (event_id) "
        "WHERE coll > 0",
        [PT],
    ),
)
def hist_many_fills(inputs: Inputs) -> DataFrame:
    """One histogram filled with muons and with electrons, in one pass."""
    both = F.concat(F.col("Muon.pt"), F.col("Electron.pt"))
    return hist.fill(inputs.events.select("dataset", both.alias("lepton_pt")), [PT])


WHOLE = (Axis("nJet", 6, 2, 8), Axis("charge", 5, -2, 3))


@query(
    "hist_integer",
    q.sparse_hist(
        "SELECT dataset, 'nJet' AS variable, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM ev LEFT JOIN "
        "(SELECT event_id, count(*) AS n FROM jet GROUP BY 1) USING (event_id) UNION ALL "
        "SELECT dataset, 'charge', CAST(coalesce(c, 0) AS DOUBLE) FROM ev LEFT JOIN "
        "(SELECT event_id, sum(charge) AS c FROM mu GROUP BY 1) USING (event_id)",
        WHOLE,
    ),
)
def hist_integer(inputs: Inputs) -> DataFrame:
    """Bins of width 1 over a count and a charge."""
    rows = inputs.events.select(
        "dataset", "nJet", lists.total_int(F.col("Muon.charge")).alias("charge")
    )
    return hist.fill(rows, WHOLE)


@query(
    "hist_flow",
    q.sql(
        "SELECT dataset, variable, bin, n, sumw, sumw2, CASE WHEN bin < 0 THEN 'underflow' "
        "ELSE 'overflow' END AS side FROM hist WHERE bin < 0 OR bin >= bins",
        fills="SELECT dataset, 'Jet_pt' AS variable, pt AS v FROM jet JOIN ev USING (event_id)",
        **q.binned([Axis("Jet_pt", 100, 15, 60)], ("dataset",)),
    ),
)
def hist_flow(inputs: Inputs) -> DataFrame:
    axes = [Axis("Jet_pt", 100, 15, 60)]
    rows = inputs.events.select("dataset", F.col("Jet.pt").alias("Jet_pt"))
    return hist.flow(hist.fill(rows, axes), axes)


@query(
    "cutflow",
    q.counters(
        "SELECT dataset, nj, n40 FROM ev LEFT JOIN (SELECT event_id, count(*) AS nj, "
        "count(*) FILTER (pt > 40) AS n40 FROM jet GROUP BY 1) USING (event_id)",
        {
            "all events": "1",
            "with jets": "CASE WHEN nj >= 1 THEN 1 END",
            "jets": "nj",
            "two jets > 40": "CASE WHEN n40 >= 2 THEN 1 END",
        },
    ),
)
def cutflow(inputs: Inputs) -> DataFrame:
    hard = lists.count_true(F.col("Jet.pt"), lambda pt: pt > 40)
    steps = {
        "all events": F.lit(1),
        "with jets": (F.col("nJet") >= 1).cast("int"),
        "jets": F.col("nJet"),
        "two jets > 40": (hard >= 2).cast("int"),
    }
    return hist.cutflow(inputs.events, steps)


@query("merge_partial", q.sparse_hist(MET_FILLS, MET_AXES))
def merge_partial(inputs: Inputs) -> DataFrame:
    """Histograms of two complementary parts of the data add up to the whole."""
    events = inputs.events
    with_jets = MET.histogram(events.filter(F.col("nJet") > 0))
    without = MET.histogram(events.filter(F.col("nJet") == 0))
    return hist.merge(with_jets, without)


MANY = (MET_AXES[0], Axis("Jet_pt", 100, 15, 60), Axis("Muon_eta", 50, -2.5, 2.5), WHOLE[0])


@query(
    "dict_of_results",
    q.sparse_hist(
        MET_FILLS
        + " UNION ALL SELECT dataset, 'Jet_pt', pt FROM jet JOIN ev USING (event_id)"
        + " UNION ALL SELECT dataset, 'Muon_eta', eta FROM mu JOIN ev USING (event_id)"
        + " UNION ALL SELECT dataset, 'nJet', CAST(coalesce(n, 0) AS DOUBLE) FROM ev LEFT JOIN "
        "(SELECT event_id, count(*) AS n FROM jet GROUP BY 1) USING (event_id)",
        MANY,
    ),
)
def dict_of_results(inputs: Inputs) -> DataFrame:
    """Several histograms of different collections from one scan and one shuffle."""
    rows = inputs.events.select(
        "dataset",
        F.col("MET.pt").alias("MET"),
        F.col("Jet.pt").alias("Jet_pt"),
        F.col("Muon.eta").alias("Muon_eta"),
        "nJet",
    )
    return hist.fill(rows, MANY)


SAMPLE_FILLS = "SELECT sample AS dataset, 'MET' AS variable, met_pt AS v FROM ev"
WEIGHT_ROWS = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', {x!r}e0, '{st.GROUPS[k]}')" for k, x in st.CROSS_SECTIONS.items())
    + ") w(dataset, xsec, grouped)"
)
ENTRIES = "SELECT sample AS dataset, count(*) AS entries FROM ev GROUP BY 1"


def by_sample(inputs: Inputs) -> DataFrame:
    """Events labelled by simulated sample."""
    return inputs.events.select(F.col("sample").alias("dataset"), F.col("MET.pt").alias("MET"))


@query(
    "scale_by_weight",
    q.sql(
        "SELECT dataset, variable, bin, n, round(sumw * 35900e0 * xsec / entries, 6) AS sumw, "
        "round(sumw2 * (35900e0 * xsec / entries) * (35900e0 * xsec / entries), 6) AS sumw2 "
        "FROM hist JOIN xs USING (dataset) JOIN counted USING (dataset)",
        fills=SAMPLE_FILLS,
        **q.binned(MET_AXES, ("dataset",)),
        xs=WEIGHT_ROWS,
        counted=ENTRIES,
    ),
)
def scale_by_weight(inputs: Inputs) -> DataFrame:
    told = hist.tally(by_sample(inputs), MET_AXES, counters=[])
    scaled = hist.scaled(told, st.CROSS_SECTIONS, st.LUMINOSITY)
    return scaled.withColumns({c: F.round(c, 6) for c in ("sumw", "sumw2")})


@query(
    "regroup_categories",
    q.sql(
        "SELECT grouped AS scaled, variable, bin, CAST(sum(n) AS BIGINT) AS n, sum(sumw) AS sumw, "
        "sum(sumw2) AS sumw2 FROM hist JOIN xs USING (dataset) GROUP BY ALL",
        fills=SAMPLE_FILLS,
        **q.binned(MET_AXES, ("dataset",)),
        xs=WEIGHT_ROWS,
    ),
)
def regroup_categories(inputs: Inputs) -> DataFrame:
    return hist.regroup(hist.fill(by_sample(inputs), MET_AXES), st.GROUPS, "dataset", "scaled")


@query(
    "rebin",
    q.sql(
        "SELECT dataset, variable, CAST(bin // 5 AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n, "
        f"sum(sumw) AS sumw, sum(sumw2) AS sumw2 FROM hist WHERE {VISIBLE} GROUP BY ALL",
        fills=MET_FILLS,
        **q.binned(MET_AXES, ("dataset",)),
    ),
)
def rebin(inputs: Inputs) -> DataFrame:
    """50 bins merged to 10."""
    fine = hist.dense(MET.histogram(inputs.events), MET_AXES).drop("lo", "hi")
    return hist.rebin(fine, 5)


@query(
    "stack_overlay",
    q.sql(
        "SELECT dataset, variable, bin, n, CAST(sum(n) OVER (PARTITION BY variable, bin "
        f"ORDER BY dataset) AS BIGINT) AS stacked FROM hist WHERE {VISIBLE}",
        fills=MET_FILLS,
        **q.binned(MET_AXES, ("dataset",)),
    ),
)
def stack_overlay(inputs: Inputs) -> DataFrame:
    """What a stacked plot draws: running totals over the datasets of each bin."""
    shown = hist.visible(MET.histogram(inputs.events), MET_AXES)
    return hist.stacked(shown.select("dataset", "variable", "bin", "n"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "overlay_pivot",
    q.sql(
        "SELECT variable, bin, "
        + ", ".join(
            f"CAST(coalesce(sum(n) FILTER (dataset = '{p}'), 0) AS BIGINT) AS \"{p}\""
            for p in PRIORITIES
        )
        + f" FROM hist WHERE {VISIBLE} GROUP BY 1, 2",
        fills=MET_FILLS,
        **q.binned(MET_AXES, ("dataset",)),
    ),
)
def overlay_pivot(inputs: Inputs) -> DataFrame:
    """One series per dataset, whichever there are."""
    shown = hist.visible(MET.histogram(inputs.events), MET_AXES)
    labels = sorted((r[0] for r in inputs.events.select("dataset").distinct().collect()), key=lambda x: (x is None, x or ""))
    return hist.overlaid(shown, labels)
