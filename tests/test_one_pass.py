"""Histograms, counters and event counts from one pass; categories without entries; users' filesets."""

from __future__ import annotations

import io
from contextlib import redirect_stdout
from itertools import combinations
from random import Random

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 - registers the queries
from conftest import SMALL, hand_event
from partonflow.catalog.registry import Inputs, registered
from partonflow.functions import p4
from partonflow.operators import combine, hist
from partonflow.operators.hist import Axis
from partonflow.plans.analysis import Analysis, run
from partonflow.plans.benchmarks import BENCHMARKS, MissingEnergy, MissingEnergyTwoJets, Trijet
from partonflow.plans.single_top import READS, SecondLeptonPt, SingleTop

AXIS = Axis("x", 4, 0.0, 2.0)


def plan_of(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue().split("\n(1) ")[0]


def same(a, b) -> bool:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    return sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


@pytest.fixture(scope="module")
def samples(spark):
    return Inputs(spark, SMALL).reading(**READS).withColumn("dataset", F.col("sample"))


def test_the_whole_analysis_is_one_scan_and_one_exchange(samples):
    plan = plan_of(SingleTop().tally(samples, full=True))
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1


def test_one_pass_equals_the_single_results(samples):
    top = SingleTop()
    told = top.tally(samples, full=True)
    assert same(hist.filled(told), top.histogram(samples))
    results = top.run(samples)
    assert same(results["cutflow"], top.cutflow(samples))
    assert same(results["scaled"].drop("sumw", "sumw2"), top.scaled(samples).drop("sumw", "sumw2"))
    assert same(results["entries"], samples.groupBy("dataset").agg(F.count(F.lit(1)).alias("entries")))
    empty = results["hist"].groupBy("dataset", "channel").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("bins"))
    n = sum(a.bins for a in top.axes)
    assert {r["bins"] for r in empty.collect()} == {n} and empty.count() == 4 * samples.select("dataset").distinct().count()


@pytest.mark.parametrize("name", sorted(BENCHMARKS))
def test_one_pass_equals_separate_ones(events, name):
    analysis = BENCHMARKS[name]
    results = analysis.run(events)
    assert same(results["hist"], analysis.dense_histogram(events))
    assert same(results["hist"].filter("n > 0").select("dataset", "variable", "bin", "n"),
                hist.visible(analysis.histogram(events), analysis.axes).select("dataset", "variable", "bin", "n"))
    if analysis.counters():
        assert same(results["cutflow"], analysis.cutflow(events))


def test_a_dataset_without_survivor_shows_as_zeros(hand_made):
    jets = [(50.0, 0.0, 0.0, 0.0, 0.5)] * 2
    events = hand_made(hand_event(1, jets=jets, dataset="a"), hand_event(2, dataset="b"), hand_event(3, dataset=None))
    dense = MissingEnergyTwoJets().dense_histogram(events)
    assert {r["dataset"]: (r["bins"], r["n"]) for r in dense.groupBy("dataset").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("n")).collect()} == {
        "a": (50, 1), "b": (50, 0), None: (50, 0)
    }


def test_declared_categories_show_as_zeros(samples):
    dense = SecondLeptonPt().dense_histogram(samples.filter("nMuon = 0 AND nElectron = 0"))
    assert {(r["channel"], r["bins"], r["n"]) for r in dense.groupBy("channel").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("n")).collect()} == {
        ("mumu", 20, 0), ("ee", 20, 0)
    }
    assert SecondLeptonPt().dense_histogram(samples.limit(0)).count() == 0


def test_nan_is_not_filled_and_weights_are_kept(spark):
    rows = [("d", [0.1, float("nan"), None, 9.0], 2.0, 1), ("d", [], 3.0, 2), ("e", None, 1.0, 4), (None, [0.1], 5.0, 8)]
    df = spark.createDataFrame(rows, "dataset string, x array<double>, w double, k int")
    assert {(r["dataset"], r["bin"], r["n"]) for r in hist.fill(df, [AXIS]).collect()} == {("d", 0, 1), ("d", 4, 1), (None, 0, 1)}
    for axes in ([AXIS], [AXIS, Axis("k", 10, 0, 10)]):
        for counters in (None, [F.col("k")]):
            told = hist.tally(df, axes, weight="w", counters=counters)
            assert same(hist.filled(told), hist.fill(df, axes, weight="w"))
    full = hist.tally(df, [AXIS], weight="w", counters=[F.col("k")])
    assert {(r["dataset"], r["entries"]) for r in hist.entries(full).collect()} == {("d", 2), ("e", 1), (None, 1)}
    assert {(r["dataset"], r["step"], r["n"]) for r in hist.counted(full, ["k"], chunk_size=1).collect()} == {
        ("d", "k", 3), ("e", "k", 4), (None, "k", 8), ("d", "number of chunks", 2), ("e", "number of chunks", 1), (None, "number of chunks", 1)
    }


class Rescaled(MissingEnergy):
    def postprocess(self, h):
        return h.withColumn("n", F.col("n") * 2)


def test_postprocess_meets_filled_bins_only(events):
    rows = Rescaled().dense_histogram(events)
    plain = MissingEnergy().dense_histogram(events)
    assert rows.agg(F.sum("n")).first()[0] == 2 * plain.agg(F.sum("n")).first()[0]
    assert rows.count() == plain.count()


class OwnProcess(Analysis):
    """An analysis that only builds its own frame."""

    axes = (Axis("MET", 10, 0, 100),)

    def prepare(self, events):
        return events.select("dataset", F.col("MET.pt").alias("MET"))


def test_values_default_to_columns_of_the_prepared_events(events):
    assert OwnProcess().run(events)["hist"].count() == 10 * events.select("dataset").distinct().count()


def test_fileset_run_with_awkward_labels_and_without_stored_counts(spark, samples, tmp_path):
    """Files under labels that folder names cannot hold as they are; no sample column, no counts, no event number."""
    labels = ["tHq", "a/b", "x:y", "p=q", "50%", "two words", "%41"]
    marked = samples.withColumn("label", F.when(F.col("event_id") % 8 < 7, F.get(F.array(*map(F.lit, labels)), (F.col("event_id") % 8).cast("int"))))
    marked.select("label", "MET", "Jet", "Muon", "Electron").write.partitionBy("label").parquet(f"{tmp_path}/t/Events")
    from partonflow.sources.fileset import files_by

    fileset = files_by(spark.read.parquet(f"{tmp_path}/t/Events"), "label")
    assert set(fileset) == {*labels, None}
    out = run(spark, {str(k): v for k, v in fileset.items()}, None, SingleTop())
    direct = SingleTop().run(marked.withColumn("dataset", F.coalesce("label", F.lit("None"))))
    for part in ("cutflow", "hist", "entries"):
        assert same(out[part], direct[part])
    tree = run(spark, {"all": [f"{tmp_path}/t"]}, "Events", BENCHMARKS["adl1_met"])
    assert tree["entries"].first()["entries"] == samples.count()


@pytest.mark.parametrize("label", ["a/b", "x:y", "p=q", "50%", "two words", None])
def test_event_tables_with_awkward_labels_are_found(spark, tmp_path, label):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").limit(40)
    changed = F.when(F.col("o_orderkey") % 2 == 0, F.lit(label).cast("string")).otherwise(F.col("o_orderpriority"))
    orders.withColumn("o_orderpriority", changed).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").limit(100).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("scan_fileset", "union_datasets", "met_multi_dataset"):
        assert registered()[name](spark, str(tmp_path)).count() > 0
    assert registered()["scan_fileset"](spark, str(tmp_path)).agg(F.sum("entries")).first()[0] == orders.count()
    assert registered()["overlay_pivot"](spark, str(tmp_path)).columns[-1] == "(none)" or label is not None


def test_closest_triples_of_many_jets(spark):
    """All ties for the smallest distance on 100 jets, against brute force."""
    rng = Random(4)
    jets = [(float(rng.randint(31, 34)), rng.choice([0.0, 0.5]), rng.choice([0.0, 1.0, 2.0]), 1.0, rng.random()) for _ in range(100)]
    df = spark.createDataFrame([(jets,)], "Jet array<struct<pt:double,eta:double,phi:double,mass:double,btag:double>>")
    vectors = p4.with_cartesian(F.col("Jet"), "btag")
    rows = df.select(vectors.alias("v")).first()["v"]

    def mass(*vs):
        e, x, y, z = (sum(v[c] for v in vs) for c in ("e", "px", "py", "pz"))
        return round(max(0.0, e * e - x * x - y * y - z * z) ** 0.5, 6)

    distances = {t: round(abs(172.5 - mass(*(rows[i] for i in t))), 5) for t in combinations(range(100), 3)}
    low = min(distances.values())
    expected = [t for t, d in distances.items() if d == low]
    out = combine.closest_triples(
        vectors, lambda a, b, c: p4.stable(F.abs(F.lit(172.5) - p4.stable(p4.mass(a, b, c))), 5),
        lambda a, b, c: F.array(a["btag"], b["btag"], c["btag"]),
    )
    got = df.select(out.alias("t")).first()["t"]
    assert got == [[jets[i][4] for i in t] for t in expected] and len(got) > 1
    few = df.select(F.slice("Jet", 1, 2).alias("Jet")).select(combine.closest_triples(F.col("Jet"), lambda a, b, c: a["pt"]).alias("t"))
    assert few.first()["t"] == []
    assert Trijet().axes[0].name == "Jet_pt"
