"""Every registered query against its SQL, and what every plan must look like."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference, spark_rows
from conftest import SMALL
from partonflow.catalog.registry import Inputs, reference_sql, registered
from partonflow.plans.benchmarks import BENCHMARKS
from partonflow.plans.dilepton import ZPeak

QUERIES = entry_points.queries()
SQL = reference_sql()
PYTHON_BY_DESIGN = {"accumulator_udaf", "accumulator_state", "compiled_udf", "compiled_udf_lists"}
ROWS_ONLY = {"run_metrics", "throughput_metrics"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def plan_of(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_all_but_the_metrics_have_sql():
    assert set(registered()) - set(SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(reference_sql()))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    assert difference(df, con, SQL[name]) is None
    plan = plan_of(df)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_BY_DESIGN:
        assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_metrics(spark, name):
    rows = {r["metric"]: r["value"] for r in QUERIES[name](spark, SMALL).collect()}
    if name == "run_metrics":
        assert rows["entries"] == "1500"
        assert int(rows["chunks"]) >= 1
        assert int(rows["bytes"]) > 0
        assert "Jet:array<struct<pt:double>>" in rows["columns"]
        assert "Muon" not in rows["columns"]
    else:
        assert rows["events_per_second"] > 0 and rows["events_per_second_per_thread"] > 0


def test_entry(spark):
    _, rows = spark_rows(entry_points.entry(spark))
    assert rows


READS = {
    "adl1_met": "struct<MET:struct<pt:double>>",
    "adl2_jet_pt": "struct<Jet:array<struct<pt:double>>>",
    "adl4_met_2jets": "struct<MET:struct<pt:double>,nJet:int,Jet:array<struct<pt:double>>>",
    "ttbar_ht": "struct<Jet:array<struct<pt:double>>>",
    "zpeak": "struct<nMuon:int,Muon:array<struct<pt:double,eta:double,phi:double,mass:double,charge:int>>>",
    "scan_columns": "struct<event_id:bigint,Muon:array<struct<pt:double>>>",
    "scan_select_query": "struct<event_id:bigint,jet_pt:array<double>>",
    "rename_energy": "struct<event_id:bigint,electron_e:array<double>>",
    "singleton_record": "struct<event_id:bigint,met_pt:double,met_phi:double>",
    "compiled_udf": "struct<event_id:bigint,MET:struct<pt:double,phi:double>,Muon:array<struct<pt:double,phi:double>>>",
}


@pytest.mark.parametrize("name", sorted(READS))
def test_scan_reads_only_what_is_used(spark, name):
    assert f"ReadSchema: {READS[name]}\n" in plan_of(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize(
    ("name", "pushed"),
    [
        ("thq_observables", "GreaterThanOrEqual(nJet,2)"),
        ("slice_event_elem", "EqualTo(event_id,1)"),
    ],
)
def test_counts_are_pushed_to_the_scan(spark, name, pushed):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert pushed in plan


@pytest.mark.parametrize(
    ("analysis", "pushed"),
    [
        (BENCHMARKS["adl4_met_2jets"], "GreaterThanOrEqual(nJet,2)"),
        (BENCHMARKS["adl5_met_dimuon"], "GreaterThanOrEqual(nMuon,2)"),
        (BENCHMARKS["adl6_trijet"], "GreaterThanOrEqual(nJet,3)"),
        (ZPeak(), "EqualTo(nMuon,2)"),
    ],
)
def test_counts_are_pushed_where_only_filled_bins_are_wanted(spark, analysis, pushed):
    """A dense histogram needs every event, to know which categories there are."""
    assert pushed in plan_of(analysis.histogram(Inputs(spark, SMALL).events_for(analysis)))


READ_BY = {
    "hist_multi_axis": {"Jet": {"pt", "eta", "btag"}},
    "thq_objects": {"Muon", "Electron"},
    "thq_loose_mass_veto": {"Muon", "Electron"},
    "thq_dilepton": {"Muon", "Electron"},
    "thq_trilepton": {"Muon", "Electron"},
    "thq_jet_masks": {"Jet"},
}


@pytest.mark.parametrize("name", sorted(READ_BY))
def test_collections_that_are_not_used_are_not_read(spark, name):
    schema = plan_of(QUERIES[name](spark, SMALL)).split("ReadSchema: ")[1].split("\n")[0]
    assert {c for c in ("Jet", "Muon", "Electron") if f"{c}:array" in schema} == set(READ_BY[name])
    if name == "hist_multi_axis":
        assert "Jet:array<struct<pt:double,eta:double,btag:double>>" in schema


def test_flat_branches_are_read_one_by_one(spark):
    schema = plan_of(QUERIES["agc_dilepton"](spark, SMALL)).split("ReadSchema: ")[1].split("\n")[0]
    read = {part.split(":")[0] for part in schema.removeprefix("struct<").split(",")}
    assert read == {f"{c}_{f}" for c in ("muon", "electron") for f in ("pt", "eta", "phi", "e", "ch")}


@pytest.mark.parametrize("name", ["with_field", "counts_check", "adl4_met_2jets", "adl5_met_dimuon", "adl1_met_cutflow", "thq_cutflow", "thq_scaled", "scale_by_weight", "hist_dense"])
def test_one_scan_also_with_counters_and_empty_categories(spark, name):
    assert plan_of(QUERIES[name](spark, SMALL)).split("\n(1) ")[0].count("Scan parquet") == 1


@pytest.mark.parametrize("name", ["hist_1d", "hist_weighted", "dict_of_results", "thq_observables"])
def test_histograms_need_one_scan_and_one_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL)).split("\n(1) ")[0]
    assert plan.count("Scan parquet") == 1
    assert plan.count("Exchange") == 1


def test_dataset_filter_prunes_directories(inputs):
    plan = plan_of(inputs.events.filter("dataset = '2-HIGH'").select("event_id"))
    assert "PartitionFilters: [isnotnull(dataset" in plan
