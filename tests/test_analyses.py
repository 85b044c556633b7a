"""Edge events made by hand, in-row against exploded form, streaming, user code."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import hand_event
from partonflow.functions import p4
from partonflow.operators import combine
from partonflow.operators.records import narrow
from partonflow.plans.benchmarks import BENCHMARKS, IsolatedJetHt
from partonflow.plans.dilepton import JetHt, ZPeak

MU, EL = 0.1056, 0.000511


def filled(analysis, events):
    """Values that reach the histogram, per event row order lost."""
    df = analysis.process(events)
    out = []
    for row in df.collect():
        for axis in analysis.axes:
            v = row[axis.name]
            out += [(axis.name, x) for x in (v if isinstance(v, list) else [v]) if x is not None]
    return sorted(out)


def muon(pt, eta, phi, charge):
    return (float(pt), float(eta), float(phi), MU, charge)


def electron(pt, eta, phi, charge):
    return (float(pt), float(eta), float(phi), EL, charge)


def jet(pt, eta=0.0, phi=0.0, mass=0.0, btag=0.5):
    return (float(pt), float(eta), float(phi), float(mass), float(btag))


def test_dimuon_window_is_half_open_and_needs_opposite_charge(hand_made):
    inside = [muon(45, 0, 0, 1), muon(45, 0, math.pi, -1)]
    events = hand_made(
        hand_event(1, (10.0, 0.0), muons=inside),
        hand_event(2, (20.0, 0.0), muons=[muon(45, 0, 0, 1), muon(45, 0, math.pi, 1)]),
        hand_event(3, (30.0, 0.0), muons=[muon(70, 0, 0, 1), muon(70, 0, math.pi, -1)]),
        hand_event(4, (40.0, 0.0), muons=[muon(45, 0, 0, 1)]),
        hand_event(5, (50.0, 0.0)),
    )
    assert filled(BENCHMARKS["adl5_met_dimuon"], events) == [("MET", 10.0)]


def test_two_jets_above_40_is_strict(hand_made):
    events = hand_made(
        hand_event(1, (10.0, 0.0), jets=[jet(40), jet(41)]),
        hand_event(2, (20.0, 0.0), jets=[jet(41), jet(41), jet(1)]),
    )
    assert filled(BENCHMARKS["adl4_met_2jets"], events) == [("MET_pt", 20.0)]


def test_tied_triples_are_all_filled(hand_made):
    jets = [jet(60, 0, 0, btag=0.1), jet(60, 0, 2, btag=0.2), jet(60, 0, 4, btag=0.3), jet(60, 0, 4, btag=0.9)]
    values = filled(BENCHMARKS["adl6_trijet"], hand_made(hand_event(1, jets=jets)))
    tags = [v for name, v in values if name == "b_tag"]
    assert tags == [0.3, 0.9]
    few = hand_made(hand_event(1, jets=jets[:2]), hand_event(2, jets=[jet(29), jet(50), jet(50)]))
    assert filled(BENCHMARKS["adl6_trijet"], few) == []


def test_isolation_and_empty_events(hand_made):
    events = hand_made(
        hand_event(1, jets=[jet(50, 0, 0), jet(40, 0, 2)], muons=[muon(20, 0, 0.3, 1)]),
        hand_event(2, jets=[jet(50, 0, 3.1)], electrons=[electron(20, 0, -3.1, 1)]),
        hand_event(3, jets=[jet(35, 0, 0)], muons=[muon(9, 0, 0, 1)]),
        hand_event(4),
    )
    assert filled(IsolatedJetHt(), events) == [
        ("Jet_pt", 0.0), ("Jet_pt", 0.0), ("Jet_pt", 35.0), ("Jet_pt", 40.0)
    ]
    strict = filled(IsolatedJetHt(require_lepton=True), events)
    assert strict == [("Jet_pt", 0.0)] * 4


def test_third_lepton(hand_made):
    z = [muon(45, 0, 0, 1), muon(45, 0, math.pi, -1)]
    events = hand_made(
        hand_event(1, (20.0, 0.0), muons=z, electrons=[electron(45, 0, math.pi, 1), electron(11, 0, 0, 1)]),
        hand_event(2, muons=z),
        hand_event(3, muons=[muon(45, 0, 0, 1), muon(45, 0, 1, 1)], electrons=[electron(45, 0, 2, -1)]),
        hand_event(4, (20.0, 0.0), muons=z, electrons=[electron(9, 0, 0, 1)]),
    )
    values = filled(BENCHMARKS["adl8_mt_third_lepton"], events)
    assert values == [("massT", pytest.approx(60.0, abs=1e-5))]
    steps = {r["step"]: r["n"] for r in BENCHMARKS["adl8_mt_third_lepton"].cutflow(events).collect()}
    assert steps == {
        "all events": 4, "all muons": 8, "all electrons": 3, "trileptons": 7,
        "number of final leading leptons": 2,
    }


def test_zpeak_needs_exactly_two_opposite(hand_made):
    pair = [muon(45, 0, 0, 1), muon(45, 0, math.pi, -1)]
    events = hand_made(
        hand_event(1, muons=pair),
        hand_event(2, muons=[*pair, muon(5, 0, 1, 1)]),
        hand_event(3, muons=[pair[0], muon(45, 0, math.pi, 1)]),
    )
    assert filled(ZPeak(), events) == [("dimu_mass", pytest.approx(90, abs=0.01))]


def test_event_without_jets_fills_zero(hand_made):
    events = hand_made(hand_event(1), hand_event(2, jets=[jet(30), jet(26), jet(25)]))
    assert filled(JetHt(), events) == [("ht", 0.0), ("ht", 56.0)]


def test_in_row_pairs_equal_exploded_pairs(events):
    """List form against a self-join on exploded muons."""
    fields = ("pt", "eta", "phi", "mass", "charge")
    vectors = p4.with_cartesian(narrow("Muon", *fields), "charge")
    masses = combine.pairs(
        vectors, lambda a, b: F.when(a["charge"] != b["charge"], p4.stable(p4.mass(a, b)))
    )
    in_row = events.select("event_id", F.explode(masses).alias("m")).filter("m IS NOT NULL")
    flat = events.select("event_id", F.posexplode(narrow("Muon", *fields)).alias("i", "x"))
    flat = flat.select("event_id", "i", p4.cartesian(F.col("x")).alias("v"), "x.charge")
    a, b = flat.alias("a"), flat.alias("b")
    joined = a.join(
        b,
        (F.col("a.event_id") == F.col("b.event_id"))
        & (F.col("a.i") < F.col("b.i"))
        & (F.col("a.charge") != F.col("b.charge")),
    ).select("a.event_id", p4.stable(p4.mass(F.col("a.v"), F.col("b.v"))).alias("m"))
    assert in_row.exceptAll(joined).isEmpty() and joined.exceptAll(in_row).isEmpty()
    assert in_row.count() > 0


def test_stream_ends_at_the_batch_histogram(spark, inputs, tmp_path):
    from partonflow.streaming.running import event_stream, final_histogram

    analysis = BENCHMARKS["adl2_jet_pt"]
    path = f"{inputs.location}/Events"
    stream = event_stream(spark, path, inputs.events.schema, files_per_batch=7)
    total = final_histogram(spark, stream, analysis, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(total.collect()) == sorted(analysis.histogram(inputs.events).collect())


def test_stream_resumes_with_new_files(spark, inputs, tmp_path):
    from partonflow.streaming.running import event_stream, final_histogram

    analysis, events = BENCHMARKS["adl1_met"], inputs.events
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    seen = 0
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        stream = event_stream(spark, source, events.schema)
        total = final_histogram(spark, stream, analysis, out, state).agg(F.sum("n")).first()[0]
        assert total > seen
        seen = total
    assert seen == events.count()


def test_totals_of_a_stream_are_bounded_and_survive_a_kill(spark, inputs, tmp_path, monkeypatch):
    from partonflow.streaming import running

    analysis, events = BENCHMARKS["adl1_met"], inputs.events
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    events.repartition(6).write.parquet(source)
    real = running.forget_totals

    def killed(session, folder, first):
        if first >= 3:
            raise RuntimeError("killed between writing a total and removing the old ones")
        real(session, folder, first)

    monkeypatch.setattr(running, "forget_totals", killed)
    with pytest.raises(Exception, match="killed"):
        running.final_histogram(spark, running.event_stream(spark, source, events.schema, 1), analysis, out, state)
    monkeypatch.setattr(running, "forget_totals", real)
    assert running.last_total(spark, out).count() > 0
    total = running.final_histogram(spark, running.event_stream(spark, source, events.schema, 1), analysis, out, state)
    assert sorted(total.collect()) == sorted(analysis.histogram(events).collect())
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2
    with pytest.raises(ValueError, match="keep"):
        running.start_running_histogram(events, analysis, out, state, keep=1)


def test_run_gives_histogram_and_counters(events):
    results = BENCHMARKS["adl3_jet_pt_eta"].run(events)
    assert set(results) == {"hist", "cutflow", "entries"}
    assert set(BENCHMARKS["adl6_trijet"].run(events)) == {"hist", "entries"}
