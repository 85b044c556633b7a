from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from partonflow.session import configure  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    session = configure(builder, 8).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from partonflow.catalog.registry import Inputs

    return Inputs(spark, SMALL)


@pytest.fixture(scope="session")
def events(inputs):
    return inputs.events


def hand_event(event_id, met=(50.0, 0.0), jets=(), muons=(), electrons=(), dataset="d", sample="tHq"):
    """One hand-made event; particles as (pt, eta, phi, mass, btag or charge)."""
    jets, muons, electrons = list(jets), list(muons), list(electrons)
    return (
        event_id, dataset, sample, met, len(jets), len(muons), len(electrons), jets, muons, electrons,
    )


@pytest.fixture(scope="session")
def hand_made(spark):
    """Builder of DataFrames of hand-made events."""

    def build(*rows):
        schema = (
            "event_id long, dataset string, sample string, MET struct<pt:double, phi:double>, "
            "nJet int, nMuon int, nElectron int, "
            "Jet array<struct<pt:double, eta:double, phi:double, mass:double, btag:double>>, "
            "Muon array<struct<pt:double, eta:double, phi:double, mass:double, charge:int>>, "
            "Electron array<struct<pt:double, eta:double, phi:double, mass:double, charge:int>>"
        )
        return spark.createDataFrame(list(rows), schema)

    return build
