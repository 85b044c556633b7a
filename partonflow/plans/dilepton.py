"""Analyses of lepton pairs and of the scalar sum of jet pt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partonflow.functions import lists, p4
from partonflow.operators.hist import Axis
from partonflow.plans.analysis import Analysis


def neutral_pair_mass(leptons: Column, charge: str, stored_energy: bool = False) -> Column:
    """Mass of the pair if the list holds exactly two leptons of opposite charge, else NULL."""

    def pair(xs: Column) -> Column:
        vectors = p4.with_cartesian(xs, stored_energy=stored_energy)
        mass = lists.let(vectors, lambda v: p4.stable(p4.mass(F.get(v, F.lit(0)), F.get(v, F.lit(1)))))
        neutral = lists.total_int(F.transform(xs, lambda x: x[charge])) == 0
        return F.when((F.size(xs) == 2) & neutral, mass)

    return lists.let(leptons, pair)


class ZPeak(Analysis):
    """Pair mass of events with exactly two muons of opposite charge."""

    axes = (Axis("dimu_mass", 50, 20, 120),)
    reads = {"Muon": ("pt", "eta", "phi", "mass", "charge")}

    def candidates(self) -> Column:
        return F.col("nMuon") == 2

    def values(self) -> dict[str, Column]:
        return {"dimu_mass": F.when(self.candidates(), neutral_pair_mass(F.col("Muon"), "charge"))}


class SameFlavourMass(Analysis):
    """Pair mass of two opposite-charge leptons above 10, muons and electrons apart.

    Works on collections zipped from flat branches, which store the energy.
    """

    axes = (Axis("dilep_mass", 50, 0, 150),)
    by = ("lepton",)
    reads = {c: ("pt", "eta", "phi", "energy", "ch") for c in ("muon", "electron")}

    def prepare(self, events: DataFrame) -> DataFrame:
        """Two rows per event, one of each kind."""

        def mass(collection: str) -> Column:
            hard = lists.keep(F.col(collection), lambda x: x["pt"] > 10)
            return F.when(
                F.size(collection) >= 2, neutral_pair_mass(hard, "ch", stored_energy=True)
            )

        both = events.select(
            F.explode(
                F.array(
                    F.struct(F.lit("ee").alias("lepton"), mass("electron").alias("dilep_mass")),
                    F.struct(F.lit("mumu").alias("lepton"), mass("muon").alias("dilep_mass")),
                )
            ).alias("fill")
        )
        return both.select("fill.*")


class JetHt(Analysis):
    """Weighted histogram of the scalar sum of jet pt above 25; 0 without such jets."""

    axes = (Axis("ht", 50, 0, 1000),)
    weight = "weight"

    def prepare(self, events: DataFrame) -> DataFrame:
        return events.withColumn("weight", F.lit(1.0))

    def values(self) -> dict[str, Column]:
        hard = lists.keep(F.col("Jet.pt"), lambda pt: pt > 25)
        return {"ht": p4.stable(lists.total(hard))}
