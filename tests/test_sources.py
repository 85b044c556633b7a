"""Event assembly, filesets, flat branches and scratch space."""

from __future__ import annotations

import re
import shutil

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from conftest import SMALL
from partonflow.sources import branches, detector, fileset, scratch


def tables(spark):
    return (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("orders", "lineitem"))


def test_every_line_contributes(spark, events):
    _, lineitem = tables(spark)
    cents = lineitem.agg(F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5))).first()[0]
    lists = F.concat(F.col("Jet.pt"), F.col("Muon.pt"), F.col("Electron.pt"))
    total = events.select(F.explode(lists).alias("pt")).agg(
        F.sum(F.rint(F.col("pt") * 100000).cast("long"))
    )
    assert total.first()[0] == cents


def test_hot_order_stays_bounded(spark, events):
    """One order holding a third of all lines, copies included, gives bounded lists."""
    orders, lineitem = tables(spark)
    n = lineitem.count()
    hot = lineitem.withColumn("l_orderkey", F.lit(1)).limit(n // 4)
    copies = lineitem.orderBy("l_orderkey", "l_partkey").limit(1).withColumn("l_orderkey", F.lit(1))
    many = copies.crossJoin(spark.range(n // 4)).drop("id")
    skewed = lineitem.unionByName(hot).unionByName(many)
    built = detector.assemble(orders, skewed)
    one = built.filter("event_id = 1").first()
    assert max(one["nJet"], one["nMuon"], one["nElectron"]) <= 2 * detector.TOWERS
    in_hot = skewed.filter("l_orderkey = 1").agg(
        F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5))
    )
    total = sum(p["pt"] for c in detector.KINDS for p in one[c])
    assert total == pytest.approx(in_hot.first()[0] / 100000.0)
    others = built.filter("event_id <> 1").select("event_id", "nJet", "nMuon", "nElectron")
    before = events.filter("event_id <> 1").select("event_id", "nJet", "nMuon", "nElectron")
    assert others.exceptAll(before).isEmpty()


def test_lines_are_dealt_once(spark, monkeypatch):
    """Lines, and the counts of their buckets, are all that is dealt, and orders; a crowded order is combined first."""
    orders, lineitem = tables(spark)

    def dealt(df):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    plain = detector.assemble(orders, lineitem)
    assert dealt(plain) == 2
    monkeypatch.setattr(detector, "CROWD", 20)
    hot = lineitem.unionByName(lineitem.withColumn("l_orderkey", F.lit(1)))
    assert len(detector._crowded(hot)[1]) >= 1
    combined = detector.assemble(orders, hot)
    assert dealt(combined) == 3
    monkeypatch.undo()
    key = ["event_id", "Jet", "Muon", "Electron"]
    plain = detector.assemble(orders, hot)
    assert combined.select(key).exceptAll(plain.select(key)).isEmpty()
    assert detector.assemble(orders, lineitem.limit(0)).filter("nJet > 0").isEmpty()


def test_branches_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    for name, table in zip(("orders", "lineitem"), tables(spark), strict=True):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    plans, by = [], DataFrameWriter.partitionBy

    def spied(self, *columns):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return by(self, *columns)

    monkeypatch.setattr(DataFrameWriter, "partitionBy", spied)
    assert detector.read_branches(spark, str(tmp_path)).count() == 1500
    # Events are dealt by order, and never by dataset.
    assert len(plans) == 2 and "dataset" not in "".join(re.findall("Exchange [a-z]*\\([^)]*", plans[0])) and "Exchange" not in plans[1]


def test_assembly_does_not_depend_on_line_order(spark):
    orders, lineitem = tables(spark)
    a = detector.assemble(orders, lineitem)
    b = detector.assemble(orders, lineitem.orderBy(F.rand(7)).repartition(13))
    key = ["event_id", "Jet", "Muon", "Electron"]
    assert a.select(key).exceptAll(b.select(key)).isEmpty()


def test_lists_are_sorted_and_never_null(events):
    for c in detector.KINDS:
        pts = F.col(f"{c}.pt")
        bad = events.filter(
            F.col(c).isNull() | (F.size(c) != F.col(f"n{c}")) | (pts != F.sort_array(pts, False))
        )
        assert bad.isEmpty()
    assert not events.filter("nJet = 0 AND nMuon = 0 AND nElectron = 0").isEmpty()


def test_changed_tables_are_assembled_again(spark, tmp_path):
    orders, lineitem = tables(spark)
    orders.limit(5).write.parquet(f"{tmp_path}/orders.parquet")
    lineitem.limit(50).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert detector.read_events(spark, str(tmp_path)).count() == 5
    orders.limit(9).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert detector.read_events(spark, str(tmp_path)).count() == 9


def test_removed_event_table_is_written_again(spark, tmp_path):
    orders, lineitem = tables(spark)
    orders.limit(4).write.parquet(f"{tmp_path}/orders.parquet")
    lineitem.limit(40).write.parquet(f"{tmp_path}/lineitem.parquet")
    detector.read_events(spark, str(tmp_path))
    location = detector.event_location(spark, str(tmp_path))
    shutil.rmtree(location.removeprefix("file:"))
    assert detector.read_events(spark, str(tmp_path)).count() == 4


def test_fingerprint_without_local_files_lists_with_spark(spark):
    remote = f"file://{SMALL}/orders.parquet"
    assert len(detector._fingerprint(spark, [remote])) == 16


def test_fileset_union_and_pruning(spark, tmp_path):
    for name in ("a", "b", "c"):
        spark.range(3).select("id", F.lit(name).alias("x")).write.parquet(f"{tmp_path}/{name}/Events")
    sets = {"one": [f"{tmp_path}/a", f"{tmp_path}/b"], "two": [f"{tmp_path}/c"]}
    df = fileset.read_fileset(spark, sets, "Events")
    assert {r["dataset"]: r["entries"] for r in fileset.count_entries(df).collect()} == {
        "one": 6,
        "two": 3,
    }
    only = df.filter(F.col("dataset") == "two")
    assert {f.split("/")[-3] for f in only.inputFiles()} >= {"c"}
    assert only.count() == 3


def test_chunks_round_up(spark):
    df = spark.range(7).withColumn("dataset", F.lit("d"))
    assert fileset.count_chunks(df, 3).first()["chunks"] == 3
    stop = fileset.first_events(df, 2, "id").collect()
    assert [r["id"] for r in stop] == [0, 1]
    assert fileset.first_chunks(df, 2, 3, "id").count() == 6


FLAT = (
    "event_id long, numbermuon int, muon_pt array<double>, muon_e array<double>, muon_ch array<int>, "
    "numbertau int, tau_pt array<double>, tau_iso_raw array<double>, met_pt double, met_phi double, "
    "numGenPart int, GenPart_pt array<double>, nPV_x int, PV_x array<double>, PV_npvs int, "
    "PV_npvsGood int, nmuon_e int"
)
ROW = (
    1, 2, [9.0, 8.0], [10.0, 9.0], [1, -1], 1, [5.0], [0.5], 40.0, 1.0, 1, [3.0], 1, [0.1], 4, 3, 2
)


def test_schema_rules(spark):
    flat = spark.createDataFrame([ROW], FLAT)
    zipped = branches.zip_collections(flat, ("event_id",))
    assert set(zipped.columns) == {"event_id", "muon", "tau", "GenPart", "PV", "met"}
    row = zipped.first().asDict(recursive=True)
    assert row["muon"] == [
        {"pt": 9.0, "energy": 10.0, "ch": 1},
        {"pt": 8.0, "energy": 9.0, "ch": -1},
    ]
    assert row["tau"] == [{"pt": 5.0, "iso_raw": 0.5}]
    assert row["met"] == {"pt": 40.0, "phi": 1.0}
    assert row["PV"] == [{"x": 0.1}]
    assert row["GenPart"] == [{"pt": 3.0}]
    assert branches.count_mismatches(flat).isEmpty()


def test_count_mismatch_is_found(spark):
    wrong = (*ROW[:2], [9.0], *ROW[3:])
    flat = spark.createDataFrame([ROW, wrong], FLAT)
    assert branches.count_mismatches(flat).count() == 1


def test_cluster_without_shared_folder_is_an_error():
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Conf:
        @staticmethod
        def get(_key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session)
