"""Event table derived from the order tables.

An event is one row of ``orders``.  Its objects come from ``lineitem``: each
line is a deposit in one of 48 cells (6 kinds x 8 towers) of its order, and the
deposits of one cell make one object of the Jet, Muon or Electron collection.
Lines are dealt by order once, and both groupings and the join with ``orders``
use that partitioning.  Deposits are combined by integer sums and counts; lines of
orders that may hold a large share of all lines are combined before they are dealt, so
such an order reaches its task as at most 48 rows, and a list never holds more than 16 objects.
Every field of every line enters a sum, so direction, b-tag and identification of an
object depend on all its lines, and not on their order; quantities with a range are
the sum modulo that range.

The table is written once per application into the shared scratch folder, as
nested Parquet in one directory per dataset, and the queries scan that.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from pathlib import Path
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from partonflow.sources.branches import BRANCH_FIELDS, flatten_branches
from partonflow.sources.fileset import Reads, read_paths
from partonflow.sources.scratch import scratch_root

KINDS = {"Jet": 0, "Muon": 1, "Electron": 2}
TOWERS = 8
#: Numbers of different discounts and taxes, in whole hundredths from 0.
DISCOUNTS, TAXES = 11, 9
#: Lines are counted in so many buckets of orders; those of a bucket with more than CROWD
#: lines, and SHARE times as many as a bucket holds on average, are combined before they are dealt.
BUCKETS, CROWD, SHARE = 1 << 14, 20_000, 4
#: Lines of one task, at most where there are many and at least where there are few.
MOST, LEAST = 600_000, 20_000
#: Changes with the way events are made, so that tables of an older way are not taken up.
LAYOUT = 2

# Names of the simulated samples of the single-top analysis.
SAMPLES = (
    "tHq", "tHW", "ttW", "ttWJets", "ttZ", "ttZJets", "ttH", "WZ", "ZZ",
    "ZZZ", "WWZ", "WZZ", "tttt", "WpWp", "WGToLNuG", "TGJets", "TTGJets",
)

_written: dict[tuple[str, str], str] = {}
_schemas: dict[str, StructType] = {}
_writing = Lock()


def _lines(lineitem: DataFrame) -> DataFrame:
    """Deposits, prices and rates as whole hundredths."""

    def hundredths(column: str) -> Column:
        return F.floor(F.col(column) * 100 + 0.5)

    return lineitem.select(
        F.col("l_orderkey").alias("event_id"),
        (F.col("l_partkey") % 6).cast("int").alias("kind"),
        (F.expr("l_partkey div 6") % TOWERS).cast("int").alias("tower"),
        hundredths("l_extendedprice").alias("cents"),
        F.col("l_quantity").cast("long").alias("qty"),
        hundredths("l_discount").alias("disc"),
        hundredths("l_tax").alias("tax"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).cast("long").alias("sign"),
    )


SUMS = ("cents", "qty", "disc", "tax", "part", "supp", "line", "sign")


def _combined(deposits: DataFrame) -> DataFrame:
    return deposits.groupBy("event_id", "kind", "tower").agg(*[F.sum(c).alias(c) for c in SUMS])


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _crowded(lineitem: DataFrame) -> tuple[int, list[int]]:
    """Number of lines, and the buckets of orders that may hold an order with a large share of them."""
    counts = lineitem.groupBy(_bucket(F.col("l_orderkey")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    lines = F.sum("n").over(Window.partitionBy())
    large = F.collect_list(F.when((F.col("n") > CROWD) & (F.col("n") > SHARE * F.col("lines") / BUCKETS), F.col("bucket")))
    found = counts.withColumn("lines", lines).agg(F.max("lines"), large).first()
    return found[0] or 0, found[1]


def cells(lineitem: DataFrame) -> DataFrame:
    """Deposits combined per (event, kind, tower), in partitions by event."""
    lines, crowded = _crowded(lineitem)
    tasks = min(lineitem.sparkSession.sparkContext.defaultParallelism, -(-lines // LEAST))
    deposits = _lines(lineitem)
    if crowded:
        among = _bucket(F.col("event_id")).isin(crowded)
        deposits = deposits.filter(~among).unionByName(_combined(deposits.filter(among)))
    dealt = deposits.repartition(max(1, tasks, -(-lines // MOST)), "event_id")
    return _combined(dealt).withColumns(
        {"disc": F.col("disc") % DISCOUNTS, "tax": F.col("tax") % TAXES, "positive": F.col("sign") >= 0}
    )


def _kinematics() -> dict[str, Column]:
    part, supp = F.col("part"), F.col("supp")
    return {
        "pt": F.col("cents") / 100000.0,
        "eta": ((part * 37 + supp * 11) % 5000) / 1000.0 - 2.5,
        "phi": ((part * 13 + supp * 101) % 6283) / 1000.0 - 3.1415,
    }


def _lepton_common() -> dict[str, Column]:
    part, supp = F.col("part"), F.col("supp")
    sign = F.when(F.col("line") % 2 == 1, -1.0).otherwise(1.0)
    return {
        "charge": F.when(F.col("positive"), 1).otherwise(-1),
        "dxy": sign * ((supp * 7) % 100) / 1800.0,
        "dz": sign * ((part * 3) % 100) / 900.0,
        "miniPFRelIso_all": F.col("tax") * 0.055,
        "tightCharge": F.when(supp % 8 == 0, 0).when(supp % 8 == 1, 1).otherwise(2),
        "mvaTTH": 1.0 - F.col("disc") / 100.0,
    }


def jet_fields() -> dict[str, Column]:
    return {
        **_kinematics(),
        "mass": F.col("qty") / 10.0,
        "btag": F.col("disc") / 10.0,
        "btagCSVV2": F.col("disc") / 10.0,
    }


def muon_fields() -> dict[str, Column]:
    part, supp = F.col("part"), F.col("supp")
    return {
        **_kinematics(),
        "mass": F.lit(0.1056),
        **_lepton_common(),
        "sip3d": ((part * 17) % 100) / 11.0,
        "looseId": supp % 10 != 0,
        "mediumId": part % 7 != 0,
        "jetIdx": (part % 4 - 1).cast("int"),
    }


def electron_fields() -> dict[str, Column]:
    part, supp = F.col("part"), F.col("supp")
    return {
        **_kinematics(),
        "mass": F.lit(0.000511),
        **_lepton_common(),
        "mvaFall17V2noIso": 0.4 + F.col("qty") / 80.0,
        "lostHits": F.when(supp % 12 < 10, 0).when(supp % 12 == 10, 1).otherwise(2),
        "convVeto": part % 9 != 0,
        "sieie": ((part * 29) % 120) / 10000.0,
        "hoe": ((supp * 31) % 110) / 1500.0,
        "eInvMinusPInv": ((part * 41) % 70) / 1200.0 - 0.052,
    }


FIELDS = {"Jet": jet_fields, "Muon": muon_fields, "Electron": electron_fields}


def _collection(name: str) -> Column:
    """Objects of one collection, hardest first, as a list without the sort key."""
    member = F.floor(F.col("kind") / 2) == KINDS[name]
    fields = [c.alias(f) for f, c in FIELDS[name]().items()]
    ranked = F.when(
        member, F.struct((-F.col("cents")).alias("a"), "kind", "tower", F.struct(*fields).alias("x"))
    )
    ordered = F.sort_array(F.collect_list(ranked))
    return F.transform(ordered, lambda r: r["x"]).alias(name)


def assemble(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One nested row per order."""
    objects = cells(lineitem).groupBy("event_id").agg(*[_collection(c) for c in KINDS])
    sample = F.get(F.array(*[F.lit(s) for s in SAMPLES]), (F.col("o_custkey") % 17).cast("int"))
    met = F.struct(
        (F.col("o_totalprice") / 2500.0).alias("pt"),
        (((F.col("o_custkey") * 7919) % 6283) / 1000.0 - 3.1415).alias("phi"),
    )
    events = orders.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderpriority").alias("dataset"),
        sample.alias("sample"),
        met.alias("MET"),
    )
    joined = events.join(objects, "event_id", "left")
    lists = {c: F.coalesce(F.col(c), F.array()) for c in KINDS}
    return joined.select(
        "event_id",
        "dataset",
        "sample",
        "MET",
        *[F.size(e).alias(f"n{c}") for c, e in lists.items()],
        *[e.alias(c) for c, e in lists.items()],
    )


def _local_files(path: str) -> list[Path]:
    root = Path(path)
    return [f for f in root.rglob("*") if f.is_file()] if root.is_dir() else [root]


def _fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Identity of the input files: number, bytes and latest change.

    Files on this machine are looked up directly, which saves a Spark job per
    query; for any other storage Spark lists them and one row comes back.
    """
    if all(Path(p).exists() for p in paths):
        stats = [f.stat() for p in paths for f in _local_files(p)]
        found = (len(stats), sum(s.st_size for s in stats), max(s.st_mtime_ns for s in stats))
    else:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        found = tuple(
            listing.agg(
                F.count(F.lit(1)), F.sum("length"), F.max("modificationTime").cast("string")
            ).first()
        )
    return hashlib.md5(repr((LAYOUT, paths, found)).encode()).hexdigest()[:16]


def event_location(spark: SparkSession, sf_dir: str) -> str:
    """Location holding the ``Events`` tree for these tables, written on first use."""
    inputs = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("orders", "lineitem")]
    key = (spark.sparkContext.applicationId, _fingerprint(spark, inputs))
    with _writing:
        if key not in _written:

            def events() -> DataFrame:
                orders, lineitem = (spark.read.parquet(p) for p in inputs)
                return assemble(orders, lineitem)

            _written[key] = _published(spark, f"{scratch_root(spark)}/events-{key[1]}", "Events", events)
        return _written[key]


def branch_location(spark: SparkSession, sf_dir: str) -> str:
    """Location holding the ``Branches`` tree: the same events as flat branches, one column each."""
    events = read_events(spark, sf_dir, BRANCH_FIELDS)
    location = event_location(spark, sf_dir)
    key = (spark.sparkContext.applicationId, f"{location}/flat")
    with _writing:
        if key not in _written:
            _written[key] = _published(spark, f"{location}-flat", "Branches", lambda: flatten_branches(events))
        return _written[key]


def read_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat branches; a scan reads those that a query names."""
    return read_paths(spark, [f"{branch_location(spark, sf_dir)}/Branches"])


def _published(spark: SparkSession, folder: str, tree: str, make: Callable[[], DataFrame]) -> str:
    """Location of the tree under ``folder`` that any application has published, or a new one.

    A tree is written under a name of its own and then entered in a small table;
    an unfinished one is in nobody's way.
    """

    def entered() -> str | None:
        try:
            names = spark.read.parquet(f"{folder}/published")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return names.agg(F.min("name")).first()[0]

    name = entered()
    if name is None or not _readable(spark, f"{folder}/{name}/{tree}"):
        name = uuid.uuid4().hex
        # Rows are not dealt anew by dataset: a task writes a file for each dataset that it has.
        make().write.partitionBy("dataset").parquet(f"{folder}/{name}/{tree}")
        entry = spark.range(1).select(F.lit(name).alias("name"))
        entry.write.mode("overwrite").parquet(f"{folder}/published")
    return f"{folder}/{name}"


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def _forget(location: str) -> None:
    for key in [k for k, v in _written.items() if v == location]:
        del _written[key]


def read_events(spark: SparkSession, sf_dir: str, reads: Reads | None = None) -> DataFrame:
    """The event table of these tables; its schema is inferred once per application.

    A table that was removed from the scratch folder is written again.
    """

    def read(location: str) -> DataFrame:
        tree = f"{location}/Events"
        if location not in _schemas:
            _schemas[location] = spark.read.parquet(tree).schema
        return read_paths(spark, [tree], reads, _schemas[location])

    location = event_location(spark, sf_dir)
    try:
        return read(location)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        _forget(location)
        return read(event_location(spark, sf_dir))
