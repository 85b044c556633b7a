"""Flat branches: one list column per field, and the schema that zips them.

``muon_pt``, ``muon_eta``, ... with a count column ``numbermuon`` become one
``muon`` collection of structs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partonflow.functions import p4

# Naming rules of the flat branches.
COUNT_PREFIX = "number"
SPECIAL_COUNTS = {"GenPart": "numGenPart", "PV": "nPV_x"}
SINGLE_RECORDS = ("met",)
RENAMED_FIELDS = {"e": "energy"}
DROPPED_FIELDS = {"PV": "npvs"}

# What :func:`flatten_branches` uses of the nested collections.
BRANCH_FIELDS = {
    "Jet": ("pt", "eta", "phi", "mass"),
    "Muon": ("pt", "eta", "phi", "mass", "charge"),
    "Electron": ("pt", "eta", "phi", "mass", "charge"),
}


def flatten_branches(events: DataFrame) -> DataFrame:
    """The event table as flat branches."""

    def branch(collection: str, field: str) -> Column:
        return F.col(f"{collection}.{field}")

    def energies(collection: str) -> Column:
        return F.transform(F.col(collection), p4.energy)

    columns: list[Column] = [F.col("event_id"), F.col("dataset")]
    for name, source in (("muon", "Muon"), ("electron", "Electron"), ("jet", "Jet")):
        columns.append(F.col(f"n{source}").alias(f"number{name}"))
        columns += [branch(source, f).alias(f"{name}_{f}") for f in ("pt", "eta", "phi")]
        columns.append(energies(source).alias(f"{name}_e"))
        if name != "jet":
            columns.append(branch(source, "charge").alias(f"{name}_ch"))
    columns += [
        F.col("MET.pt").alias("met_pt"),
        F.col("MET.phi").alias("met_phi"),
        F.col("nElectron").alias("numGenPart"),
        branch("Electron", "pt").alias("GenPart_pt"),
        branch("Electron", "eta").alias("GenPart_eta"),
        F.col("nJet").alias("nPV_x"),
        branch("Jet", "eta").alias("PV_x"),
        branch("Jet", "phi").alias("PV_y"),
        F.col("nJet").alias("PV_npvs"),
    ]
    return events.select(*columns)


def _members(columns: list[str], collection: str) -> dict[str, str]:
    """Field name -> column of one collection."""
    skip = DROPPED_FIELDS.get(collection)
    found = {}
    for column in columns:
        head, _, field = column.partition("_")
        if head == collection and field and not (skip and skip in field):
            found[RENAMED_FIELDS.get(field, field)] = column
    return found


def _chosen(fields: dict[str, str], name: str, wanted: Mapping[str, Sequence[str]] | None) -> dict[str, str]:
    if wanted is None:
        return fields
    missing = set(wanted[name]) - set(fields)
    if missing:
        raise ValueError(f"{name} has no branch for {sorted(missing)}")
    return {f: fields[f] for f in wanted[name]}


def count_column(collection: str) -> str:
    return SPECIAL_COUNTS.get(collection, f"{COUNT_PREFIX}{collection}")


def list_collections(columns: list[str]) -> list[str]:
    """Collections the column names describe: those with a count column."""
    counted = [c[len(COUNT_PREFIX) :] for c in columns if c.startswith(COUNT_PREFIX)]
    special = [name for name, count in SPECIAL_COUNTS.items() if count in columns]
    return counted + special


def zip_collections(
    flat: DataFrame, keep: tuple[str, ...] = (), wanted: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Branches zipped into one list of structs per collection.

    ``wanted`` names the collections and records to make, and their fields; no
    other branch is read.  A zipped list has all its branches read, whatever is used of it.

    Lists of one collection must be equally long: an event where they are not
    is an error.  :func:`count_mismatches` reports such events.
    """
    names = flat.columns
    out: list[Column] = [F.col(k) for k in keep]
    for collection in list_collections(names):
        if wanted is not None and collection not in wanted:
            continue
        fields = _chosen(_members(names, collection), collection, wanted)
        zipped = F.arrays_zip(*[F.col(c).alias(f) for f, c in fields.items()])
        first, *others = fields.values()
        equal = F.lit(True)
        for column in others:
            equal = equal & F.size(column).eqNullSafe(F.size(first))
        unequal = F.raise_error(F.lit(f"branches of {collection} differ in length"))
        out.append(F.when(equal, zipped).otherwise(unequal).alias(collection))
    for record in SINGLE_RECORDS:
        fields = _members(names, record)
        if fields and (wanted is None or record in wanted):
            fields = _chosen(fields, record, wanted)
            out.append(F.struct(*[F.col(c).alias(f) for f, c in fields.items()]).alias(record))
    return flat.select(*out)


def mismatched(names: list[str]) -> Column:
    """Whether any branch of an event is longer or shorter than the stored count."""
    wrong = F.lit(False)
    for collection in list_collections(names):
        count = F.col(count_column(collection))
        for column in _members(names, collection).values():
            wrong = wrong | (F.size(column) != count)
    return wrong


def count_mismatches(flat: DataFrame) -> DataFrame:
    """Events where any branch is longer or shorter than the stored count."""
    return flat.filter(mismatched(flat.columns))
