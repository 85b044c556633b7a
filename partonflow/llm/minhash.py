"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

A sketch has COORDINATES values.  In rounds 0, 1, ... every shingle is hashed
into one bin and the bin keeps the smallest (round, hash); from round
COORDINATES on, round t fills bin t - COORDINATES with certainty.  Filling stops
after the first round that leaves no bin empty, so a large set needs one or two
rounds, a small one more, and every coordinate is filled with the concentration
of as many independent hashes.

Documents with the same set are one class.  Sketches are cut into 40 bands of 6
coordinates; classes that agree in a band meet in its bucket, and those that
agree in two are compared.  Before that, pairs go whose sets cannot reach the
similarity by their sizes or by PARITY bits, one for each slot of shingles: two
sets differ in at least as many shingles as in bits, so no link is lost.  A pair at similarity 0.85 is missed with a chance of
2e-7, one at 0.8 of 8e-5.  In a bucket members are compared with few hubs at a time, first with the class that
meets most others, and what is linked already is not compared again, so a large group of near copies costs its
size times a few rounds.  Rounds go on, with more hubs each, until no bucket
holds members of two components that have not been compared; no candidate is
dropped.  A pair is linked only after its full sets have been compared.

Contract: words are lower-cased (A-Z) and split at ASCII white space.  A text
with fewer than ``width`` words is one shingle; a text without words, or NULL,
has an empty set and is linked with nothing.  Rows that repeat an id belong
together; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.llm.common import ascii_words, dropped, mix64, stored
from partonflow.llm.components import components

BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: Bits of the parity sketch of a set, kept as longs.
PARITY = 1024
#: Rounds in which each member meets one hub, before the rounds that compare all that is still apart.
NARROW = 3


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(w, len(known)) for w in words])
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)[number]
    n = len(words) - width + 1
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)


def sketch(hashes: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set.

    Values carry their round in front, so several rounds can be taken at once: a
    bin that an earlier round fills keeps that value.
    """
    empty, n = np.uint64(2**64 - 1), len(hashes)
    out = np.full(size, empty)

    def placed(rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, value) of every shingle in every round, one row per round."""
        h = mix64(hashes[None, :] + ((rounds + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))[:, None])
        return h, (rounds << np.uint64(48))[:, None] | mix64(h) >> np.uint64(16)

    t, left = 0, size
    while t < size and left:
        # As many rounds as should fill what is left, in bounded memory.
        count = min(math.ceil(size * (math.log(left) + 1) / n), max(1, (1 << 14) // n), size - t)
        h, value = placed(np.arange(t, t + count, dtype=np.uint64))
        bins = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.intp)
        np.minimum.at(out, bins.ravel(), value.ravel())
        t, left = t + count, int((out == empty).sum())
    # The last rounds fill one bin each.
    for some in np.array_split(np.flatnonzero(out == empty), max(1, left * n >> 14)):
        if len(some):
            out[some] = placed(some.astype(np.uint64) + np.uint64(size))[1].min(axis=1)
    return out


def band_keys(values: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band."""
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.astype(np.int64).tolist()


def parity(hashes: np.ndarray) -> list[int]:
    """For each of PARITY slots whether an odd number of the hashes falls into it, as longs."""
    slots = (mix64(hashes) >> np.uint64(32)) % np.uint64(PARITY)
    odd = np.bincount(slots.astype(np.intp), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def shingled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, cls, bands, odd): a 64-bit digest of each set, its band keys and parity bits; NULL for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cls, bands, odd = [], [], [], []
            for value in batch.column(1):
                hashes = shingle_hashes(value.as_py(), width)
                size.append(len(hashes))
                cls.append(_digest(hashes) if len(hashes) else None)
                bands.append(band_keys(sketch(hashes)) if len(hashes) else None)
                odd.append(parity(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, odd))],
                names=["doc_id", "n_shingles", "cls", "bands", "odd"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, n_shingles bigint, cls bigint, bands array<bigint>, odd array<bigint>")


def _digest(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; linked if 100 * intersection >= percent * union."""
    sets = stored(shingled(docs, doc_id, text, width), "shingled")
    some = sets.filter("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = some.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    signed = some.join(classes.select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"]).dropDuplicates(["cls"]).select("cls", F.col("n_shingles").alias("n"), "bands", "odd")

    everywhere = signed.select(F.explode("bands").alias("key"), "cls", "n")
    shared = everywhere.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = stored(everywhere.join(shared, "key"), "met")
    # How many others a class meets: the largest in a group of near copies is the one that most of them resemble.
    members = stored(met.drop("size").join(met.groupBy("cls").agg(F.sum("size").alias("weight")), "cls"), "buckets")
    dropped(met)
    near = members.select("cls").distinct()
    signed = stored(signed.join(near, "cls"), "signed").select("cls", "bands", "odd")
    full = stored(_sets(docs, some.select("doc_id", "cls").join(near, "cls"), doc_id, text, width), "sets")

    # Sets of rows that share an id belong together.
    first = some.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a != z").select("doc_id", "a")
    links = some.join(first, "doc_id").select("a", F.col("cls").alias("b")).filter("a != b").distinct()
    found = components(links)
    done, hubs, narrow, tested, labelled, loose = None, 1, NARROW, None, None, None

    def grown(linked: DataFrame) -> DataFrame:
        """``found`` with these links."""
        made = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(linked))
        spent.extend(t for t in (found, labelled, loose) if t is not None)
        return made

    # Tables, broadcasts and plans of a round go before the next, or they pile up in the driver.
    spent: list[DataFrame] = []
    while True:
        dropped(*spent)
        spent.clear()
        if labelled is None:
            # Where no component has grown, the open buckets stay as they are.
            label = found.select(F.col("id").alias("cls"), "component")
            labelled = members.join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
            apart = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
            labelled, loose = stored(labelled.join(apart, "key"), "open"), None
        if hubs == 1:
            chosen = labelled.groupBy("key").agg(F.max(F.struct("weight", "cls"))["cls"].alias("hub"))
        else:
            # The members outside the largest component of a bucket that have not been hubs yet; more of them each round.
            # A class is a hub in all its open buckets at once, so what is done is known by class.
            if loose is None:
                counts = labelled.groupBy("key", "component").agg(F.count("*").alias("c"))
                top = F.max(F.struct("c", "component"))
                largest = counts.groupBy("key").agg(top["component"].alias("largest"), (F.sum("c") - top["c"]).alias("number"))
                outside = labelled.join(largest, "key").filter("component != largest").groupBy("cls").agg(F.max("number").alias("number"))
                # Written first, as Spark would look up what is done for each member of each bucket instead.
                loose = stored(outside, "loose")
                if done is not None:
                    spent.append(loose)
                    loose = stored(loose.join(done, "cls", "left_anti"), "loose")
            turn = F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) * F.col("number") < F.lit(hubs << 20)
            hub, loose = stored(loose.filter(turn).select("cls"), "hub"), loose.filter(~turn)
            chosen = labelled.join(hub, "cls").select("key", F.col("cls").alias("hub"))
        chosen = stored(chosen, "hubs")
        spent.append(chosen)
        if narrow and chosen.limit(1).count():
            # First each member meets one hub only, the one of most of its buckets: large groups grow together
            # for as many comparisons as they have members, and few buckets stay apart.
            meets = _meetings(labelled, chosen, signed, percent).groupBy("cls", "hub").agg(F.count("*").alias("c"))
            if tested is not None:
                meets = meets.join(tested, ["cls", "hub"], "left_anti")
            meets = stored(meets.groupBy("cls").agg(F.max(F.struct("c", "hub"))["hub"].alias("hub")), "meets")
            if tested is None:
                tested = meets
            else:
                spent += [tested, meets]
                tested = stored(tested.union(meets), "tested")
            linked = _verified(meets.select(F.col("hub").alias("a"), F.col("cls").alias("b")), signed, full, percent)
            spent.append(linked)
            narrow -= 1
            if linked.limit(1).count():
                found, labelled = grown(linked), None
            else:
                narrow = 0
            continue
        if not chosen.limit(1).count():
            spent += [] if hubs == 1 else [hub]
            if hubs == 1 or not loose.limit(1).count():
                break
            hubs *= 4
            continue
        if hubs > 1 and done is None:
            done = hub
        elif hubs > 1:
            spent += [done, hub]
            done = stored(done.union(hub), "done")
        pairs = _meetings(labelled, chosen, signed, percent).select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        linked = _verified(pairs, signed, full, percent)
        spent.append(linked)
        if linked.limit(1).count():
            found, labelled = grown(linked), None
        hubs = hubs * 4 if hubs > 1 else 2
    dropped(*spent, *(t for t in (members, signed, full, labelled, loose, done, tested) if t is not None))
    # A component goes by the smallest id of its classes.
    label = classes.join(found.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    smallest = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = label.join(smallest, "component").select("cls", "component_id")
    out = sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")).join(by_class, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _meetings(labelled: DataFrame, chosen: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """(cls, hub) for each bucket where a member meets a hub of another component that sizes and parity bits let be similar."""
    odd = signed.select("cls", "odd")
    hub = labelled.join(chosen.withColumnRenamed("hub", "cls"), ["key", "cls"]).join(odd, "cls")
    hub = hub.select("key", *(F.col(name).alias(f"hub_{name}") for name in ("cls", "n", "component", "odd")))
    member = labelled.join(chosen.select("key").distinct(), "key", "left_semi").select("key", "cls", "n", "component").join(odd, "cls")
    n, hub_n = F.col("n"), F.col("hub_n")
    differ = sum((F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("hub_odd", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    # 100 * both >= percent * union says that at most this many shingles are in one set only.
    fits = (n * 100 >= hub_n * percent) & (hub_n * 100 >= n * percent) & (differ * (100 + percent) <= (n + hub_n) * (100 - percent))
    same_bucket = (member["key"] == hub["key"]) & (F.col("component") != F.col("hub_component"))
    return member.join(hub, same_bucket & fits).select("cls", F.col("hub_cls").alias("hub"))


def _sets(docs: DataFrame, near: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(cls, hashes) of the classes that have a candidate, from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_hashes(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(h) for h in made], pa.int64()), pa.array([h.tobytes() for h in made], pa.binary())], names=["cls", "hashes"]
            )

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    one = near.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    return texts.join(one, "doc_id", "left_semi").select("text").mapInArrow(run, "cls bigint, hashes binary").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, signed: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that agree in two bands and whose full sets reach the similarity, stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.loc[keep, ["a", "b"]]

    for name in ("a", "b"):
        pairs = pairs.join(signed.select(F.col("cls").alias(name), F.col("bands").alias(f"{name}_bands")), name)
    pairs = stored(pairs.filter(F.size(F.array_intersect("a_bands", "b_bands")) >= 2).select("a", "b"), "pairs")
    asked = pairs
    # Only the sets in use move; a short list of them is broadcast, as its stored size tells.
    used = stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "used")
    full = full.join(used, "cls", "left_semi")
    for name, column in (("a", "x"), ("b", "y")):
        pairs = pairs.join(full.select(F.col("cls").alias(name), F.col("hashes").alias(column)), name)
    linked = stored(pairs.select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint"), "links")
    dropped(asked, used)
    return linked
