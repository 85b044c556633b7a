"""Exact integer k-means with equal-average equal-variance nearest-centroid search.

Vectors are made integers, floor(scale * x), and stored once.  A round is one
pass over them: each vector finds its nearest centroid, each task adds up its
vectors per centroid, and one aggregation of those sums gives the next
centroids, at most k x dimension numbers that go to the driver and back.

Search for the nearest centroid: centroids are sorted by the sum of their
components (their mean, times the dimension d) and looked at outward from the
vector's own sum, nearer sum first.  With S the sum and V the root of the summed
squared deviations from the mean, d * distance >= (Sx - Sc)^2 + d * (Vx - Vc)^2.
The first term alone grows outward, so the search of a vector ends when it is
beyond the best distance; both together reject a centroid without computing its
distance.  All of it is in integers, V by bounds from below and above, so that no
centroid is rejected wrongly and ties are seen (the smaller number wins).

Contract of ``cluster``: vectors must have ``dimension`` components, none NULL
or non-finite; all other rows are left out.  Rows may repeat, each counts; a NULL
id counts as an id written as the empty text, and rows with equal ids are ordered
by their components.  With fewer than k vectors there are as many centroids; with
none, no rows.  Other columns of the input are not read, whatever their names.
Components of any finite size are exact: those beyond 2^30 / d are calculated in
unbounded integers.  A distance or inertia above the range of a long is NULL.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partonflow.llm.common import stored

#: Sums travel as digits of this many bits, so that adding up those of all tasks stays in a long.
DIGIT = 40
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Sorted:
    """Centroids in the order of their sums."""

    number: np.ndarray
    vectors: np.ndarray
    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, centroids: list[list[int]], exact: bool) -> Sorted:
        vectors = np.array(centroids, dtype=object if exact else np.int64)
        sums = vectors.sum(axis=1)
        order = np.array(sorted(range(len(centroids)), key=lambda k: (sums[k], k)))
        return cls(order, vectors[order], sums[order], *spread(vectors[order], sums[order]))


def spread(vectors: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer bounds of sqrt(d * sum of squares - sum^2), the root of d times the summed squared deviations."""
    squared = vectors.shape[1] * (vectors * vectors).sum(axis=1) - sums * sums
    if vectors.dtype == object:
        low = np.array([math.isqrt(x) for x in squared] + [None], dtype=object)[:-1]
        return low, low + 1
    low = np.sqrt(squared.astype(np.float64)).astype(np.int64)
    return np.maximum(low - 1, 0), low + 2


def nearest(vectors: np.ndarray, found: Sorted) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of every row; and how many distances were computed."""
    n, d = vectors.shape
    k = len(found.number)
    sums = vectors.sum(axis=1)
    low, high = spread(vectors, sums)
    right = np.searchsorted(found.sums, sums)
    left = right - 1
    best = np.full(n, -1, dtype=vectors.dtype)  # -1: none yet
    at = np.full(n, k, dtype=np.int64)
    rows, computed = np.arange(n), 0
    while rows.size:
        s, a, b = sums[rows], left[rows], right[rows]
        has_a, has_b = a >= 0, b < k
        gap_a, gap_b = s - found.sums[np.maximum(a, 0)], found.sums[np.minimum(b, k - 1)] - s
        take_a = has_a & (~has_b | (gap_a <= gap_b).astype(bool))
        gap = np.where(take_a, gap_a, gap_b)
        limit = d * best[rows]
        open_ = (has_a | has_b) & ((limit < 0) | (gap * gap <= limit)).astype(bool)
        rows, take_a, gap, limit = rows[open_], take_a[open_], gap[open_], limit[open_]
        c = np.where(take_a, left[rows], right[rows])
        left[rows] -= take_a
        right[rows] += ~take_a
        apart = np.maximum(np.maximum(low[rows] - found.high[c], found.low[c] - high[rows]), 0)
        near = ((limit < 0) | (gap * gap + apart * apart <= limit)).astype(bool)
        r, c = rows[near], c[near]
        computed += len(r)
        difference = vectors[r] - found.vectors[c]
        distance = (difference * difference).sum(axis=1)
        number = found.number[c]
        better = ((best[r] < 0) | (distance < best[r]) | ((distance == best[r]) & (number < at[r]))).astype(bool)
        best[r[better]], at[r[better]] = distance[better], number[better]
    return at, best, computed


def scaled(vector, scale: int) -> list[int]:
    """floor(scale * x) of every component as a double, also where the product leaves the doubles."""
    return [math.floor(scale * x) if abs(x) < 2.0**900 else scale * int(x) for x in vector]


def digits(value: int) -> list[tuple[int, int]]:
    """(place, digit) of the non-zero digits of an integer, each with its sign."""
    sign, rest, out, place = (-1 if value < 0 else 1), abs(value), [], 0
    while rest:
        if low := rest & ((1 << DIGIT) - 1):
            out.append((place, sign * low))
        rest >>= DIGIT
        place += 1
    return out


def _blocks(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row places, integer matrix) of the rows that fit the fast integers, then of the others."""
    small = [i for i, big in enumerate(frame["big"]) if big is None]
    large = [i for i, big in enumerate(frame["big"]) if big is not None]
    if small:
        yield np.array(small), np.stack([np.asarray(frame["v"].iloc[i], dtype=np.int64) for i in small])
    if large:
        yield np.array(large), np.array([[int(x) for x in frame["big"].iloc[i]] for i in large], dtype=object)


def _assign(frame: pd.DataFrame, centroids: list[list[int]], limit: int) -> Iterator[tuple]:
    """(row places, vectors, numbers, distances) of the blocks of ``frame``."""
    fits = all(abs(x) < limit for c in centroids for x in c)
    for places, vectors in _blocks(frame):
        exact = vectors.dtype == object or not fits
        vectors = vectors.astype(object) if exact else vectors
        number, distance, _ = nearest(vectors, Sorted.of(centroids, exact))
        yield places, vectors, number, distance


def integers(rows: DataFrame, vec_id: str, vector: str, dimension: int, scale: int) -> DataFrame:
    """Complete vectors as integers: ``v``, or ``big`` as decimal texts where a component is too large for ``v``."""
    limit = (1 << 30) // dimension
    of = F.col(vector)
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = rows.select(F.col(vec_id).alias("vec_id"), of.cast("array<double>").alias("x")).filter(
        (F.size("x") == dimension) & F.forall("x", plain)
    )
    small = F.forall("x", lambda x: F.abs(F.lit(float(scale)) * x) < F.lit(float(limit - 1)))
    made = F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))

    def large(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": None, "big": [[str(y) for y in scaled(x, scale)] for x in f["x"]]})

    kind = dict(kept.dtypes)["vec_id"]
    fast = kept.filter(small).select("vec_id", made.alias("v"), F.lit(None).cast("array<string>").alias("big"))
    return fast.unionByName(kept.filter(~small).mapInPandas(large, f"vec_id {kind}, v array<long>, big array<string>"))


def seeds(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(order.alias("h"), "v", "big").orderBy("h", "v", "big").limit(k).collect()
    return [[int(x) for x in (r["v"] if r["v"] is not None else r["big"])] for r in first]


def moved(vectors: DataFrame, centroids: list[list[int]], limit: int) -> list[list[int]]:
    """Centroids after one round: the floor of the mean of their vectors; those without vectors stay."""
    d = len(centroids[0])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, list[int]] = {}
        counts: dict[int, int] = {}
        for frame in frames:
            for _, block, number, _ in _assign(frame, centroids, limit):
                for c in np.unique(number).tolist():
                    mine = block[number == c]
                    totals[c] = [a + int(b) for a, b in zip(totals.get(c, [0] * d), mine.sum(axis=0))]
                    counts[c] = counts.get(c, 0) + len(mine)
        out = [(c, j, p, x) for c, total in totals.items() for j, value in enumerate([*total, counts[c]]) for p, x in digits(value)]
        if out:
            yield pd.DataFrame(out, columns=["c", "j", "p", "x"])

    total = vectors.select("v", "big").mapInPandas(sums, "c int, j int, p int, x long").groupBy("c", "j", "p").agg(F.sum("x").alias("x"))
    sum_of: dict[tuple[int, int], int] = {}
    for r in total.collect():
        sum_of[r["c"], r["j"]] = sum_of.get((r["c"], r["j"]), 0) + (r["x"] << (DIGIT * r["p"]))
    return [
        [sum_of.get((c, j), 0) // sum_of[c, d] for j in range(d)] if (c, d) in sum_of else old for c, old in enumerate(centroids)
    ]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimension: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every complete vector, and the centroids."""
    spark, limit = rows.sparkSession, (1 << 30) // dimension
    vectors = stored(integers(rows, vec_id, vector, dimension, scale), "centroids-vectors")
    centroids = seeds(vectors, k, seed)
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, cluster int, exact string"
    if not centroids:
        return _result(spark.createDataFrame([], schema), []), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids, limit)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for places, _, number, distance in _assign(frame, centroids, limit):
                yield pd.DataFrame({"vec_id": frame["vec_id"].iloc[places], "cluster": number, "exact": [str(x) for x in distance]})

    return _result(stored(vectors.mapInPandas(assign, schema), "centroids-assigned"), centroids), centroids


def _result(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Distances with the sums over each cluster and over all; these are k numbers."""
    length = F.length("exact")
    wide = (DIGIT * 3) // 10  # decimal digits that are summed at a time
    parts = F.transform(F.sequence(F.lit(0), F.floor((length - 1) / wide).cast("int")), lambda i: F.struct(i.alias("p"), _decimal(F.col("exact"), length, i, wide).alias("x")))
    summed = assigned.select("cluster", F.explode(parts).alias("d")).groupBy("cluster", "d.p").agg(F.sum("d.x").alias("x")).collect()
    inertia: dict[int, int] = dict.fromkeys(range(len(centroids)), 0)
    for r in summed:
        inertia[r["cluster"]] += int(r["x"]) * 10 ** (wide * r["p"])
    total = sum(inertia.values())
    fits = lambda x: x if x <= LONG else None
    spark = assigned.sparkSession
    small = spark.createDataFrame(
        [(c, fits(inertia[c]), fits(total), digest(v)) for c, v in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    joined = assigned.join(F.broadcast(small), "cluster")  # k rows
    return joined.select("vec_id", "cluster", F.expr("try_cast(exact AS bigint)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _decimal(text: Column, length: Column, i: Column, wide: int) -> Column:
    """The i-th group of ``wide`` decimal digits, from the right."""
    stop = length - i * wide
    start = F.greatest(stop - wide, F.lit(0))
    return F.substring(text, start + 1, stop - start).cast("decimal(20,0)")
