"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its letter n-grams (one to three, hashed),
normalised to length one.  Every language has several centroids, found by
spherical k-means over its training vectors; a text belongs to the language of
the centroid with the largest cosine.  It is rejected if that cosine is below what
nearly all training texts of that language reach when they are cut to its length,
or if it has no letter.  The floor is low for a few words and near the training
texts' own level from CUTS[-1] characters on.

Fitting uses at most about ``per_language`` texts of each language, chosen by a
hash of their id; prediction covers every whole text and takes nothing but text.

Contract: NULL texts and texts without a letter give ``und`` with score 0 and
are rejected.  Rows may repeat, other columns pass through.  Without any
training row every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partonflow.llm.common import mix64

UNKNOWN = "und"
#: Lengths in characters at which the cosines of training texts are measured, for the floor of rejection.
CUTS = (16, 32, 64, 128, 256, 512)
_letter = re.compile(r"[^\W\d_]")


def ngram_counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of hashed n-grams of one to three characters; None if there is no letter.

    Whatever is not a letter separates words, and words are framed by a space.
    """
    if not text or not _letter.search(text):
        return None
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    symbols, at = np.unique(points, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in symbols])
    codes = np.where(letters, symbols, 32).astype(np.uint64)[at]
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    two = codes[:-1] << np.uint64(21) | codes[1:]
    three = two[:-1] << np.uint64(21) | codes[2:]
    grams = np.concatenate([codes[codes != 32], two | np.uint64(1 << 63), three])
    return np.bincount((mix64(grams) % np.uint64(dims)).astype(np.intp), minlength=dims).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray  # a row per centroid: the least cosine by number of n-grams, at the points ``sizes``
    languages: list[str]
    sizes: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)"""
        counts = ngram_counts(text, len(self.idf))
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ self.vector(counts)
        best = int(np.argmax(cosines))
        least = np.interp(np.log(counts.sum()), np.log(self.sizes), self.floor[best])
        return self.languages[best], float(np.clip(cosines[best], 0, 1)), bool(cosines[best] < least)


def _kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart seeds: centroids and the cluster of each row."""
    seeds = [0]
    near = rows @ rows[0]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[seeds[-1]])
    centroids = rows[seeds]
    for _ in range(rounds):
        owner = np.argmax(rows @ centroids.T, axis=1)
        centroids = _unit(np.stack([rows[owner == c].sum(0) if (owner == c).any() else centroids[c] for c in range(len(centroids))]))
    return centroids, np.argmax(rows @ centroids.T, axis=1)


def fit(
    docs: DataFrame, training: Column | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    per_language: int = 400, clusters: int = 4, dims: int = 2048, slack: float = 0.8,
) -> Model:
    """Centroids from at most about ``per_language`` training texts of each language."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if training is not None:
        labelled = labelled.filter(training)
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang).alias("lang")).count().collect()}
    if not counts:
        return Model(np.zeros(dims, np.float32), np.zeros((0, dims), np.float32), np.zeros((0, 1)), [], np.ones(1))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64(F.lit("fit"), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.filter(place < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for k, t in zip(batch["lang"], batch["text"], strict=True):
                whole = ngram_counts(t, dims)
                if whole is not None:
                    made.append((k, 0, whole.tobytes()))
                    cut = [(c, ngram_counts(t[:c], dims)) for c in CUTS if c < len(t)]
                    # Few cells of a short piece are filled.
                    made += [(k, c, np.stack([(at := np.flatnonzero(v)), v[at]]).astype("<u2").tobytes()) for c, v in cut if v is not None]
            if made:
                yield pd.DataFrame(made, columns=["lang", "cut", "v"])

    found = sorted((r[0], r[1], bytes(r[2])) for r in sample.mapInPandas(counted, "lang string, cut int, v binary").collect())
    rows = [(name, v) for name, cut, v in found if not cut]
    if not rows:
        return Model(np.zeros(dims, np.float32), np.zeros((0, dims), np.float32), np.zeros((0, 1)), [], np.ones(1))
    names = np.array([r[0] for r in rows])
    matrix = np.stack([np.frombuffer(r[1], np.float32) for r in rows])
    idf = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    matrix = _unit(np.log1p(matrix) * idf)
    pieces: dict[tuple[str, int], list[np.ndarray]] = {}
    for name, cut, v in found:
        if cut:
            at, n = np.frombuffer(v, "<u2").reshape(2, -1)
            piece = np.zeros(dims, np.float32)
            piece[at] = n
            pieces.setdefault((name, cut), []).append(piece)

    def floor(name: str, own: np.ndarray) -> list[float]:
        """``slack`` times what 99 % of the pieces of each length reach; rising with the length."""
        out = [0.0]  # a single character tells nothing
        for cut in CUTS:
            some = pieces.get((name, cut))
            cosines = (_unit(np.log1p(np.stack(some)) * idf) @ own.T).max(1) if some else np.zeros(1)
            out.append(slack * float(np.quantile(cosines, 0.01)))
        return np.maximum.accumulate(out).tolist()

    centroids, floors, languages = [], [], []
    for name in sorted(counts):
        own = matrix[names == name]
        if not len(own):
            continue
        means, owner = _kmeans(own, clusters)
        least = floor(name, means)
        for c in range(len(means)):
            if (owner == c).any():
                centroids.append(means[c])
                floors.append(least)
                languages.append(name)
    # A text of n characters has about three times as many n-grams.
    return Model(idf, np.stack(centroids).astype(np.float32), np.array(floors), languages, np.array([3.0 * c for c in (1, *CUTS)]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    source = docs.drop("lang_pred", "score", "rejected")
    # A few centroids per language: languages x clusters x dims x 4 bytes, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            made = [tool.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "score", "rejected"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
