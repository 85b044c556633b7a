"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, replaces homoglyphs by Latin letters and, inside words that
hold a letter, digits and signs by the letters they stand for.  The lexicon maps
word beginnings and whole words to weights (log odds of toxic against clean
training documents); exception phrases are two-word phrases with a lexicon word
that clean documents use, and hits inside them do not count.  The sum of the
weights is normalised by length, and a logistic curve fitted on the same sample
turns it into a score.

Fitting uses about ``sample`` labelled documents at most, chosen by a hash of
their id.  Scoring covers every whole text and takes nothing but text.

Contract: NULL and empty texts get the score of a text without hits.  Rows may
repeat, other columns pass through.  Without a toxic training document all
scores are 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cyrillic, Greek and full-width letters that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгеёзикмнорстухѕіјԁһӏαβεικνορτυχωѵցոս", "abbreeeukmhopctyxsijdhlabeikvoptuxwvgnu", strict=True))
#: Digits and signs written for letters.
STANDS_FOR = dict(zip("0134578@$!|", "oieastbasil", strict=True))

_fold = str.maketrans({**HOMOGLYPHS, **{chr(0xFF41 + k): chr(97 + k) for k in range(26)}, "­": "", "​": "", "‍": "", "‌": ""})
_digits = str.maketrans(STANDS_FOR)
_mixed = re.compile(r"(?:[^\W_]|[@$!|])*(?:[^\W\d_][0-9@$!|]|[0-9@$|][^\W\d_])(?:[^\W_]|[@$!|])*")
_word = re.compile(r"[^\W\d_]+")
_signs = re.compile(r"[0-9@$|]")


def folded_words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = text.translate(_fold)
    if _signs.search(text):
        text = _mixed.sub(lambda m: m[0].translate(_digits), text)
    return _word.findall(text)


def terms(words: list[str], stem: int = 4, longest: int = 6) -> set[str]:
    """What a document offers to the lexicon: ``word.`` for a whole word, ``stem`` for a beginning."""
    out = {w + "." for w in set(words)}
    for w in {w[:longest] for w in words}:
        out.update(w[:k] for k in range(stem, min(longest, len(w)) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, tuple] = field(default_factory=dict)
    slope: float = 0.0
    shift: float = -50.0

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            pattern = f" {term[:-1]} " if term.endswith(".") else f" {term}"
            machine.add_word(pattern, (len(pattern), weight, False))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
        if len(machine):
            machine.make_automaton()
        return machine

    def raw(self, machine, words: list[str]) -> float:
        """Sum of the weights of the words hit, over the root of the length in words."""
        if not words or not len(machine):
            return 0.0
        text = f" {' '.join(words)} "
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight, exception) in machine.iter(text):
            start = end - size + 1
            if exception:
                excused.append((start, end))
            elif weight > best.get(start, -math.inf):
                best[start] = weight
        hits = [w for s, w in best.items() if not any(a <= s < b for a, b in excused)] if excused else list(best.values())
        return sum(hits) / math.sqrt(max(len(words), 30) / 30)

    def score(self, machine, text: str | None) -> float:
        x = self.slope * self.raw(machine, folded_words(text)) + self.shift
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def fit(
    docs: DataFrame, labels: DataFrame, training: Column | None = None, text: str = "text", doc_id: str = "doc_id",
    toxic: str = "toxic", sample: int = 12_000, size: int = 2000, least: int = 5, odds: float = 12.0,
) -> Lexicon:
    """Lexicon and curve from about ``sample`` labelled training documents at most."""
    kept = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if training is not None:
        kept = kept.filter(training)
    kept = kept.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in kept.groupBy("toxic").count().collect()}
    if not counts.get(1):
        return Lexicon()
    # As many of either label at most, so that a rare label is not lost in the sample.
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / 2 / n))])
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = kept.filter(place < rate[F.col("toxic")])
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    # The sampled labels are about ``sample`` rows, so they go to the texts and no other text moves.
    joined = texts.join(F.broadcast(kept), "doc_id").select("text", "toxic").dropDuplicates()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch["text"], batch["toxic"], strict=True):
                words = folded_words(t)
                seen[y].update(terms(words))
                seen[y].update({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} if y == 0 else ())
                seen[y]["#"] += 1
        names = list(seen[0].keys() | seen[1].keys())
        if names:  # a frame without rows would have no types
            yield pd.DataFrame({"term": names, "clean": [seen[0][n] for n in names], "dirty": [seen[1][n] for n in names]})

    sampled = joined.repartition(8)
    table = sampled.mapInPandas(counted, "term string, clean bigint, dirty bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("dirty").alias("dirty"))
    total = table.filter("term = '#'").select("clean", "dirty").first()
    if total is None:
        return Lexicon()
    clean, dirty = max(1, total[0]), max(1, total[1])
    ratio = (F.col("dirty") + 0.25) / dirty / ((F.col("clean") + 0.5) / clean)
    found = table.filter((F.col("dirty") >= max(least, dirty // 500)) & (ratio >= odds) & (F.col("term") != "#"))
    rows = found.select("term", "clean", "dirty", ratio.alias("ratio")).orderBy(F.col("dirty").desc(), "term").limit(size).collect()
    chosen: dict[str, tuple[float, int]] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        word = r["term"].rstrip(".")
        shorter = max((chosen[word[:k]][1] for k in range(4, len(word) + 1) if word[:k] in chosen), default=0)
        # A longer term is kept if it is not just a part of what a shorter one already covers.
        if r["dirty"] > 0.9 * shorter or not shorter:
            chosen[r["term"]] = (math.log(r["ratio"]), r["dirty"])
    lexicon = Lexicon({t: w for t, (w, _) in chosen.items()})
    if not chosen:
        return lexicon
    known = [t[:-1] for t in chosen if t.endswith(".")]
    if known:
        pair = F.split("term", " ")
        phrases = table.filter((F.instr("term", " ") > 0) & ((pair[0].isin(known)) | (pair[1].isin(known))))
        common = phrases.filter((F.col("clean") >= 3) & (F.col("clean") / clean > 3 * F.col("dirty") / dirty))
        lexicon.exceptions = {r["term"]: () for r in common.orderBy(F.col("clean").desc(), "term").limit(size).collect()}

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"x": [lexicon.raw(machine, folded_words(t)) for t in batch["text"]], "y": batch["toxic"]})

    points = np.array(sorted(tuple(r) for r in sampled.mapInPandas(measured, "x double, y int").collect()))
    lexicon.slope, lexicon.shift = _logistic(points[:, 0], points[:, 1])
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Balanced logistic curve with a rising slope, by Newton's method with a little ridge."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a = np.stack([x, np.ones_like(x)], 1)
    theta = np.zeros(2)
    ridge = np.diag([1e-4, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge @ theta
        theta -= np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, gradient)
    return float(max(theta[0], 0.0)), float(theta[1])


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``score``."""
    source = docs.drop("score")
    # At most ``size`` terms and as many phrases.
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        machine = tool.automaton()
        for batch in batches:
            made = [tool.score(machine, t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{kinds}, score double")
