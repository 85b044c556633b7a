"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low bits.

Every shingle of five words is hashed once.  The high part of the hash picks one
of ``BINS`` bins, and the smallest hash of a bin is kept.  An empty bin i
borrows from the first filled bin in its own order of all bins, the affine
permutation j -> (c_i + j * a_i) mod PRIME (2-universal, the same for every
document).  Of each bin the low ``BITS`` bits are kept, packed as hexadecimal.
The likeness of two fingerprints is the share of equal bins corrected for equal
low bits by chance, (share - 2^-BITS) / (1 - 2^-BITS), at least 0.

Built-in functions only.  A row is fingerprinted where it is read; only finding
the next document moves texts, once, by ranges of the id.

Contract: a text with fewer than five words is one shingle, its words.  A text
without words has no shingle and an all-zero fingerprint; its likeness is 1 to
another such text and 0 to any other.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partonflow.llm.common import WORD_SPLIT, partitions

BINS, PRIME, BITS, WIDTH = 256, 257, 8, 5
#: Filled bins that are tried directly before the nearest is searched among all filled ones.
TRIES = 20

_rng = random.Random(20240501)
_step = [_rng.randrange(1, PRIME) for _ in range(BINS)]
_start = [_rng.randrange(PRIME) for _ in range(BINS)]
_inverse = [pow(a, -1, PRIME) for a in _step]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _constant(values, kind: str = "int") -> Column:
    """An array that the optimizer folds to one literal, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


#: The largest hash of every bin: present in each sorted list, and what an empty bin shows.
_ends = [((b - 128) << 56) | ((1 << 56) - 1) for b in range(BINS)]


def words_of(text: Column) -> Column:
    """Words of a text in lower case; one empty word if there is none."""
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), WORD_SPLIT)


def shingles(words: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles of a list of words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[words[i + k] for k in range(width)]))
    return F.when(F.size(words) >= width, runs).otherwise(F.array(F.xxhash64(words)))


def minima(hashes: Column) -> Column:
    """The smallest hash of each bin, the bin's largest possible hash where it is empty."""
    return _let(
        F.sort_array(F.concat(hashes, _constant(_ends, "bigint"))),
        lambda h: F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(h[F.greatest(i - 1, F.lit(0))], 56))),
    )


def bins(text: Column) -> Column:
    """Low bits of the ``BINS`` bins as bytes; NULL for a text without words."""
    empty = (1 << 56) - 1
    low = lambda x: F.when(x.bitwiseAND(empty) != empty, x.bitwiseAND(2**BITS - 1).cast("int") - 2 ** (BITS - 1))

    orders = F.arrays_zip(
        _constant(range(BINS)).alias("bin"), _constant(_start).alias("start"), _constant(_step).alias("step"), _constant(_inverse).alias("inverse")
    )

    def densified(slot: Column) -> Column:
        filled = F.filter(_constant(range(BINS)), lambda b: slot[b].isNotNull())
        return _let(filled, lambda f: F.transform(orders, lambda o: F.coalesce(slot[o["bin"]], *_borrowed(slot, f, o)).cast("tinyint")))

    def of(words: Column) -> Column:
        slots = F.concat(F.transform(minima(shingles(words)), low), F.array(F.lit(None).cast("int")))
        return F.when(words[0] != "", _let(slots, densified))

    return _let(words_of(text), of)


def _borrowed(slot: Column, filled: Column, order: Column) -> list[Column]:
    """Value of the first filled bin in an empty bin's order: a few tries, then the nearest of all filled bins."""
    start, step, inverse = order["start"], order["step"], order["inverse"]
    tried = [slot[(start + j * step) % PRIME] for j in range(TRIES)]
    nearest = F.array_min(F.transform(filled, lambda b: (b - start + PRIME) % PRIME * inverse % PRIME * BINS + b)) % BINS
    return [*tried, slot[nearest]]


def packed(values: Column) -> Column:
    """Two hexadecimal digits a bin."""
    digits = F.array_join(F.transform(values, lambda v: F.element_at(_digits(), v.cast("int") + (2 ** (BITS - 1) + 1))), "")
    return F.coalesce(digits, F.lit("00" * BINS))


def _digits() -> Column:
    return F.split(F.lit(",".join(f"{v:02x}" for v in range(256))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two lists of bins."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(corrected)


def fingerprint(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """``docs`` with the packed fingerprint of ``text``."""
    return docs.withColumn(column, packed(bins(F.col(text))))


def with_next(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``rows`` with ``next``, a struct of the columns of the row that follows in ascending order of id, then text.

    NULL ids come first, and the first row follows the last.  Rows are dealt by ranges of the id, so no task
    sees them all; each range gets the first row of the next one as an extra row.
    """
    columns = rows.columns
    count = 4 * partitions(rows.sparkSession)
    cuts = rows.select(F.percentile_approx(doc_id, [k / count for k in range(count)], 20 * count).alias("c")).first()["c"]
    bounds = _constant([int(x) for x in sorted(set(cuts or [0]))], "bigint")
    # Binary search: the number of cuts that are not above the id.
    steps = _constant([1 << k for k in reversed(range(len(cuts or [0]).bit_length()))])
    reached = lambda at, step: (at + step <= F.size(bounds)) & (F.element_at(bounds, F.least(at + step, F.size(bounds))) <= F.col(doc_id))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))
    dealt = rows.withColumn("_part", F.coalesce(place, F.lit(0))).withColumn("_extra", F.lit(False))
    # One row for each range: as many as there are cuts, and one for ids below them.
    firsts = dealt.groupBy("_part").agg(F.min(F.struct(F.col(doc_id).isNotNull().alias("known"), F.col(doc_id).alias("id")))["id"].alias("_id"))
    parts = sorted(r[0] for r in firsts.select("_part").collect())
    before = dict(zip(parts, parts[-1:] + parts[:-1], strict=True))
    opening = dealt.join(F.broadcast(firsts), [dealt["_part"] == firsts["_part"], dealt[doc_id].eqNullSafe(firsts["_id"])]).select(dealt["*"])
    # Repeated ids: the least text goes first.
    order = [F.col(doc_id).asc_nulls_first(), F.xxhash64(text)]
    opening = opening.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).filter("_n = 1").drop("_n")
    if parts:
        shift = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        opening = opening.withColumn("_part", shift[F.col("_part")]).withColumn("_extra", F.lit(True))
        dealt = dealt.unionByName(opening)
    window = Window.partitionBy("_part").orderBy(F.col("_extra"), *order)
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(window)).filter("NOT _extra").drop("_part", "_extra")


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: its last quarter replaced by as much of the next text's beginning."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("bins", bins(F.col("text")))
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    rows = with_next(rows).select(
        "doc_id", size.cast("long").alias("n_chars"), "bins", F.col("next.bins").alias("next_bins"),
        F.concat(F.substring("text", F.lit(1), size - quarter), F.substring(F.col("next.text"), F.lit(1), quarter)).alias("edited"),
    )
    rows = rows.withColumn("edited_bins", bins(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
