"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

``pieces`` tokenises whole documents, ends each with one id and cuts only those
longer than a sequence.  ``pack`` places the pieces.

Pieces are dealt to blocks of bounded size.  For each block several islands
evolve a population of packings: an individual is a list of bins; crossover
injects the best-filled bins of one parent whole into the other, drops that
one's bins that hold a document twice, and puts the displaced documents back by
best fit, largest first.  After each epoch an island sends its elite to the next
island of its block.  A block stops at its lower bound, ceil(total / capacity).
The bins that are not well filled then go, as single pieces, to the next level,
where the leftovers of many blocks form new blocks, until one block remains.

Only (row, length) pairs are grouped, a block at a time; no group grows with the
input, and copies or one source spread evenly because blocks are dealt by row.

Contract: a NULL text is an empty one, and an empty text is one piece that holds
the end id only.  Rows may repeat (each is packed), other columns are ignored,
an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.llm.common import by_size, slim, stored

#: Texts of these characters only, where Python's classes and lower case agree with the tokenizer's.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]*")
#: The tokenizer's split, on lower-cased plain text.
PLAIN_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Slots for what a codec has seen since its table was last full.
SEEN = 1 << 21


class WordCodec(dict):
    """Ids of whole texts by what stands between white space, words encoded by the tokenizers library; at most twice ``limit`` are remembered.

    Few of those that occur once are remembered: ``seen`` has a byte for a hash of each that came, and a second one with that
    hash is kept.  When the table is full it becomes ``before``, and what is used again comes back from there.
    """

    def __init__(self, path: str, limit: int = 1 << 17):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.symbols = dict(enumerate(_symbols()))
        self.limit, self.before, self.seen = limit, {}, bytearray(SEEN)
        probe = "don't stop, naïve 42 été"
        if self.encode(probe) != _packed(self.tokenizer.encode(probe, add_special_tokens=False).ids):
            self.encode = lambda text: _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            letters = word.isalpha()
            if not letters and len(parts := PLAIN_SPLIT.findall(word)) > 1:
                ids = b"".join(map(self.__getitem__, parts))
            else:
                shown = word if letters and word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.symbols)
                ids = _packed([t.id for t in self.tokenize(shown)])
            slot = hash(word) % SEEN
            if not self.seen[slot]:
                self.seen[slot] = 1
                return ids
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.before, self.seen = dict(self), bytearray(SEEN)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        # No match of PLAIN_SPLIT holds white space, and none looks beyond itself.
        return b"".join(map(self.__getitem__, text.lower().split()))


def _symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each document and its end, in pieces of ``capacity``."""
    end = _packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers are used again; this one may come from a stage that needed more.
        slim()
        codec = word_codec(path)
        for batch in batches:
            # Few texts at a time are Python strings beside the batch that they are in.
            few = (batch.slice(k, 256) for k in range(0, batch.num_rows, 256))
            for rows, texts in ((rows, rows.column(1).to_pylist()) for rows in few):
                for a, b in by_size(texts):
                    keys, number, start, length, ids = [], [], [], [], []
                    for row in range(a, b):
                        made = codec.encode(texts[row] or "") + end
                        for k, at in enumerate(range(0, len(made), 4 * capacity)):
                            part = made[at : at + 4 * capacity]
                            keys.append(row)
                            number.append(k)
                            start.append(at // 4)
                            length.append(len(part) // 4)
                            ids.append(part)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(pa.array(keys, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "piece", "start", "length", "ids"],
                    )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids binary"
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, schema)


class Packing:
    """Bins of item numbers with their fill."""

    def __init__(self, bins: list[list[int]], fill: list[int]):
        self.bins, self.fill = bins, fill

    @staticmethod
    def best_fit(order, sizes, capacity: int, bins=None, fill=None) -> Packing:
        """Put the items of ``order`` each into the fullest bin that takes it, or into a new one."""
        bins, fill = bins or [], fill or []
        room = sorted((capacity - f, b) for b, f in enumerate(fill))
        for item in order:
            size = sizes[item]
            at = bisect_left(room, (size, -1))
            if at == len(room):
                bins.append([item])
                fill.append(size)
                b = len(bins) - 1
            else:
                b = room.pop(at)[1]
                bins[b].append(item)
                fill[b] += size
            if fill[b] < capacity:
                insort(room, (capacity - fill[b], b))
        return Packing(bins, fill)

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first; among equals, the more uneven fill leaves the larger gaps for others."""
        return -len(self.bins), sum((f / capacity) ** 2 for f in self.fill)

    def labels(self, n: int) -> np.ndarray:
        out = np.empty(n, dtype="<i4")
        for b, items in enumerate(self.bins):
            out[items] = b
        return out

    @staticmethod
    def of(labels: np.ndarray, sizes: list[int]) -> Packing:
        bins: list[list[int]] = [[] for _ in range(int(labels.max()) + 1)] if len(labels) else []
        for item, b in enumerate(labels.tolist()):
            bins[b].append(item)
        return Packing(bins, [sum(sizes[i] for i in items) for items in bins])


def crossover(receiver: Packing, giver: Packing, sizes: list[int], capacity: int, count: int, rng) -> Packing:
    """``count`` well-filled bins of ``giver``, whole, in ``receiver``; displaced items return by best fit."""
    order = np.argsort([-f for f in giver.fill], kind="stable")
    chosen = order[: max(count, len(order) // 2)]
    chosen = rng.choice(chosen, size=min(count, len(chosen)), replace=False).tolist()
    bins, fill = [list(giver.bins[b]) for b in chosen], [giver.fill[b] for b in chosen]
    taken = {i for items in bins for i in items}
    displaced: list[int] = []
    for items, f in zip(receiver.bins, receiver.fill, strict=True):
        if taken.isdisjoint(items):
            bins.append(list(items))
            fill.append(f)
        else:
            displaced += [i for i in items if i not in taken]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return Packing.best_fit(displaced, sizes, capacity, bins, fill)


def evolve(population: list[Packing], sizes: list[int], capacity: int, generations: int, rng) -> list[Packing]:
    bound = -(-sum(sizes) // capacity)
    for _ in range(generations):
        population.sort(key=lambda p: p.fitness(capacity), reverse=True)
        if len(population[0].bins) <= bound:
            break
        a, b = rng.choice(len(population), size=2, replace=False).tolist()
        first, second = population[min(a, b)], population[max(a, b)]
        count = max(1, len(first.bins) // 4)
        # The worst bin is opened as well, so that the search does not stand still.
        child = crossover(second, first, sizes, capacity, count, rng)
        worst = min(range(len(child.bins)), key=child.fill.__getitem__)
        freed = child.bins.pop(worst)
        child.fill.pop(worst)
        child = Packing.best_fit(sorted(freed, key=lambda i: -sizes[i]), sizes, capacity, child.bins, child.fill)
        if child.fitness(capacity) > population[-1].fitness(capacity):
            population[-1] = child
    population.sort(key=lambda p: p.fitness(capacity), reverse=True)
    return population


def pack(
    items: DataFrame, capacity: int = 4096, block: int = 2048, islands: int = 2, epochs: int = 2,
    generations: int = 12, size: int = 4, well_filled: float = 0.97,
) -> DataFrame:
    """(row, sequence_id, offset) for items (row bigint unique, length bigint)."""

    def seeded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        sizes = pdf["length"].tolist()
        key = int(pdf["block"].iloc[0])
        out = []
        for island in range(islands):
            rng = np.random.default_rng([key, island])
            first = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
            population = [Packing.best_fit(first, sizes, capacity)]
            if len(population[0].bins) > -(-sum(sizes) // capacity):
                for _ in range(size - 1):
                    noise = rng.uniform(0.7, 1.3, len(sizes))
                    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * noise[i])  # noqa: B023
                    population.append(Packing.best_fit(order, sizes, capacity))
            out.append((key, island, pdf["row"].tolist(), sizes, [p.labels(len(sizes)).tobytes() for p in population]))
        return pd.DataFrame(out, columns=["block", "island", "rows", "sizes", "population"])

    state_schema = "block bigint, island int, rows array<bigint>, sizes array<bigint>, population array<binary>"

    def epoch(number: int):
        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            home = pdf[pdf["rows"].str.len() > 0].iloc[0]
            sizes = [int(x) for x in home["sizes"]]
            people = [Packing.of(np.frombuffer(x, "<i4"), sizes) for packed in pdf["population"] for x in packed]
            people.sort(key=lambda p: p.fitness(capacity), reverse=True)
            key, island = int(home["block"]), int(home["island"])
            rng = np.random.default_rng([key, island, number])
            people = people[: size + 1]
            if len(people) > 1:
                people = evolve(people, sizes, capacity, generations, rng)
            packed = [p.labels(len(sizes)).tobytes() for p in people[:size]]
            stay = (key, island, list(home["rows"]), sizes, packed)
            elite = (key, (island + 1) % islands, [], [], packed[:1])
            return pd.DataFrame([stay, elite], columns=["block", "island", "rows", "sizes", "population"])

        return step

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf[pdf["rows"].str.len() > 0].iloc[0]
        sizes = [int(x) for x in home["sizes"]]
        people = [Packing.of(np.frombuffer(x, "<i4"), sizes) for packed in pdf["population"] for x in packed]
        chosen = max(people, key=lambda p: p.fitness(capacity))
        rows = list(home["rows"])
        out = []
        for b, members in enumerate(chosen.bins):
            at = 0
            for i in members:
                out.append((rows[i], int(home["block"]), b, at, sizes[i], chosen.fill[b]))
                at += sizes[i]
        return pd.DataFrame(out, columns=["row", "block", "bin", "offset", "length", "fill"])

    placed_schema = "row bigint, block bigint, bin int, offset bigint, length bigint, fill bigint"
    done, level, rest, before = [], 0, items.select("row", "length"), None
    while True:
        count = rest.count()
        blocks = max(1, -(-count // block))
        dealt = rest.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "row"), F.lit(blocks)))
        state = dealt.groupBy("block").applyInPandas(seeded, state_schema)
        for number in range(epochs):
            state = state.groupBy("block", "island").applyInPandas(epoch(number), state_schema)
        placed = stored(state.groupBy("block").applyInPandas(best, placed_schema), "packing")
        # Fields of their own: a block dealt by hash may have more than ``block`` rows, and so as many bins.
        number = F.lit(level << 56) + F.shiftleft("block", 28) + F.col("bin")
        placed = placed.withColumn("sequence_id", number)
        # Lengths that never fill a sequence would come back whole at each level.
        if blocks == 1 or (before is not None and 2 * count > before):
            done.append(placed.select("row", "sequence_id", "offset"))
            break
        full = F.col("fill") >= int(well_filled * capacity)
        # Of the blocks' sequences, those that are not well filled are opened again.
        done.append(placed.filter(full).select("row", "sequence_id", "offset"))
        rest = placed.filter(~full).select("row", "length")
        level, before = level + 1, count
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096) -> DataFrame:
    """Pieces of ``docs`` with crc32 of their ids, their sequence and their place in it."""
    cut = pieces(docs, path, doc_id, text, capacity)
    cut = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    # The number of a row is written with it, so that it never changes afterwards.
    cut = stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return cut.join(pack(cut, capacity), "row").drop("row")
