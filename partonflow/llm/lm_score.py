"""Language-model scores from a weighted backoff automaton.

The model is a word bigram with interpolated absolute discounting over smoothed
unigrams.  States are the root and every word seen as a context; an arc carries
the log probability of a seen bigram, the failure arc of a state leads to the
root and carries the weight of backing off; arcs of the root carry unigrams.
One pass from left to right carries the state and adds up weights.

The corpus is split into blocks of documents of bounded size, written compressed.  A block sends one
row for each part of the key space: the hashes of its distinct words and
bigrams, with their training counts.  The part adds the counts of all blocks up
and answers each block what it asked, in the same order.  The block then builds
the automaton over its own words from the answers, so a task never holds more
of the model than its block can use; what is counted grows with the corpus.
Within a block every word and bigram is sent once.  Bigrams are dealt with their
first word, so that its number of continuations is counted in one place; words
that start many bigrams are dealt by the second word as well, and the counts of
these few are added up at the end.  Which words those are is read off a sample:
that changes where counting happens, not the counts.

Contract: words are lower-cased (A-Z), split at ASCII white space, and followed
by one end, which is a token and the context of the first word.  NULL is the
empty text.  Rows may repeat and are all counted and scored; without training
rows every token has the unigram floor.
"""

from __future__ import annotations

import pickle
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partonflow.llm.common import ascii_words, mix64, partitions, released, slim, stored

#: The end of a text: no word has an empty hash input.
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
ADDED = 0.1
DISCOUNT = 0.75


class Block:
    """Tokens of the documents of a block as numbers, with its distinct words and bigrams."""

    def __init__(self, texts: list[str | None]):
        known: dict[bytes, int] = {b"": 0}
        tokens, self.sizes = array("i"), []
        for text in texts:
            before = len(tokens)
            tokens.extend(known.setdefault(w, len(known)) for w in ascii_words(text))
            tokens.append(0)
            self.sizes.append(len(tokens) - before)
        self.tokens = np.array(tokens, dtype=np.int64)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)
        before = np.r_[0, self.tokens[:-1]] if len(tokens) else self.tokens
        pairs = before * len(known) + self.tokens
        self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)
        self.first, self.second = self.pairs // len(known), self.pairs % len(known)
        # 48 bits: a part of the key space holds too few bigrams for two of them to meet but by rare accident.
        self.pair_hashes = mix64(self.hashes[self.first] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.second]) >> np.uint64(16)

    def parts(self, count: int, spread: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Part of the key space of each word and of each bigram."""
        words = (self.hashes % np.uint64(count)).astype(np.int64)
        pairs = words[self.first]
        if spread:
            ways = np.array([spread.get(int(h), 1) for h in self.hashes])[self.first]
            offset = (self.hashes[self.second] >> np.uint64(20)) % ways.astype(np.uint64)
            pairs = (pairs + offset.astype(np.int64)) % count
        return words, pairs


def _frequent(docs: DataFrame, text: str, count: int, sample: int = 2000) -> dict[int, int]:
    """Words that start more than a quarter of a part's share of bigrams in about ``sample`` texts -> number of ways to deal them."""
    rows = docs.count()
    chosen = docs.filter(F.pmod(F.xxhash64(F.lit("deal"), text), F.lit(max(1, rows // sample))) == 0).select(F.col(text).alias("text")).limit(2 * sample)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block = Block([t if isinstance(t, str) else None for t in batch["text"]])
            n = np.bincount(block.first, minlength=len(block.hashes))
            top = np.argsort(-n)[:2000]
            yield pd.DataFrame({"h": block.hashes[top].astype(np.int64), "n": n[top]})

    top = chosen.mapInPandas(counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(8 * count)
    found = [(r["h"] % 2**64, r["n"]) for r in top.collect()]
    total = sum(n for _, n in found)
    return {h: min(count, int(8 * n * count / total) + 1) for h, n in found if 4 * n * count > total}


def _blocks(source: DataFrame, block_chars: int) -> DataFrame:
    """(block, content): consecutive rows of about ``block_chars`` characters at most, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held, chars, number = [], 0, 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                held.append(row)
                chars += len(row[2])
                if chars >= block_chars:
                    yield _block_row(first + number, held)
                    held, chars, number = [], 0, number + 1
        if held:
            yield _block_row(first + number, held)

    return source.mapInArrow(run, "block bigint, content binary")


def _block_row(number: int, rows: list[tuple]) -> pa.RecordBatch:
    content = zstandard.ZstdCompressor(level=1).compress(pickle.dumps(rows, protocol=5))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([content], pa.binary())], names=["block", "content"])


def _rows(content: bytes) -> list[tuple]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(content))


def score(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", block_chars: int = 6_000_000) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = 4 * partitions(docs.sparkSession)
    spread = _frequent(source, "text", count)
    # Written once, so that a block holds the same rows and has the same number in both passes.
    source_kind = source.schema["doc_id"].dataType.simpleString()
    blocks = stored(_blocks(source, block_chars), "blocks")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, content in zip(batch["block"], batch["content"], strict=True):
                yield questions(number, _rows(content))
                slim()

    def questions(number: int, rows: list[tuple]) -> pd.DataFrame:
        block = Block([r[2] for r in rows])
        inside = np.repeat(np.array([r[1] for r in rows], dtype=bool), block.sizes)
        uni = np.bincount(block.tokens[inside], minlength=len(block.hashes))
        bi = np.bincount(block.pair_of[inside], minlength=len(block.pairs))
        words, pairs = block.parts(count, spread)
        out = []
        by_word, by_pair = _grouped(words, count), _grouped(pairs, count)
        for part in range(count):
            w, p = by_word(part), by_pair(part)
            if len(w) or len(p):
                local, index = np.unique(block.first[p], return_inverse=True)
                hashes = block.pair_hashes[p]
                out.append((
                    part, number, _bytes(block.hashes[w]), _bytes(uni[w].astype("<i4")),
                    _bytes((hashes >> np.uint64(32)).astype("<u2")), _bytes(hashes.astype("<u4")),
                    _bytes(bi[p].astype("<i4")), _bytes(block.hashes[local]), _bytes(index.astype("<i4")),
                ))
        return pd.DataFrame(out, columns=_ASK)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        slim()
        pdf = pdf.sort_values("block")
        load = lambda c, t: [np.frombuffer(x, t) for x in pdf[c]]
        words, uni = load("words", np.uint64), load("uni", "<i4")
        pairs = [h.astype(np.uint64) << np.uint64(32) | x.astype(np.uint64) for h, x in zip(load("high", "<u2"), load("low", "<u4"), strict=True)]
        bi = load("bi", "<i4")
        contexts, index = load("contexts", np.uint64), load("index", "<i4")
        word_key, word_total, word_at = _summed(words, uni)
        pair_key, pair_total, pair_at = _summed(pairs, bi)
        # Continuations of a word: its distinct bigrams with a training count, each counted once.
        context = np.concatenate([c[i] for c, i in zip(contexts, index, strict=True)]) if len(pdf) else np.zeros(0, np.uint64)
        owner = np.zeros(len(pair_key), np.uint64)
        owner[pair_at] = context
        live = pair_total > 0
        name, kinds = np.unique(owner[live], return_counts=True)
        types = np.zeros(len(word_key), np.int64)
        if len(name):
            spot = np.minimum(np.searchsorted(name, word_key), len(name) - 1)
            types = np.where(name[spot] == word_key, kinds[spot], 0)
        hot = [(int(n), int(k)) for n, k in zip(name, kinds, strict=True) if int(n) in spread] if spread else []
        out, w, p = [], 0, 0
        for number, a, b in zip(pdf["block"], words, pairs, strict=True):
            mine = word_at[w : w + len(a)]
            out.append((int(number), int(pdf["part"].iloc[0]), _bytes(word_total[mine].astype("<i8")), _bytes(types[mine].astype("<i8")), _bytes(pair_total[pair_at[p : p + len(b)]].astype("<i8"))))
            w, p = w + len(a), p + len(b)
        rows = pd.DataFrame(out, columns=_ANSWER[:5])
        totals = [int(word_total.sum()), int((word_total > 0).sum()), *([x for pair in hot for x in pair])]
        rows["totals"] = [np.array(totals, np.uint64).astype(np.int64).tolist()] + [None] * (len(rows) - 1)
        return rows

    asked = blocks.mapInPandas(ask, "part int, block bigint, words binary, uni binary, high binary, low binary, bi binary, contexts binary, index binary")
    answers = asked.groupBy("part").applyInPandas(answer, "block bigint, part int, uni binary, types binary, bi binary, totals array<bigint>")
    answers = stored(answers, "answers")
    tokens = distinct = 0
    kinds: Counter[int] = Counter()
    # One short list for each part: totals and the words that were dealt in several ways.
    for (row,) in answers.filter("totals IS NOT NULL").select("totals").collect():
        tokens, distinct = tokens + row[0], distinct + row[1]
        for h, k in zip(row[2::2], row[3::2], strict=True):
            kinds[h % 2**64] += k
    # What was asked need not be on disk beside the answers on their way back.  Not right after the answers
    # were written: Spark's listeners still hold that plan then, and a plan that outlives a collection stays long.
    released(docs.sparkSession)

    def scored(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows = _rows(own["content"].iloc[0])
        block = Block([r[2] for r in rows])
        # What is left of the rows has no texts, and what the block before it took goes back to the system.
        rows = [r[:2] for r in rows]
        slim()
        words, pairs = block.parts(count, spread)
        uni, types, bi = (np.zeros(n, np.int64) for n in (len(words), len(words), len(pairs)))
        by_word, by_pair = _grouped(words, count), _grouped(pairs, count)
        for row in got.itertuples():
            uni[by_word(row.part)] = np.frombuffer(row.uni, "<i8")
            types[by_word(row.part)] = np.frombuffer(row.types, "<i8")
            bi[by_pair(row.part)] = np.frombuffer(row.bi, "<i8")
        for at, h in enumerate(block.hashes.tolist()):
            if h in kinds:
                types[at] = kinds[h]
        automaton = Automaton(block, uni, types, bi, tokens, distinct)
        model, base = automaton.traverse()
        ends = np.cumsum(block.sizes)
        starts = ends - block.sizes
        known = np.r_[0, np.cumsum(uni[block.tokens] > 0)]
        return pd.DataFrame(
            {
                "doc_id": pd.Series([r[0] for r in rows], dtype="object"),
                "training": [r[1] for r in rows],
                "n_tokens": block.sizes,
                "n_known": known[ends] - known[starts],
                "train_tokens": tokens,
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(model, starts),
            }
        )

    schema = f"doc_id {source_kind}, training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.drop("totals").groupBy("block")).applyInPandas(scored, schema)


_ASK = ["part", "block", "words", "uni", "high", "low", "bi", "contexts", "index"]
_ANSWER = ["block", "part", "uni", "types", "bi", "totals"]


class Automaton:
    """States and arcs over the words and bigrams of a block."""

    def __init__(self, block: Block, uni: np.ndarray, types: np.ndarray, bi: np.ndarray, tokens: int, distinct: int):
        self.block = block
        root = (uni + ADDED) / (tokens + ADDED * (distinct + 1))
        self.root = np.log10(root)
        context = np.maximum(uni, 1)
        share = np.where(uni > 0, DISCOUNT * types / context, 1.0)
        # A context whose bigrams were all seen elsewhere still backs off with some weight.
        share = np.where(share > 0, share, 1.0)
        self.failure = np.log10(share)
        first, second = block.first, block.second
        seen = (bi > 0) & (uni[first] > 0)
        arc = np.maximum(bi - DISCOUNT, 0) / context[first] + share[first] * root[second]
        keep = np.flatnonzero(seen)
        # Ascending, as the bigrams of a block are: the arcs of a state lie next to each other.
        self.arcs = first[keep] * len(block.hashes) + second[keep]
        self.weights = np.log10(arc[keep])
        self.states = uni > 0

    def step(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Weight of going on from each state with each token: its arc's, or that of the failure arc and the root's."""
        out = self.failure[states] + self.root[tokens]
        if len(self.arcs):
            key = states * len(self.block.hashes) + tokens
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            out = np.where(self.arcs[at] == key, self.weights[at], out)
        return out

    def traverse(self, length: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every token under the model and under its unigrams alone, ``length`` tokens at a time.

        The state is the last word where that is a context, else the root; it starts at the end of a text.
        """
        tokens, state = self.block.tokens, np.zeros(1, np.int64)
        out = np.empty(len(tokens))
        for start in range(0, len(tokens), length):
            some = tokens[start : start + length]
            out[start : start + length] = self.step(np.r_[state, some[:-1]], some)
            state = some[-1:]
        return out, self.root[tokens]


def _grouped(parts: np.ndarray, count: int):
    """Function from a part to the positions that belong to it, ascending."""
    order = np.argsort(parts, kind="stable")
    ends = np.searchsorted(parts[order], np.arange(count + 1))
    return lambda part: order[ends[part] : ends[part + 1]]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of their counts, and the place of each given key."""
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    distinct, at = np.unique(every, return_inverse=True)
    amount = np.concatenate(counts) if counts else np.zeros(0)
    return distinct, np.rint(np.bincount(at, amount, minlength=len(distinct))).astype(np.int64), at


def _bytes(x: np.ndarray) -> bytes:
    return x.tobytes()
