"""BPE encoding and decoding by tree concatenation.

A text is cut into pretokens (the tokenizer's own split) and every pretoken is
encoded by the tokenizer's merges.  Two kinds of long input are encoded in
halves that are joined afterwards:

* a pretoken that the split leaves whole ("unsplit" text, say 100,000 letters
  without a space) is halved until the parts are short; at each join the last
  tokens of the left and the first tokens of the right half are encoded again,
  over a window that doubles until its outermost tokens equal those of both
  halves.  A sequence of BPE tokens is the encoding of its text exactly when
  every two neighbours are the encoding of theirs, and all neighbours then are.
* a document longer than ``piece_chars`` is cut into rows that different tasks
  encode; the rows of a document are joined as a tree.  A join splits a window
  of pretokens around the seam anew, and the window doubles until one pretoken
  boundary on either side is the same as in that side and lies far enough from
  the window's end not to depend on what follows.

Contract: ``encode`` adds a binary column of ids, unsigned 32-bit little
endian.  NULL and empty texts give no ids.  Other columns pass through and rows
may repeat.  The literal of an added token in a text becomes its id, as in the
tokenizers library.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.llm.common import by_size, partitions

#: White space of the tokenizers' expressions, and the split of byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
BYTE_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
#: The same for texts of PLAIN characters only, where Python's classes agree with Unicode's.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]*")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: An added token or a contraction can reach this many characters over a boundary.
REACH, CONTRACTION = 12, 4


class Vocabulary(dict):
    """Short pretokens and their packed ids: the last ``limit`` new ones, and those of the ``limit`` before that came again."""

    def __init__(self, codec: ByteCodec, limit: int):
        super().__init__()
        self.codec, self.limit, self.old = codec, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.codec.encode_word(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteCodec:
    """A byte-level BPE tokenizer file, encoded pretoken by pretoken."""

    def __init__(self, path: str, chunk: int = 2048, cache: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk = chunk
        with open(path, encoding="utf-8") as file:
            added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        self.strings = {i: s for s, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.symbol = _byte_symbols()
        back = {ord(c): b for b, c in enumerate(self.symbol)}
        size = max([*self.strings, *added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for i, s in self.strings.items():
            self.bytes[i] = bytes(back[ord(c)] for c in s)
        self.symbols = dict(enumerate(self.symbol))
        self.added = {s: _packed([i]) for s, i in added.items()}
        for s, i in added.items():
            self.bytes[i] = s.encode()
        self.seams = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.general = regex.compile(BYTE_SPLIT)
        self.words = Vocabulary(self, cache)

    def split(self, text: str) -> list[str]:
        """Pretokens, with the literals of added tokens as pretokens of their own."""
        parts = self.seams.split(text) if self.seams else [text]
        if len(parts) == 1:
            return self._split(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self._split(part))]

    def _split(self, text: str) -> list[str]:
        return (PLAIN_SPLIT if PLAIN.fullmatch(text) else self.general).findall(text)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text))) if text else b""

    def encode_word(self, word: str) -> bytes:
        if word in self.added:
            return self.added[word]
        return _packed(self.tree(word.encode("utf-8").decode("latin-1").translate(self.symbols)))

    def tree(self, symbols: str) -> list[int]:
        """Ids of one pretoken: short ones directly, long ones as two joined halves."""
        if len(symbols) <= self.chunk:
            return [t.id for t in self.tokenizer.model.tokenize(symbols)] if symbols else []
        middle = len(symbols) // 2
        return self.join_ids(self.tree(symbols[:middle]), self.tree(symbols[middle:]))

    def join_ids(self, left: list[int], right: list[int], width: int = 8) -> list[int]:
        """Encoding of the concatenated text of two encodings of parts of one pretoken."""
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            text = "".join(self.strings[i] for i in left[a:] + right[:b])
            ids = [t.id for t in self.tokenizer.model.tokenize(text)]
            if (a == 0 or ids[0] == left[a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return left[:a] + ids + right[b:]
            width *= 2

    def part(self, text: str) -> tuple[list[str], list[bytes]]:
        words = self.split(text)
        return words, [self.words[w] for w in words]

    def join_parts(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple:
        """Pretokens and ids of the concatenation of two parts of a text."""
        (lw, li), (rw, ri) = left, right
        if not lw or not rw:
            return (lw or rw), (li or ri)
        width = 4
        while True:
            a, b = max(0, len(lw) - width), min(len(rw), width)
            before, after = "".join(lw[a:]), "".join(rw[:b])
            words = self.split(before + after)
            kept = 0 if a == 0 or (_anchored(before) and words[0] == lw[a]) else -1
            if kept == 0 and b < len(rw):
                kept = self._common_boundary(words, rw[:b], len(before), before + after)
            elif kept == 0:
                kept = (len(words), len(rw))
            if kept not in (0, -1):
                n, m = kept
                return lw[:a] + words[:n] + rw[m:], li[:a] + self._ids(words[:n], lw, li, rw, ri, len(before)) + ri[m:]
            width *= 2

    def _common_boundary(self, words: list[str], right: list[str], seam: int, text: str):
        """(pretokens of the window, pretokens of the right part) before the last common safe boundary, or 0."""
        ends, at = {}, seam
        for m, w in enumerate(right):
            ends[at] = m
            at += len(w)
        found, at = 0, 0
        for n, w in enumerate(words):
            if at >= seam and at in ends and _anchored(text[at:]):
                found = (n, ends[at])
            at += len(w)
        return found

    def _ids(self, words, lw, li, rw, ri, seam: int) -> list[bytes]:
        """Ids of the window's pretokens; a long one made of one pretoken of each side joins their ids."""
        out, at = [], 0
        for w in words:
            if len(w) > self.chunk and at < seam < at + len(w) and lw[-1] + rw[0] == w:
                ids = self.join_ids(np.frombuffer(li[-1], "<u4").tolist(), np.frombuffer(ri[0], "<u4").tolist())
                out.append(_packed(ids))
            else:
                out.append(self.words[w])
            at += len(w)
        return out

    def join_all(self, texts: list[str]) -> bytes:
        """Ids of the concatenation of ``texts``, joined pairwise."""
        return self.join_tree([self.part(t) for t in texts])

    def join_tree(self, parts: list[tuple[list[str], list[bytes]]]) -> bytes:
        while len(parts) > 1:
            parts = [self.join_parts(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return b"".join(parts[0][1]) if parts else b""

    def decode(self, ids: bytes | None) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _anchored(text: str) -> bool:
    """Whether a boundary just before ``text`` cannot depend on what follows ``text``."""
    head = text[:-REACH]
    return len(head) >= CONTRACTION and not head.isspace()


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


@lru_cache(maxsize=4)
def codec(path: str, chunk: int = 2048) -> ByteCodec:
    """One codec per worker and file."""
    return ByteCodec(path, chunk)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", piece_chars: int = 32_768) -> DataFrame:
    """``docs`` with the ids of ``text``.  Documents above ``piece_chars`` are shared out among tasks."""
    source = docs.drop(ids)
    size = F.coalesce(F.length(text), F.lit(0))
    schema = f"{_ddl(source)}, `{ids}` binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a, b in by_size(texts):
                rows = batch.slice(a, b - a)
                made = pa.array([tool.encode(t) for t in texts[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, made], names=[*rows.schema.names, ids])

    short = source.filter(size <= piece_chars).mapInArrow(whole, schema)

    # Equal texts have equal ids, so pieces are keyed by the digest of their text and encoded once per document.
    long = source.filter(size > piece_chars).withColumn("_key", F.sha2(F.col(text), 256))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, whole in zip(batch["_key"], batch["t"]):
                for i, at in enumerate(range(0, len(whole), piece_chars)):
                    yield pd.DataFrame({"_key": [key], "i": [i], "t": [whole[at : at + piece_chars]]})

    pieces = long.dropDuplicates(["_key"]).select("_key", F.col(text).alias("t")).mapInPandas(cut, "_key string, i int, t string")

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = codec(path)
        for batch in batches:
            for key, i, t in zip(batch["_key"], batch["i"], batch["t"]):
                words, made = tool.part(t)
                sizes = np.array([list(map(len, words)), list(map(len, made))], dtype="<i4").reshape(2, -1)
                yield pd.DataFrame({"_key": [key], "i": [i], "t": [t], "ids": [b"".join(made)], "sizes": [sizes.tobytes()]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        tool = codec(path)
        pdf = pdf.drop_duplicates("i").sort_values("i")
        parts = []
        for t, made, sizes in zip(pdf["t"], pdf["ids"], pdf["sizes"]):
            ends = np.frombuffer(sizes, "<i4").reshape(2, -1).cumsum(axis=1).tolist()
            parts.append(tuple([whole[a:b] for a, b in zip([0, *e], e)] for whole, e in zip((t, made), ends)))
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1], ids: [tool.join_tree(parts)]})

    encoded = pieces.repartition(partitions(docs.sparkSession), "_key", "i").mapInPandas(one, "_key string, i int, t string, ids binary, sizes binary")
    whole_ids = encoded.groupBy("_key").applyInPandas(joined, f"_key string, `{ids}` binary")
    return short.unionByName(long.join(whole_ids, "_key").drop("_key"))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids``; bytes that are not UTF-8 become U+FFFD.  NULL ids give an empty text."""
    source = rows.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            for a, b in by_size(packed):
                part = batch.slice(a, b - a)
                made = pa.array([tool.decode(x) for x in packed[a:b]], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, text])

    return source.mapInArrow(run, f"{_ddl(source)}, `{text}` string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
