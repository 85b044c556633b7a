"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a pretoken one token is stored: the last token of that
prefix's encoding.  It is found among the tokens that end there, all given by an
Aho-Corasick pass over the bytes: the one token that stands right after the
stored last token of the prefix before it.  "Stands right" means that the two
tokens together are the encoding of their joined bytes; a sequence of tokens is
the encoding of its bytes exactly when that holds for all neighbours, so no
prefix has two such tokens.  Walking back from the end gives the ids.

The table makes two updates exact and cheap:

* ``Prefixes.append`` adds bytes and leaves all earlier entries as they are;
* ``Prefixes.replace`` computes entries from the edit on, until as many entries
  in a row as the longest token has bytes agree with the old ones; all later ones
  depend on nothing else and are kept.

``Encoded`` lifts both to texts: pretokens are split anew from a few characters
before an edit until the old split is met again, and a pretoken that only grew
or changed inside keeps its table.

Contract: ``encode`` adds a binary column of ids, unsigned 32-bit little endian,
and on request the decoded bytes of those ids.  NULL and empty texts give no ids.
Other columns pass through, rows may repeat, ids of rows do not matter.  A text is
read slice by slice, cut where a space follows other characters (always a
pretoken boundary), so that memory is bounded by the text and its ids.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from partonflow.llm.bpe import PLAIN, PLAIN_SPLIT
from partonflow.llm.common import by_size

#: White space as Unicode defines it; ``\s`` of Python also takes four separators of ASCII.
UNICODE_SPACE = r"\p{White_Space}"
#: No token stands here.
NONE = 0xFFFFFFFF
#: A place inside a text where two pretokens always part.
CUT = re.compile(r"(?<=\S) ")


class Ranks:
    """A vocabulary of byte strings whose ids are the order of their merges."""

    def __init__(self, tokens: dict[bytes, int], remembered: int = 400_000):
        import ahocorasick

        self.tokens = tokens
        self.bytes = {i: t for t, i in tokens.items()}
        self.longest = max(map(len, tokens), default=1)
        self.matcher = ahocorasick.Automaton()
        for token, i in tokens.items():
            self.matcher.add_word(token.decode("latin-1"), (i, len(token)))
        self.matcher.make_automaton()
        self.remembered = remembered
        self.known: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids of a short byte string by its merges, lowest rank first and leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.tokens.get
        ranks = [rank(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NONE:
            at = ranks.index(best)
            joined = parts[at] + parts[at + 1]
            parts[at : at + 2] = [joined]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + joined, NONE)
            if at < len(ranks):
                ranks[at] = rank(joined + parts[at + 1], NONE)
        return [self.tokens[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether the merges lead to the token at all."""
        if token not in self._alone:
            self._alone[token] = self.merged(self.bytes[token]) == [token]
        return self._alone[token]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes."""
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            joined = self.bytes[left] + self.bytes[right]
            whole = self.tokens.get(joined)
            known = (whole is None or not self.reachable(whole)) and self.merged(joined) == [left, right]
            self.known[key] = known
        return known


class Prefixes:
    """The last token of every prefix of one pretoken."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", array("I")
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; earlier entries stay."""
        done = len(self.data)
        self.data += data
        self._fill(self.data, self.last, done, len(self.data))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of the bytes [start, stop); returns how many entries were computed."""
        old, shift = self.last, len(data) - (stop - start)
        changed = self.data[:start] + data + self.data[stop:]
        last, edited, step = old[:start], start + len(data), max(32, self.ranks.longest)
        at = start
        while at < len(changed):
            end = min(len(changed), max(edited, at + step))
            self._fill(changed, last, at, end)
            at = end
            same = at - self.ranks.longest
            if same >= edited and last[same:at] == old[same - shift : at - shift]:
                break
        self.data, self.last = changed, last + old[at - shift :]
        return at - start

    def _fill(self, data: bytes, last: array, start: int, stop: int) -> None:
        """Entries [start, stop); those before are there."""
        ranks = self.ranks
        known, neighbours, base = ranks.known.get, ranks.neighbours, max(0, start - ranks.longest + 1)
        last.extend(array("I", [NONE]) * (stop - start))
        for end, (token, length) in ranks.matcher.iter(data[base:stop].decode("latin-1")):
            end += base
            if end < start or last[end] != NONE:
                continue
            before = end - length
            if before < 0:
                if ranks.reachable(token):
                    last[end] = token
                continue
            left = last[before]
            if left != NONE:
                right = known(left << 32 | token)
                if right or (right is None and neighbours(left, token)):
                    last[end] = token

    def ids(self) -> list[int]:
        """The encoding of the whole; a pretoken that is a token of its own is that token."""
        whole = self.ranks.tokens.get(self.data)
        if whole is not None:
            return [whole]
        out, at, bytes_of = [], len(self.data) - 1, self.ranks.bytes
        while at >= 0:
            token = self.last[at]
            if token == NONE:
                raise ValueError(f"no token of the vocabulary ends at byte {at}")
            out.append(token)
            at -= len(bytes_of[token])
        return out[::-1]


class Words(dict):
    """Short pretokens and their ids: the last ``limit`` that were new, and those of the ``limit`` before that came again."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class PrefixCodec:
    """Texts to ids and back, pretoken by pretoken."""

    def __init__(self, path: str, pattern: str, cache: int = 200_000):
        with open(path, "rb") as file:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
        self.ranks = Ranks(tokens)
        self.general = regex.compile(pattern.replace(r"[^\s", "[^" + UNICODE_SPACE).replace(r"\s", UNICODE_SPACE).replace(r"\S", "[^" + UNICODE_SPACE + "]"))
        import public_tokenizers

        self.plain = pattern == public_tokenizers.PATTERN
        self.words = Words(self.word, cache)

    def split(self, text: str) -> list[str]:
        """Pretokens; plain texts by an equivalent expression of the faster library."""
        return (PLAIN_SPLIT if self.plain and PLAIN.fullmatch(text) else self.general).findall(text)

    def word(self, word: str) -> bytes:
        """Packed ids of one pretoken."""
        data = word.encode()
        whole = self.ranks.tokens.get(data)
        return packed(Prefixes(self.ranks, data).ids() if whole is None else [whole])

    def encode(self, text: str | None) -> bytes:
        return b"".join(b"".join(map(self.words.__getitem__, self.split(part))) for part in slices(text or ""))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


class Encoded:
    """A text with its encoding, kept exact under appends and edits."""

    def __init__(self, codec: PrefixCodec, text: str = ""):
        self.codec, self.text = codec, text
        self.parts = [Prefixes(codec.ranks, w.encode()) for w in codec.split(text)]
        self.words = codec.split(text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, text: str) -> None:
        """Put ``text`` in place of the characters [start, stop)."""
        shift = len(text) - (stop - start)
        changed = self.text[:start] + text + self.text[stop:]
        keep = at = 0
        # A pretoken depends on its own characters and at most two after it.
        while keep < len(self.words) and at + len(self.words[keep]) + 2 <= start:
            at += len(self.words[keep])
            keep += 1
        begin, ends, place = at, {}, at
        for k in range(keep, len(self.words) + 1):
            if place >= stop:
                ends[place + shift] = k
            place += len(self.words[k]) if k < len(self.words) else 0
        made, resume, split = [], len(self.words), self.codec.general
        for found in split.finditer(changed, begin):
            if found.start() in ends and found.start() >= start + len(text):
                resume = ends[found.start()]
                break
            made.append(found.group())
        self.parts[keep:resume] = self._tables(self.words[keep:resume], self.parts[keep:resume], made)
        self.words[keep:resume] = made
        self.text = changed

    def _tables(self, old: list[str], tables: list[Prefixes], new: list[str]) -> list[Prefixes]:
        """Tables of the new pretokens; the first of them takes over the table of the first old one."""
        out = [Prefixes(self.codec.ranks, w.encode()) for w in new[1:]]
        if new and old:
            a, b = old[0].encode(), new[0].encode()
            head = common(a, b)
            tail = min(common(a[::-1], b[::-1]), min(len(a), len(b)) - head)
            tables[0].replace(head, len(a) - tail, b[head : len(b) - tail])
            return [tables[0], *out]
        return [Prefixes(self.codec.ranks, w.encode()) for w in new]

    def ids(self) -> list[int]:
        return [i for part in self.parts for i in part.ids()]


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def slices(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before a space that follows another character."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> PrefixCodec:
    """One codec per worker, file and pattern."""
    return PrefixCodec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` by the rank file at ``path``; ``decoded`` names a column for the bytes of those ids.

    An input column with the name of a result is replaced.
    """
    made = [ids, *([decoded] if decoded else [])]
    source = docs.drop(*(c for c in made if c != text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for a, b in by_size(texts.to_pylist()):
                rows = batch.slice(a, b - a)
                encoded = [tool.encode(t) for t in texts.slice(a, b - a).to_pylist()]
                columns = [pa.array(encoded, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(tool.decode, encoded), pa.binary()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *made])

    return source.mapInArrow(run, _with(source, made))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that ``ids`` stand for; NULL ids give none.  An unknown id is an error."""
    source = rows.drop(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            packs = batch.column(batch.schema.get_field_index(ids))
            for a, b in by_size(packs.to_pylist()):
                part = batch.slice(a, b - a)
                made = pa.array([tool.decode(x) for x in packs.slice(a, b - a).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, decoded])

    return source.mapInArrow(run, _with(source, [decoded]))


def _with(df: DataFrame, made: list[str]) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}` binary" for c in made)])
