"""Main text of web pages, with a suffix array over the pages of a host.

A page is read as blocks of text, each in a zone: inside the page's declared
article, inside declared furniture (menus, headers, footers, sidebars, notices,
adverts, forms, comments), or open.  For the blocks outside the article the
token streams of a host's pages are concatenated and a suffix array is built;
neighbours in it with a common prefix of RUN tokens or more that stand on
distinct pages are boilerplate, and tokens covered by such runs are removed from
open blocks.  What remains of open blocks, the unique runs, is kept beside the
article.  Text inside a declared article stays whole, because articles may
quote each other; declared furniture goes whole, because it may be unique.

A suffix array is built over the pages that a task reads, per host.  A run that
it finds, known by the hash of its first RUN tokens, is sent with the smallest
and largest page it stands on, so the pages of a large host need not meet: runs
are merged by host and hash, one row for each run and task.

Contract: NULL html and html without text give an empty text.  Rows may repeat;
equal rows count as one page.  Unclosed tags, comments and entities are read as
far as they go.  Other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.llm.common import mix64, stored, unused

#: Tokens of the shortest repeated run that counts as boilerplate.
RUN = 6

#: Elements of HTML by what they mean for the main text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "title", "noframes", "xmp"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr",
}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "figure", "fieldset"}
MAIN = {"article", "main"}
#: Words in class, id and role that name furniture or the main text.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed)?|promos?|promotions?|nav|navbar|navigation|menus?|"
    r"breadcrumbs?|header|masthead|footer|sidebars?|aside|widgets?|comments?|replies|respond|disqus|cookies?|consent|notices?|gdpr|popups?|modals?|"
    r"overlays?|newsletters?|subscribe|signup|login|search|share|sharing|social|related|recommended|pagination|pager|toolbar|alerts?|complementary|contentinfo)(?:$|[\s_-])"
)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|main|main-content|post-content|entry-content|article-body|story-body)(?:$|[\s])")

_tag = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(>|\Z)",
    re.S,
)
_attribute = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

ARTICLE, OPEN, DROPPED = 0, 1, 2


def _names(attributes: str) -> tuple[str, bool]:
    """Class, id and role of an element, and whether it is hidden."""
    if "=" not in attributes and "hidden" not in attributes:
        return "", False
    names, hidden = [], False
    for m in _attribute.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id", "role"):
            names.append(re.sub(r"[:.]", " ", value))
        elif key == "hidden" or value == "true":
            hidden = True
    return " ".join(names), hidden


def blocks(source: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order; texts are trimmed and none is empty."""
    if not source:
        return []
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements, with the zone inside
    zone, buffer, at = OPEN, [], 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((zone, text))
            buffer.clear()

    def pop(to: int) -> None:
        nonlocal zone
        del stack[to:]
        new = stack[-1][1] if stack else OPEN
        if new != zone:
            flush()
            zone = new

    size = len(source)
    while at < size:
        m = _tag.search(source, at)
        if m is None:
            buffer.append(source[at:])
            break
        buffer.append(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if m[1] or m[5]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        if name in VOID:
            continue
        attributes = m[3] if m[2] else m[7]
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size
            continue
        # Elements that end where the next of their kind begins.
        if name == "p" or name not in INLINE:
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section"):
                    break
        names, hidden = _names(attributes)
        inner = zone
        if name not in ("html", "body"):
            if zone != DROPPED and (hidden or name in FURNITURE - {"head", "figure"} or name == "head" or (names and NAMES.search(names) and not (name in MAIN))):
                inner = DROPPED
                # A page's own heading may stand in a header inside its article.
                if name == "header" and zone == ARTICLE and not hidden:
                    inner = ARTICLE
            elif zone == OPEN and (name in MAIN or (names and CONTENT.search(names))):
                inner = ARTICLE
        stack.append((name, inner))
        if inner != zone:
            flush()
            zone = inner
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of numbers, by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:]
        order = np.lexsort((after, rank))
        change = np.r_[0, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change)
        width *= 2
        if n == 0 or rank[order[-1]] == n - 1 or width >= max(n, 2):
            return order


def common_prefix(tokens: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the array, up to ``limit``."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[1:], order[:-1]
    alive = np.ones(len(a), bool)
    for k in range(limit):
        inside = (a + k < len(tokens)) & (b + k < len(tokens))
        alive &= inside
        alive[alive] = tokens[a[alive] + k] == tokens[b[alive] + k]
        out[1:][alive] = k + 1
    return out


def _token_hashes(text: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in text.encode("utf-8", "replace").split()], np.int64)


def _run_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hash of the RUN tokens that start at each position that has as many."""
    n = len(tokens) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = tokens[:n].astype(np.uint64)
    for k in range(1, RUN):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n].astype(np.uint64))
    return out.astype(np.int64)


def repeated_runs(streams: dict[int, list[np.ndarray]]) -> list[tuple[int, int, int]]:
    """(hash, smallest page, largest page) of every run of RUN tokens in the streams of a host's pages."""
    pieces, pages, stop = [], [], -1
    for page, parts in streams.items():
        for tokens in parts:
            if len(tokens) >= RUN:
                # A separator of its own ends each block, so that no run crosses it.
                pieces += [tokens, np.array([stop])]
                pages += [np.full(len(tokens), page), np.array([page])]
                stop -= 1
    if not pieces:
        return []
    tokens, page = np.concatenate(pieces), np.concatenate(pages)
    order = suffix_array(tokens)
    # An interval of the array whose neighbours share RUN tokens is one run.
    start = np.flatnonzero(common_prefix(tokens, order, RUN) < RUN)
    low, high = np.minimum.reduceat(page[order], start), np.maximum.reduceat(page[order], start)
    first = order[start]
    negative = np.flatnonzero(tokens < 0)
    whole = negative[np.searchsorted(negative, first)] - first >= RUN
    hashes = np.zeros(len(tokens), np.int64)
    made = _run_hashes(tokens)
    hashes[: len(made)] = made
    return list(zip(hashes[first[whole]].tolist(), low[whole].tolist(), high[whole].tolist(), strict=True))


#: Columns that the steps below add.
PRIVATE = {"_host", "_page", "_main", "_parts", "_row", "_covered", "host", "run", "row"}


def extract(pages: DataFrame, url: str = "url", source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``source``.

    A column of the input that has the name ``text``, in whatever case, is replaced; all others pass through.
    """
    own = {c: unused(f"_own_{c}", pages.columns) for c in pages.columns if c.lower() in PRIVATE and c not in (url, source)}
    found = _extract(pages.withColumnsRenamed(own), url, source, text)
    return found.withColumnsRenamed({there: c for c, there in own.items()})


def _extract(pages: DataFrame, url: str, source: str, text: str) -> DataFrame:
    host = F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))
    # A page is known by a hash of its content, so that a repeated row is no other page.
    keyed = pages.drop(text).withColumn("_host", host).withColumn("_page", F.xxhash64(F.col(url), F.col(source)))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts: dict[str, dict[int, list[np.ndarray]]] = {}
            for name, page, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                streams = hosts.setdefault(name, {})
                if page not in streams:
                    streams[page] = [_token_hashes(t) for zone, t in blocks(content) if zone != ARTICLE]
            rows = [(name, *run) for name, streams in hosts.items() for run in repeated_runs(streams)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "run", "low", "high"]
            )

    found = keyed.select("_host", "_page", source).mapInArrow(runs, "host string, run bigint, low bigint, high bigint")
    shared = found.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high").select("host", "run")
    shared = stored(shared, "runs")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main, parts = [], []
            for content in batch.column(batch.schema.get_field_index(source)):
                kept = [(zone, t) for zone, t in blocks(content.as_py()) if zone != DROPPED]
                opened = any(zone == OPEN for zone, _ in kept)
                main.append(None if opened else " ".join(t for _, t in kept))
                parts.append([{"zone": z, "text": t} for z, t in kept] if opened else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(main, pa.string()), pa.array(parts, pa.list_(pa.struct([("zone", pa.int32()), ("text", pa.string())])))],
                names=[*batch.schema.names, "_main", "_parts"],
            )

    parsed = keyed.mapInArrow(read, f"{kinds}, _main string, _parts array<struct<zone:int, text:string>>")
    # Only pages with open blocks meet the runs of their host.
    closed = parsed.filter("_parts IS NULL").select(*keyed.drop("_host", "_page").columns, F.col("_main").alias(text))
    if not parsed.filter("_parts IS NOT NULL").limit(1).count():
        return closed
    return closed.unionByName(_without_runs(parsed.filter("_parts IS NOT NULL"), shared, text).select(*closed.columns))


def _without_runs(pages: DataFrame, shared: DataFrame, text: str) -> DataFrame:
    """Text of pages with open blocks, without the tokens of open blocks that a shared run covers."""
    pages = stored(pages.withColumn("_row", F.monotonically_increasing_id()), "open_pages")

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, row, run, block, at = [], [], [], [], []
            for name, number, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, part in enumerate(parts):
                    if part["zone"] == OPEN:
                        made = _run_hashes(_token_hashes(part["text"])).tolist()
                        host += [name] * len(made)
                        row += [number] * len(made)
                        run += made
                        block += [k] * len(made)
                        at += range(len(made))
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(row, pa.int64()), pa.array(run, pa.int64()), pa.array(block, pa.int32()), pa.array(at, pa.int32())],
                names=["host", "row", "run", "block", "at"],
            )

    asked = pages.select("_host", "_row", "_parts").mapInArrow(positions, "host string, row bigint, run bigint, block int, at int")
    covered = asked.join(shared, ["host", "run"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("block", "at")).alias("_covered"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for parts, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone: dict[int, set[int]] = {}
                for s in spans or ():
                    gone.setdefault(s["block"], set()).update(range(s["at"], s["at"] + RUN))
                kept = []
                for k, part in enumerate(parts):
                    # Tokens are split as for hashing, at ASCII white space; blocks hold single spaces only.
                    words = part["text"].encode().split()
                    kept += [w for i, w in enumerate(words) if i not in gone.get(k, ())]
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", text])

    joined = pages.join(covered, pages["_row"] == covered["row"], "left").select("_row", "_parts", "_covered")
    return pages.join(joined.mapInArrow(cut, f"_row bigint, `{text}` string"), "_row")
