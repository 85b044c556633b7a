"""Repair of the turn structure of conversations by survivor-coalescence Viterbi (``survivors``).

A sound conversation has role initials ``(s?(ua)+)?``.  Every row may be kept
(free), given the role user or assistant (``rerole``) or deleted (``delete``), and
rows with empty text may be inserted anywhere (``insert``).  Blank and duplicate
rows must be deleted; an undeleted row whose text breaks off adds ``truncated``.
The cheapest edits are found, among equals those with the least text of initials
(K, R, D, I; ASCII order).  Where two paths at one place cost the same, neither
text is a beginning of the other (both hold one letter for each row, and another
insertion costs more), so the comparison is settled before what follows.

How it runs: one range exchange sorts all rows by conversation and place, so a
conversation of any length is shared by as many tasks as its rows fill.  Equal rows
are counted before, with a combine on the map side, and travel as one.  Which row is
the first with its role and text comes from a second aggregation, whose result
travels in the same exchange as marks.  A task walks through its rows:

* a conversation that begins and ends inside the task is repaired there;
* any other stretch (the first and last of a task, and every ``segment`` rows of a
  long conversation) becomes a segment with its cheapest edits from each state to
  each.  Segments of a conversation then pass through the same search in order,
  as single steps with texts for labels, without their turns; what the search
  chose is applied to the segments in parallel.

Contract: NULL in role or text is one space.  Rows are in order of turn, NULL
first, then role, then the SHA-256 of the text.  An empty role is no legal one:
such a row is deleted or given a role.  NULL conversation ids are one
conversation.  Equal rows are duplicates of each other.  Extra columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.llm.common import partitions, stored
from partonflow.llm.survivors import Survivors

#: States: nothing yet, after the system row, after user, after assistant; a conversation may end in ENDS.
BEGIN, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (BEGIN, ASSISTANT)
#: Where a row with this initial may stand: from these states to that one.
STEPS = {"s": ((BEGIN,), SYSTEM), "u": ((BEGIN, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\f\r"
#: Kinds of rows in the exchange: a mark of the first of its kind, a row, a mark that a conversation exists.
FIRST, ROW, EXISTS = range(3)
#: Rows and characters of a segment.
SEGMENT, SEGMENT_CHARS = 2048, 4 << 20


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def moves(self, initial: str, fault: str, copies: int = 1) -> list[tuple]:
        """(from, to, cost, letter, None) of one row, or of copies that must all go."""
        out = [(s, s, self.delete * copies, "D" * copies, None) for s in STATES]
        if fault not in ("blank", "duplicate"):
            extra = self.truncated if fault == "truncated" else 0
            for letter, cost, kinds in (("K", extra, initial), ("R", extra + self.rerole, "ua")):
                out += [(s, STEPS[k][1], cost, letter, None) for k in kinds if k in STEPS for s in STEPS[k][0]]
        return out

    def inserts(self) -> list[tuple]:
        return [(s, STEPS[k][1], self.insert, "I") for k in "ua" for s in STEPS[k][0]]

    def dominated(self, at: dict) -> list[int]:
        """States that cannot win: whatever follows them can follow the assistant state at less."""
        if ASSISTANT not in at:
            return []
        least = at[ASSISTANT][0]
        return [s for s, more in ((BEGIN, self.delete), (SYSTEM, 0)) if s in at and least + more < at[s][0]]


@dataclass
class Segment:
    """A stretch of one conversation."""

    conv: object
    rows: list[tuple] = field(default_factory=list)  # (role, text, fault, copies)
    n: int = 0
    chars: int = 0
    exists: bool = False
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    low_turn: int | None = None
    first_initial: str = ""
    last_initial: str = ""

    def add(self, turn: int | None, role: str, text: str, fault: str, copies: int = 1) -> None:
        initial = role[:1]
        self.n += copies
        self.illegal += copies - 1  # no initial may follow itself
        if self.rows:
            self.illegal += self.last_initial + initial not in LEGAL
        else:
            self.first_turn, self.first_initial = turn, initial
        if turn is not None and (not self.rows or turn != self.last_turn):
            self.turns += 1
            self.low_turn = turn if self.low_turn is None else self.low_turn
        self.last_turn, self.last_initial = turn, initial
        if fault:
            setattr(self, fault, getattr(self, fault) + copies)
        self.rows.append((role, text, fault, copies))
        self.chars += len(text)


class Repairer:
    def __init__(self, costs: Costs):
        self.costs, self.inserts = costs, costs.inserts()
        self._moves: dict[tuple[str, str], list[tuple]] = {}

    def search(self, rows: list[tuple], start: int, opening: bool) -> Survivors:
        """Survivors after ``rows``; ``opening``: insertions may come before the first."""
        found = Survivors(start)
        if opening:
            found.settle(self.inserts)
        for role, _, fault, copies in rows:
            key = (role[:1], fault)
            moves = self._moves.get(key) if copies == 1 else self.costs.moves(*key, copies)
            if moves is None:
                moves = self._moves[key] = self.costs.moves(*key)
            found.advance(moves, self.inserts, self.costs.dominated)
        return found

    def whole(self, rows: list[tuple]) -> tuple[int, str, str | None]:
        """(cost, letters, transcript) of a whole conversation."""
        found = self.search(rows, BEGIN, True)
        end = found.best(ENDS)
        letters = "".join(label for label, _ in found.path(end))
        return found.at[end][0], letters, transcript([(r, t, n) for r, t, _, n in rows], letters, BEGIN)

    def matrix(self, rows: list[tuple]) -> list[tuple[int, int, int, str]]:
        """(from, to, cost, letters) of the cheapest edits of a stretch."""
        out = []
        for start in STATES:
            found = self.search(rows, start, False)
            out += [(start, s, found.at[s][0], "".join(x for x, _ in found.path(s))) for s in found.at]
        return out


def transcript(rows: list[tuple], letters: str, state: int) -> str | None:
    """``role:text`` lines of the repaired rows (role, text, copies); None if none is left."""
    out, at, gone = [], 0, 0
    for letter in letters:
        if letter == "D":
            gone += 1
            if gone == rows[at][2]:
                at, gone = at + 1, 0
            continue
        role, text = ("", "") if letter == "I" else rows[at][:2]
        if letter == "K":
            state = STEPS[role[:1]][1]
        else:
            state = ASSISTANT if state == USER else USER
            role = ROLES["a" if state == ASSISTANT else "u"]
        at += letter != "I"
        out.append(f"{role}:{text}")
    return "\n".join(out) if out else None


COUNTS = ("blank", "duplicate", "truncated", "illegal")
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECES = (
    "whole boolean, transcript string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " segment string, rank struct<task:int,no:long>, n long, turns long, first_turn long, last_turn long, low_turn long,"
    " first_initial string, last_initial string, edits array<struct<start:int,stop:int,cost:long,letters:string>>,"
    " roles array<string>, texts array<string>, copies array<long>"
)


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _pieces(seg: Segment, whole: bool, tool: Repairer, task: int, no: int) -> dict:
    out = {"conv": seg.conv, "whole": whole} | {c: getattr(seg, c) for c in COUNTS}
    if whole:
        cost, audit, text = tool.whole(seg.rows)
        return out | {"gaps": gaps(seg.low_turn, seg.last_turn, seg.turns), "cost": cost, "audit": audit, "transcript": text}
    return out | {
        "segment": f"{task}-{no}", "rank": {"task": task, "no": no}, "n": seg.n, "turns": seg.turns,
        "first_turn": seg.first_turn, "last_turn": seg.last_turn, "low_turn": seg.low_turn,
        "first_initial": seg.first_initial, "last_initial": seg.last_initial,
        "edits": [dict(zip(("start", "stop", "cost", "letters"), e)) for e in tool.matrix(seg.rows)] if seg.rows else [],
        "roles": [r[0] for r in seg.rows], "texts": [r[1] for r in seg.rows], "copies": [r[3] for r in seg.rows],
    }


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 200 + len(row.get("transcript") or "") + sum(map(len, row.get("texts") or ()))
        if weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(spark_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def repair(
    rows: DataFrame, conversations: DataFrame | None = None, costs: Costs = Costs(),
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT,
) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its counts, cost and edits, and the repaired transcripts.

    ``conversations`` may add ids that must appear even without rows.  The first
    result has a row per conversation (conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, shared, transcript), the transcript as ``role:text`` lines,
    NULL if nothing is left.  Transcripts of ``shared`` conversations, those dealt to
    several tasks, are in the second result, in parts (conv_id, part, transcript).
    """
    spark = rows.sparkSession
    r = rows.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
    )
    body, digest = F.rtrim("text", F.lit(WHITE)), F.sha2("text", 256)
    told = r.withColumn("hash", digest).withColumn("blank", body == "")
    firsts = told.filter("NOT blank").groupBy("conv", "role", "hash").agg(F.min(F.struct("turn")).alias("t"))
    counted = r.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    streams = [
        counted.select("*", digest.alias("hash"), (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"), F.lit(ROW).alias("kind")),
        firsts.select("conv", F.col("t.turn").alias("turn"), "role", "hash", F.lit(FIRST).alias("kind")),
    ]
    if conversations is not None:
        streams.append(conversations.select(F.col(conv_id).alias("conv"), F.lit(EXISTS).alias("kind")).distinct())
    merged = streams[0]
    for more in streams[1:]:
        merged = merged.unionByName(more, allowMissingColumns=True)
    order = ["conv", "turn", "role", "hash"]  # a mark has the place of its row, so both are in one task
    ordered = merged.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "kind")
    kind = dict(rows.dtypes)[conv_id]
    schema = spark.createDataFrame([], f"conv {kind}, {PIECES}").schema
    arrow = _arrow(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tool, task, no = Repairer(costs), TaskContext.get().partitionId(), 0
        seg, edge, mark, taken = None, True, None, (*order, "kind", "text", "blank", "open", "n")
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in taken]
            for conv, at, who, hashed, what, said, blank, broken, n in zip(*columns):
                if seg is None or conv != seg.conv:
                    if seg is not None:
                        yield _pieces(seg, not edge, tool, task, no)
                        edge = False
                        no += 1
                    seg, mark = Segment(conv), None
                if what == EXISTS:
                    continue
                place = (at, who, hashed)
                if what == FIRST:
                    mark = place
                    continue
                if len(seg.rows) >= segment or seg.chars >= SEGMENT_CHARS:
                    yield _pieces(seg, False, tool, task, no)
                    no += 1
                    seg, edge = Segment(conv), True
                if blank or mark != place:
                    seg.add(at, who, "", "blank" if blank else "duplicate", n)
                    continue
                seg.add(at, who, said, "truncated" if broken else "")
                if n > 1:
                    seg.add(at, who, "", "duplicate", n - 1)
        if seg is not None:
            yield _pieces(seg, False, tool, task, no)

    pieces = stored(ordered.mapInArrow(lambda b: _batches(walk(b), arrow), schema), "dialogue-pieces")
    summary, parts = _joined(pieces.filter("NOT whole"), costs, kind)
    columns = ["conv", *[c.split()[0] for c in SUMMARY.split(", ")]]
    done = pieces.filter("whole").select(*columns, F.lit(False).alias("shared"), "transcript")
    found = done.unionByName(summary.select(*columns, F.lit(True).alias("shared"), F.lit(None).cast("string").alias("transcript")))
    return found.withColumnRenamed("conv", "conv_id"), parts.withColumnRenamed("conv", "conv_id")


def _joined(segments: DataFrame, costs: Costs, kind: str) -> tuple[DataFrame, DataFrame]:
    """Conversations made of segments: their summaries, and the transcripts of the segments."""
    spark = segments.sparkSession
    slim = segments.drop("roles", "texts", "copies", "whole", "transcript").repartition("conv").sortWithinPartitions("conv", "rank")
    schema = spark.createDataFrame([], f"conv {kind}, {SUMMARY}, segment string, part long, start int, letters string").schema
    arrow = _arrow(schema)

    def close(conv, found: Survivors, total: dict, part: int, letters: list[str]) -> Iterator[dict]:
        end = found.best(ENDS)
        for label, payload in found.path(end):
            letters.append(label)
            if payload is not None:
                yield {"conv": conv, "segment": payload[0], "part": part, "start": payload[1], "letters": label}
                part += 1
        counts = {c: total[c] for c in COUNTS}
        yield {"conv": conv, "gaps": gaps(total["low"], total["high"], total["turns"]), **counts, "cost": found.at[end][0], "audit": "".join(letters)}

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        inserts, found, conv = costs.inserts(), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if found is None or row["conv"] != conv:
                    if found is not None:
                        yield from close(conv, found, total, part, letters)
                    conv, found, part, letters = row["conv"], Survivors(BEGIN), 0, []
                    found.settle(inserts)
                    total = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None, "turns": 0, "last": None, "initial": None}
                for c in COUNTS:
                    total[c] += row[c]
                if not row["n"]:
                    continue
                total["illegal"] += total["initial"] is not None and total["initial"] + row["first_initial"] not in LEGAL
                total["turns"] += row["turns"] - (row["first_turn"] is not None and row["first_turn"] == total["last"])
                total["low"] = row["low_turn"] if total["low"] is None else total["low"]
                total["last"] = row["last_turn"]
                total["high"] = total["high"] if row["last_turn"] is None else row["last_turn"]
                total["initial"] = row["last_initial"]
                found.advance(
                    [(e["start"], e["stop"], e["cost"], e["letters"], (row["segment"], e["start"])) for e in row["edits"]],
                    (), costs.dominated,
                )
                for label, payload in found.emitted:
                    letters.append(label)
                    if payload is not None:
                        yield {"conv": conv, "segment": payload[0], "part": part, "start": payload[1], "letters": label}
                        part += 1
                found.emitted.clear()
        if found is not None:
            yield from close(conv, found, total, part, letters)

    decided = stored(slim.mapInArrow(lambda b: _batches(through(b), arrow), schema), "dialogue-decided")
    texts = spark.createDataFrame([], f"conv {kind}, part long, transcript string").schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch) -> Iterator[dict]:
            for r in batch.to_pylist():
                text = transcript(list(zip(r["roles"], r["texts"], r["copies"])), r["letters"], r["start"])
                if text is not None:
                    yield {"conv": r["conv"], "part": r["part"], "transcript": text}

        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                yield from _batches(made(batch.slice(at, 8)), _arrow(texts))

    edits = decided.filter("segment IS NOT NULL").select("segment", "conv", "part", "start", "letters")
    chosen = segments.select("segment", "roles", "texts", "copies").join(edits, "segment").mapInArrow(apply, texts)
    return decided.filter("segment IS NULL").select("conv", *[c.split()[0] for c in SUMMARY.split(", ")]), chosen


def digests(transcripts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of transcripts in parts, joined by a line end.

    A digest has to be taken in order; a task holds one part at a time, however long the conversation.
    """
    schema = transcripts.select("conv_id").withColumn("repaired_sha256", F.lit("")).schema
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            conv, state = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if state is not None and row["conv_id"] == conv:
                        state.update(b"\n")
                    else:
                        if state is not None:
                            yield {"conv_id": conv, "repaired_sha256": state.hexdigest()}
                        conv, state = row["conv_id"], hashlib.sha256()
                    state.update(row["transcript"].encode())
            if state is not None:
                yield {"conv_id": conv, "repaired_sha256": state.hexdigest()}

        yield from _batches(rows(), arrow)

    several = transcripts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return several.mapInArrow(run, schema)
