"""Byte-level BPE by prefixes, integer clustering and conversation repair, against libraries, brute force and SQL."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from fractions import Fraction
from math import floor

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import connect, difference
from pyspark.sql import functions as F

from partonflow.llm import byte_prefix, centroids, dialogue, queries
from partonflow.llm.dialogue import BEGIN, ENDS, Costs, Repairer
from partonflow.llm.survivors import Survivors

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CHARS = "aaabc '’stredvm llé\n\t \x1c\x1d\x85\xa0 ​日本語한국어🙂😀ab12३٣½²_-!?.,\r  ZÀ�́"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_prefix.PrefixCodec(RANKS, PATTERN, cache=500)


def some(rng, most):
    return "".join(rng.choice(CHARS) for _ in range(rng.randint(0, most)))


def unpacked(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_prefix_bpe_equals_library(codec, library):
    rng = random.Random(1)
    texts = [some(rng, 40) for _ in range(3000)]
    texts += ["x" * 300_000, " " * 70_000 + "\n" * 7000 + "ab", "a b" * 50_000, "".join(rng.choice("abcdeo") for _ in range(20_000)), "don't 'r 've", ""]
    for text in texts:
        ids = codec.encode(text)
        assert unpacked(ids) == library.encode_ordinary(text)
        assert codec.decode(ids).decode() == text
    assert codec.encode(None) == b""


def test_prefix_table_holds_the_encoding_of_every_prefix(codec, library):
    word = "unbelievablyinternationalization"
    table = byte_prefix.Prefixes(codec.ranks, word.encode())
    for n in range(1, len(word) + 1):
        assert table.last[n - 1] == codec.ranks.merged(word[:n].encode())[-1]


def test_prefix_tables_follow_appends_and_edits(codec, library):
    rng = random.Random(2)
    for _ in range(600):
        text = some(rng, 60)
        encoded = byte_prefix.Encoded(codec, text)
        for _ in range(3):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 5]))
            new = some(rng, 8)
            text = text[:a] + new + text[b:]
            encoded.replace(a, b, new)
            assert encoded.text == text and encoded.ids() == library.encode_ordinary(text)
        more = some(rng, 20)
        text += more
        encoded.append(more)
        assert encoded.ids() == library.encode_ordinary(text)


def test_an_edit_computes_few_entries(codec):
    rng = random.Random(3)
    word = "".join(rng.choice("abcdeo") for _ in range(50_000))
    table = byte_prefix.Prefixes(codec.ranks, word.encode())
    assert table.replace(20_000, 20_002, b"xyz") < 500
    assert table.ids() == byte_prefix.Prefixes(codec.ranks, (word[:20_000] + "xyz" + word[20_002:]).encode()).ids()


def test_prefix_bpe_query_and_odd_rows(spark, library):
    rows = {r["doc_id"]: r for r in queries.op11_byte_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        row = rows[d["doc_id"]]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "two words", "c"), (1, "two words", "c")], "doc_id long, text string, ids string")
    made = byte_prefix.decode(byte_prefix.encode(odd, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in made) == ["", "", "two words", "two words"]
    assert byte_prefix.encode(odd.limit(0), RANKS, PATTERN).count() == 0


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        d, k, n = (int(rng.integers(1, m)) for m in (9, 20, 50))
        wide = int(rng.choice([1, 3, 100, 1 << 20]))
        x, c = rng.integers(-wide, wide + 1, (n, d)), rng.integers(-wide, wide + 1, (k, d))
        distance = ((x[:, None] - c[None]) ** 2).sum(2)
        for exact in (False, True):
            at, best, _ = centroids.nearest(x.astype(object) if exact else x, centroids.Sorted.of(c.tolist(), exact))
            assert (at == distance.argmin(1)).all() and (best == distance.min(1)).all()


def test_nearest_rejects_most_of_many_centroids():
    rng = np.random.default_rng(1)
    c = rng.integers(-400, 400, (200, 8)) + rng.integers(-3000, 3000, (200, 1))
    x = c[rng.integers(0, 200, 2000)] + rng.integers(-20, 20, (2000, 8))
    assert centroids.nearest(x, centroids.Sorted.of(c.tolist(), False))[2] < 0.1 * 200 * 2000


def lloyd(rows, d, scale, k, rounds, seed):
    kept = [(i, [floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    text = lambda i: "" if i is None else str(i)
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{text(r[0])}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for n in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == n]
            if mine:
                cents[n] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), cents


@pytest.mark.parametrize("big", [False, True])
def test_clusters_equal_brute_force_on_odd_vectors(spark, big):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.1, 2.0]) for _ in range(3)], "x") for i in range(40)]
    rows += [(5, rows[5][1], "x"), (5, [0.1, 0.1, 0.1], "x"), (None, [0.5, 0.5, 0.5], "x"), (None, [0.5, 0.5, 0.5], "x")]
    rows += [(90, None, "x"), (91, [], "x"), (92, [1.0, None, 1.0], "x"), (93, [1.0, float("nan"), 1.0], "x"), (94, [1.0, float("inf"), 1.0], "x"), (95, [1.0, 2.0], "x")]
    if big:
        rows += [(200, [1e300, -1e300, 5e-324], "x"), (201, [1e9, -3e8, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    found, cents = centroids.cluster(df, dimension=3, k=5, rounds=4)
    expected, exact = lloyd([(i, v) for i, v, _ in rows], 3, 1024, 5, 4, 3)
    assert cents == exact
    got = found.collect()
    fits = lambda x: x if x < 2**63 else None
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == sorted(((i, c, fits(d)) for i, c, d in expected), key=repr)
    assert {r["inertia"] for r in got} == {fits(sum(d for _, _, d in expected))}
    for r in got:
        assert r["cluster_inertia"] == fits(sum(d for _, c, d in expected if c == r["cluster"]))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, exact[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    found, cents = centroids.cluster(df, dimension=2)
    assert cents == [[512, 512], [512, 512]] and [(r["cluster"], r["distance"], r["inertia"]) for r in found.collect()] == [(0, 0, 0)] * 2
    empty, none = centroids.cluster(df.limit(0), dimension=2)
    assert empty.count() == 0 and none == []
    assert empty.columns == found.columns


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_conversation_repair"])
@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_queries_equal_sql(spark, name, scale):
    path = f"/root/testdata/sf{scale}"
    assert difference(queries.queries()[name](spark, path), connect(path), queries.oracle_sql()[name]) is None


def all_edits(rows):
    """The cheapest edits by trying all; (cost, letters)."""
    best = None

    def go(k, out, cost, letters):
        nonlocal best
        if best and cost > best[0]:
            return
        for ins in ("", "u", "a", "ua", "au"):
            o, c, x = out + ins, cost + 5 * len(ins), letters + "I" * len(ins)
            if k == len(rows):
                if re.fullmatch(r"(s?(ua)+)?", o) and (best is None or (c, x) < best):
                    best = (c, x)
                continue
            initial, fault = rows[k]
            go(k + 1, o, c + 2, x + "D")
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                if initial:
                    go(k + 1, o + initial, c + late, x + "K")
                for z in "ua":
                    go(k + 1, o + z, c + late + 1, x + "R")

    go(0, "", 0, "")
    return best


def plain_table(rows, costs=Costs()):
    """The same by a table of whole strings, for longer conversations."""

    def closed(best):
        changed = True
        while changed:
            changed = False
            for s, t, c, letter in costs.inserts():
                if s in best and (t not in best or (best[s][0] + c, best[s][1] + letter) < best[t]):
                    best[t], changed = (best[s][0] + c, best[s][1] + letter), True
        return best

    best = closed({BEGIN: (0, "")})
    for initial, fault in rows:
        new = {}
        for s, t, c, letter, _ in costs.moves(initial, fault):
            if s in best:
                new[t] = min(new.get(t, (1 << 60, "")), (best[s][0] + c, best[s][1] + letter))
        best = closed(new)
    return min(best[s] for s in ENDS if s in best)


FAULTS = ["", "", "", "truncated", "blank", "duplicate"]


def test_edits_are_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice(FAULTS)) for _ in range(rng.randint(0, 4))]
        assert plain_table(rows) == all_edits(rows)
        assert Repairer(Costs()).whole([(i, "x", f, 1) for i, f in rows])[:2] == all_edits(rows)


def test_segments_give_the_edits_of_the_whole():
    rng, tool = random.Random(6), Repairer(Costs())
    for _ in range(800):
        kinds, faults = rng.choice(["suaux", "u", "ua", "a", "uuuas"]), rng.choice([[""], ["", "truncated"], FAULTS])
        rows = [(rng.choice(kinds), "x", rng.choice(faults), 1) for _ in range(rng.randint(0, rng.choice([8, 40, 200])))]
        expected = plain_table([(r[0], r[2]) for r in rows])
        assert tool.whole(rows)[:2] == expected
        cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), rng.randint(0, 5))))
        found, letters = Survivors(BEGIN), ""
        found.settle(tool.inserts)
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            if a < b:
                found.advance([(s, e, c, x, a) for s, e, c, x in tool.matrix(rows[a:b])], (), tool.costs.dominated)
                found.flush()
                letters += "".join(x for x, _ in found.emitted)
                found.emitted.clear()
        end = found.best(ENDS)
        assert (found.at[end][0], letters + "".join(x for x, _ in found.path(end))) == expected


def test_search_keeps_only_what_is_unresolved():
    rng = random.Random(7)
    rows = [(rng.choice("suaua"), "x", rng.choice(FAULTS), 1) for _ in range(20_000)]
    found = Repairer(Costs()).search(rows, BEGIN, True)
    assert found.unresolved() < 200 and len(found.emitted) > 19_000


def judged(rows):
    """(counts, rows for plain_table, kept texts) of one conversation's ordered rows."""
    seen, out = set(), []
    for _, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        body = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


@pytest.mark.parametrize("segment", [2048, 3])
def test_repair_of_odd_and_long_conversations(spark, segment):
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["Yes.", "no", "", None, " \t", "Why?", "Hm…", "Well!\x0b"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts), "y") for c in [*range(30), None] for t in [None, None, 0, 1, 1, 2, 5]]
    rows += [(77, t, "user" if t % 3 else "assistant", f"Line {t % 700}.", "y") for t in range(3000)]  # one conversation over all tasks
    rows += [(78, 4, "user", "same.", "y")] * 500 + [(79, 0, "user", "", "y")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    also = spark.createDataFrame([(78,), (1000,), (None,)], "conv_id long")
    found, parts = dialogue.repair(df, also, segment=segment)
    got = {r["conv_id"]: r for r in found.collect()}
    pieces = {}
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        pieces.setdefault(r["conv_id"], []).append(r["transcript"])
    digests = {r["conv_id"]: r["repaired_sha256"] for r in dialogue.digests(parts).collect()}
    assert set(got) == {*range(30), None, 77, 78, 79, 1000}
    for conv, row in got.items():
        mine = [(t, r, x) for c, t, r, x, _ in rows if c == conv]
        key = lambda m: (m[0] is not None, m[0] or 0, m[1] or (" " if m[1] is None else ""), hashlib.sha256((" " if m[2] is None else m[2]).encode()).hexdigest())
        mine.sort(key=key)
        rated = judged(mine)
        cost, audit = plain_table([(r[:1], f) for r, _, f in rated])
        assert (row["cost"], row["audit"]) == (cost, audit), conv
        turns = [t for t, _, _ in mine if t is not None]
        assert row["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        for kind in ("blank", "duplicate", "truncated"):
            assert row[kind] == sum(f == kind for _, _, f in rated)
        initials = [r[:1] for r, _, _ in rated]
        assert row["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = dialogue.transcript([(r, x, 1) for r, x, _ in rated], audit, BEGIN)
        whole = "\n".join(pieces[conv]) if conv in pieces else row["transcript"]
        assert whole == text
        if conv in pieces:
            assert row["shared"] and digests[conv] == hashlib.sha256(text.encode()).hexdigest()
    empty = dialogue.repair(df.limit(0))[0]
    assert empty.count() == 0 and df.filter(F.col("conv_id") == -1).count() == 0
