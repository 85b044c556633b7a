"""Operators on texts against brute force, on small hand-made tables and the smallest driver tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from partonflow.llm import bpe, components, fingerprint, html_extract, langid, line_dedup, lm_score, minhash, packing, queries, toxicity

SMALL = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, bins string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    long = "a b c d e f " * 3000
    texts = [None, "", "   \n\t ", "one", "one two three four five six", "one two three four five six", long, "q" * 9000, "é’日本 <|endoftext|> don't"]
    rows = [(k, t, "en", None, 1, 0.5, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id here at all", None, None, None, None, None)], DOCS)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_bpe_equals_library_and_round_trips(spark, odd):
    library = Tokenizer.from_file(BYTES)
    rows = bpe.decode(bpe.encode(odd, BYTES, piece_chars=500), BYTES).collect()
    assert len(rows) == odd.count()
    for row in rows:
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert ids == library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(odd.limit(0), BYTES).count() == 0


def test_bpe_joins_are_exact():
    rng, codec, library = random.Random(3), bpe.ByteCodec(BYTES, chunk=32), Tokenizer.from_file(BYTES)
    parts = ["abc", "the", " ", "  ", "\n", "'ll", "'", "123", "é", "<|endoftext|>", "<|end", "!!", "日本", "😀", "\x85", "a" * 40, "ing"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        real = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == real
        size = rng.choice([1, 5, 20, 60])
        assert np.frombuffer(codec.join_all([text[i : i + size] for i in range(0, len(text), size)]), "<u4").tolist() == real


def test_packing_is_whole_gapless_and_tight(spark, odd):
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(odd, WORDS, capacity=64).toPandas()
    expected = Counter(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    whole = rows[rows["piece"] == 0]
    assert len(whole) == odd.count() and rows["length"].sum() == sum(k * n for k, n in expected.items())
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert group["length"].sum() <= 64 and (group["offset"] == group["length"].cumsum() - group["length"]).all()
    full = packing.pack_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), WORDS).toPandas()
    assert full["sequence_id"].nunique() <= -(-full["length"].sum() // 4096) + 1
    ids = np.array(library.encode("one", add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert rows[(rows["doc_id"] == 3)]["ids_crc32"].tolist() == [zlib.crc32(ids)]
    assert packing.pack_documents(odd.limit(0), WORDS).count() == 0


def test_packing_in_blocks_and_levels(spark):
    items = spark.range(600).select(F.col("id").alias("row"), (F.col("id") * 37 % 90 + 1).alias("length"))
    rows = packing.pack(items, capacity=100, block=64, generations=4).join(items, "row").toPandas()
    assert len(rows) == 600 and rows.groupby("sequence_id")["length"].sum().max() <= 100
    same = spark.range(300).select(F.col("id").alias("row"), F.lit(60).cast("long").alias("length"))
    assert packing.pack(same, capacity=100, block=64).select("sequence_id").distinct().count() == 300


def test_packing_of_single_pieces_over_many_blocks(spark):
    # Every piece fills a bin of its own, and many blocks get more than ``block`` pieces.
    items = spark.range(5000).select(F.col("id").alias("row"), F.lit(60).cast("long").alias("length"))
    rows = packing.pack(items, capacity=100, block=64).toPandas()
    assert len(rows) == rows["sequence_id"].nunique() == 5000 and (rows["offset"] == 0).all()


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 80).tolist()
    a, b = (packing.Packing.best_fit(rng.permutation(80).tolist(), sizes, 100) for _ in range(2))
    child = packing.crossover(a, b, sizes, 100, 5, rng)
    assert sorted(i for items in child.bins for i in items) == list(range(80))
    assert all(sum(sizes[i] for i in items) == f <= 100 for items, f in zip(child.bins, child.fill, strict=True))


def test_lm_scores_equal_brute_force(spark, odd):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    for docs, chars in ((odd, 5000), (spark.read.parquet(f"{SMALL}/documents.parquet"), 100_000)):
        texts = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in docs.collect()]
        train = [w for d, w in texts if d is not None and zlib.crc32(str(d).encode()) % 10]
        uni = Counter(t for w in train for t in w)
        bi = Counter(p for w in train for p in zip([b"", *w], w, strict=False))
        kinds, n, v = Counter(a for a, _ in bi), sum(uni.values()), len(uni)
        got = sorted((r["score"], r["base_score"], r["n_known"]) for r in lm_score.score(docs, ~held, block_chars=chars).collect())
        want = []
        for _, words in texts:
            base = model = 0.0
            for a, b in zip([b"", *words], words, strict=False):
                p = (uni[b] + 0.1) / (n + 0.1 * (v + 1))
                base += math.log10(p)
                if uni[a]:
                    p = max(bi[a, b] - 0.75, 0) / uni[a] + 0.75 * kinds[a] / uni[a] * p
                model += math.log10(p)
            want.append((model, base, sum(uni[w] > 0 for w in words)))
        assert np.allclose(got, sorted(want), atol=1e-6)


def test_minhash_components_equal_brute_force(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SMALL}/documents.parquet")):
        sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
        root = {d: d for d in sets}
        ids = sorted(sets)
        for x in ids:
            for y in ids:
                both = len(sets[x] & sets[y])
                if x < y and sets[x] and 100 * both >= 85 * len(sets[x] | sets[y]):
                    old, new = max(root[x], root[y]), min(root[x], root[y])
                    root = {k: new if v == old else v for k, v in root.items()}
        rows = minhash.near_duplicates(docs).collect()
        assert len(rows) == docs.count()
        assert all(r["component_id"] == root[r["doc_id"]] and r["n_shingles"] == len(sets[r["doc_id"]]) for r in rows if r["doc_id"] is not None)


def test_sketch_fills_every_coordinate():
    for size in (1, 3, 1000):
        values = minhash.sketch(np.arange(size, dtype=np.uint64))
        assert values.max() < 2**64 - 1 and (values == minhash.sketch(np.arange(size, dtype=np.uint64))).all()


def test_lines_equal_brute_force(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)):
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen, want = [], {}
        for r in sorted({(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None}, key=lambda r: r[0]):
            kept = []
            for line in (r[1] or "").split("\n"):
                words = frozenset(w for w in re.split("[ \t-\r]+", line.lower()) if w)
                if not words or not any(1000 * len(words & s) >= 800 * len(words | s) for s in seen):
                    kept.append(line)
                if words:
                    seen.append(words)
            want[r[0]] = None if r[1] is None else "\n".join(kept)
        got = line_dedup.dedup_lines(docs)
        assert got.columns == docs.columns and got.count() == docs.count()
        rows = [r for r in got.collect() if r["doc_id"] is not None]
        # The row without an id comes first and shares no line with the others.
        assert all(r["text"] == want[r["doc_id"]] for r in rows)


def test_fingerprints_follow_true_similarity(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    for k, r in enumerate(fingerprint.compare_with_next(docs).orderBy("doc_id").collect()):
        cut = len(texts[k]) // 4
        after = texts[(k + 1) % len(texts)]
        edited = texts[k][: len(texts[k]) - cut] + after[:cut]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(texts[k])
        for got, other in ((r["near_edited"], edited), (r["near_next"], after)):
            a, b = shingles(texts[k].lower()), shingles(other.lower())
            assert abs(got - len(a & b) / max(1, len(a | b))) < (0.2 if len(a) > 60 else 0.5)
    rows = fingerprint.fingerprint(odd).collect()
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (0, 1, 2)} == {"00" * 256}
    assert fingerprint.compare_with_next(odd).count() == odd.count()
    assert fingerprint.compare_with_next(odd.limit(0)).count() == 0


def test_language_id_on_held_out(spark, odd):
    rows = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    right, total = rows.filter("held_out AND lang IS NOT NULL").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / total > 0.97
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(clean)
    assert langid.predict(clean, model).filter("rejected AND lang IS NOT NULL").count() <= 2
    foreign = ["Suomi on tasavalta Pohjois-Euroopassa ja sen pääkaupunki on Helsinki.", "Polska jest państwem w Europie Środkowej.", "Россия является крупнейшим государством мира.", "日本は東アジアに位置する島国である。"]
    assert all(model.predict(t * k)[2] for t in foreign for k in (1, 5, 50))
    model = langid.fit(odd)
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["rejected"] and got[k]["score"] == 0 for k in (0, 1, 2))
    assert langid.predict(odd, langid.fit(odd.limit(0))).filter("lang_pred != 'und'").count() == 0


def test_toxicity_on_held_out(spark, odd):
    sf = "/root/testdata/sf0.1"
    rows = queries.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert rows[rows["toxic"] == 1]["predicted"].mean() > 0.85 and rows[rows["toxic"] == 0]["predicted"].mean() < 0.02
    assert toxicity.folded_words("Yоu St0p1d f00") == ["you", "stopid", "f00".replace("0", "o")]
    lexicon = toxicity.Lexicon({"idiot.": 3.0}, {"dear idiot": ()}, 1.0, -1.0)
    machine = lexicon.automaton()
    assert lexicon.raw(machine, ["an", "idiot"]) == 3.0 and lexicon.raw(machine, ["dear", "idiot"]) == 0.0
    assert toxicity.score(odd, lexicon).count() == odd.count()


def test_html_blocks_and_runs(spark):
    page = "<html><head><title>t</title></head><body><nav><a>Menu</a></nav>{}<script>var t='</p>';</script><article><h1>A&amp;B</h1><p>one <b>t</b>wo<br>three&nbsp;x<p>four<div class=ad>buy</div></article><footer>f</footer>"
    assert " ".join(t for z, t in html_extract.blocks(page.format("")) if z != html_extract.DROPPED) == "A&B one two three x four"
    shared = "<div>welcome to our very own site of news</div>"
    rows = [(k, f"http://h.org/{k}", f"<body>{shared}<p>only page {k} says this {'z' * k}</p>") for k in range(1, 4)]
    rows += [(7, "http://other.org/", f"<body>{shared}</body>"), (8, None, None), (9, "x", ""), rows[0]]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = {r["page_id"]: r["text"] for r in got.collect()}
    assert texts[2] == "only page 2 says this zz" and texts[7] == "welcome to our very own site of news" and texts[8] == texts[9] == ""
    assert got.count() == len(rows)


def test_suffix_array():
    tokens = np.array([3, 1, 2, 3, 1, 2, 9])
    assert html_extract.suffix_array(tokens).tolist() == sorted(range(7), key=lambda i: tokens[i:].tolist())


def test_line_dedup_of_clashing_names_null_ids_and_nothing(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(None, line, 1, "a"), (None, f"{line} lambda", 2, "b"), (3, f"{line}\nother words here", 3, "c"), (3, f"{line}\nother words here", 4, "d"), (4, None, 5, "e"), (5, "", 6, "f")]
    for names in ("gone long, _GONE string", "_t long, _doc string"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
        got = line_dedup.dedup_lines(docs)
        assert got.columns == docs.columns
        texts = {r[2]: r["text"] for r in got.collect()}
        # The two rows without an id are one document of two first lines; the shorter text may stand on either.
        assert sorted([texts[1], texts[2]]) in (sorted(["", f"{line} lambda"]), sorted([line, ""]), [line, f"{line} lambda"])
        assert texts[3] == texts[4] == "other words here" and texts[5] is None and texts[6] == ""
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_near_lines_without_ids_are_one_document(spark):
    """Lines at different places of rows with NULL id are compared like those of one document."""
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(None, line), (None, f"something else entirely\n{line} lambda")], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup_lines(docs).collect()) == [line, "something else entirely"]


def test_line_dedup_of_many_near_copies(spark):
    """A line with hundreds of near copies, and lines that share one word, against brute force."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(24)]
    texts = []
    for _ in range(150):
        mine = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            mine[rng.randrange(24)] = f"x{rng.randrange(400)}"
        texts.append("\n".join([" ".join(mine), f"common {rng.randrange(60)} {rng.randrange(60)} {rng.randrange(60)} {rng.randrange(60)}"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    seen, want = [], {}
    for k, text in enumerate(texts):
        kept = []
        for line in text.split("\n"):
            words = frozenset(line.split())
            if not any(1000 * len(words & s) >= 800 * len(words | s) for s in seen):
                kept.append(line)
            seen.append(words)
        want[k] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == want


def test_rarity_is_counted_in_all_documents(spark, monkeypatch):
    seen, table = [], line_dedup.rarity_table

    def counted(words):
        seen.append(words.count())
        return table(words)

    monkeypatch.setattr(line_dedup, "rarity_table", counted)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('only ', id) AS text")
    assert line_dedup.removed_lines(docs).count() == 0
    assert seen == [40_000]


def test_long_lines_meet_few_others(spark, monkeypatch):
    """Lines of 30 to 200 words and near copies of them, against brute force, and the number of pairs that are stored."""
    draw = random.Random(5)
    lines = []
    for n in [30, 60, 71, 72, 73, 74, 90, 110, 130, 150, 170, 200] * 20:
        line = [f"w{draw.randrange(2500)}" for _ in range(n)]
        lines.append(line)
        if draw.random() < 0.5:
            # Around the threshold, and of another size.
            k = round(n * draw.choice((0.05, 0.1, 0.12, 0.2)))
            lines.append([*line[k:], *(f"x{draw.randrange(10**6)}" for _ in range(draw.choice((0, k))))])
    draw.shuffle(lines)
    docs = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    sizes, put = {}, line_dedup.stored

    def counted(df, name):
        table = put(df, name)
        sizes.setdefault(name, table.count())
        return table

    monkeypatch.setattr(line_dedup, "stored", counted)
    sets = [frozenset(line) for line in lines]
    similar = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) * 1000 >= 800 * len(a | b)]
    assert {r["doc"] for r in line_dedup.removed_lines(docs).collect()} == {i for i, _ in similar} != set()
    # Besides the similar pairs those near the threshold may pass the parity bits, and few by chance.
    assert sizes["star"] + sizes["pairs"] <= 2 * len(lines)


def test_word_codec_forgets_words_that_occur_once():
    codec, library = packing.WordCodec(WORDS), Tokenizer.from_file(WORDS)
    for k in range(0, 300_000, 1000):
        codec.encode(" ".join(f"q{i:x}z".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(k, k + 1000)))
    assert len(codec) + len(codec.before) <= 1 << 18
    few = packing.WordCodec(WORDS, limit=5)
    for text in ["one two three four five six seven", "one two eight nine ten", "two one eleven three"] * 2:
        assert few.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(few) <= 5 and len(few.before) <= 5


def test_word_codec_splits_what_it_remembers_no_more(monkeypatch):
    codec, library = packing.WordCodec(WORDS), Tokenizer.from_file(WORDS)
    splits = []

    class Counting:
        def findall(self, text, split=packing.PLAIN_SPLIT):
            splits.append(text)
            return split.findall(text)

    monkeypatch.setattr(packing, "PLAIN_SPLIT", Counting())
    text = "Don't stop (now), it's 42% off: don't_stop\x07, l'\xe9t\xe9... they'll've ''s 3\xa0000\u2003\xc0 la\x01 \x7f\x80 \u0130\u0130x."
    want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert [codec.encode(text) for _ in range(2)] == [want] * 2
    del splits[:]
    assert codec.encode(text) == want and splits == []
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab'stmdrevl09_-.,!\t\n \x00\x0b\x1b\x7f\x80\xa0\xaa\xb5\xba\xc9\xdf\u0130\u0149\u2003\u2019") for _ in range(rng.randint(0, 30)))
        assert codec.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_minhash_rounds_without_links_repeat_nothing(spark, monkeypatch):
    """Texts at a similarity of 0.7: every bucket stays open until all its members have been hubs."""
    base = " ".join(f"w{i}" for i in range(100))
    texts = [(d, f"{base} " + " ".join(f"x{d}y{i}" for i in range(20))) for d in range(60)]
    docs = spark.createDataFrame([*texts, (60, texts[0][1] + " more")], "doc_id long, text string")
    made, put = [], minhash.stored

    def kept(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # Spark moves an anti join below a grouping by the same key, where it meets the members of all buckets.
        assert not ("LeftAnti [cls" in plan.replace("Join ", "") and "Aggregate [cls" in plan) or name != "loose"
        made.append(name)
        return put(df, name)

    monkeypatch.setattr(minhash, "stored", kept)
    rows = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert rows == {d: d for d in range(60)} | {60: 0}
    # Once more for the one link that is found; the rounds after it find none.
    assert made.count("hubs") > 4 and made.count("open") <= 2


def test_pairs_of_lines_pass_at_their_first_common_word(spark):
    # Two sets of 50 words need 45 in common: with no common word before place 6 there are at most 44; of 50 and 60 words, 49.
    rows = [(50, at, 0, 0, 50, at, 0, 0) for at in range(10)] + [(50, 1, 0, 0, 60, 9, 0, 0), (50, 1, 0, 0, 60, 13, 0, 0)]
    pairs = spark.createDataFrame(rows, ", ".join(f"{x}_{c} bigint" for x in "ab" for c in ("n", "at", *line_dedup.BITS)))
    kept = pairs.filter(line_dedup._may_match(0.8)).select("b_n", "b_at").collect()
    assert sorted(map(tuple, kept)) == [(50, at) for at in range(6)] + [(60, 9)]


def test_minhash_rounds_leave_no_tables_to_the_driver(spark, monkeypatch):
    """Each text resembles the next one only, in groups of twelve, so that components grow for some rounds."""
    texts = [(12 * g + k, " ".join(f"g{g}w{i}" for i in range(7 * k, 7 * k + 100))) for g in range(5) for k in range(12)]
    made, put = [], minhash.stored

    def kept(df, name):
        made.append((name, put(df, name)))
        return made[-1][1]

    monkeypatch.setattr(minhash, "stored", kept)
    monkeypatch.setattr(components, "stored", kept)
    found = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    left = sorted(name for name, table in made if any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in table.inputFiles()))
    # The sets of all rows and the components that were found last; the result is made of them.
    assert left == ["edges", "shingled"] and len(made) > 20
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {d: d - d % 12 for d, _ in texts}


def test_automaton_takes_few_bytes_a_token():
    numbers = np.random.default_rng(0).integers(0, 20_000, 200_000)
    block = lm_score.Block([" ".join(f"w{x}" for x in numbers), None, "w1 w2 w3"])
    uni, bi = np.bincount(block.tokens), np.bincount(block.pair_of)
    types = np.bincount(block.first[bi > 0], minlength=len(uni))
    tracemalloc.start()
    automaton = lm_score.Automaton(block, uni, types, bi, len(block.tokens), len(uni))
    model, base = automaton.traverse()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(block.tokens)
    assert all(np.array_equal(a, b) for a, b in zip(automaton.traverse(7), (model, base), strict=True))
