"""Every stage of the corpus pipeline on odd rows, and the whole of it on the smallest tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from partonflow.llm import html_extract, toxicity

SMALL = "/root/testdata/sf0.001"
LINES = ["the quick brown fox jumps over the lazy dog near the river bank", "a second line that stands here only once in all of this"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _text string, gone long"


@pytest.fixture(scope="module")
def odd(spark):
    clean = "\n".join(LINES) + "\n" + " ".join(f"word{i}" for i in range(40))
    texts = [(1, clean), (1, clean), (2, clean), (3, None), (4, ""), (5, " \t"), (6, "12345 67890"), (None, "no number here, but a text of its own"), (None, "no number here, but a text of its own"), (7, LINES[0])]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "x", 9) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_stage_names_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("k", range(4))
def test_stages_pass_columns_and_empty_tables(spark, odd, k):
    out = corpus_pipeline.STAGES[k][1](spark, odd, SMALL)
    assert out.columns == odd.columns
    assert out.schema.simpleString() == odd.schema.simpleString()
    assert corpus_pipeline.STAGES[k][1](spark, odd.limit(0), SMALL).count() == 0


def test_texts_without_a_letter_are_rejected(spark, odd):
    kept = ids(corpus_pipeline.identify_language(spark, odd, SMALL))
    assert not kept.keys() & {3, 4, 5, 6} and kept[1] == 2


def test_near_duplicates_leave_one_row_of_each_group(spark, odd):
    kept = ids(corpus_pipeline.drop_near_duplicates(spark, odd, SMALL))
    assert kept == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 1, 7: 1}


def test_repeated_lines_go_and_lengths_follow(spark, odd):
    rows = corpus_pipeline.drop_repeated_lines(spark, odd, SMALL).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[2] == "" and texts[7] == "" and texts[3] is None and texts[1].startswith(LINES[0])
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)


def test_packing_places_every_row(spark, odd):
    packed = corpus_pipeline.pack_sequences(spark, odd, SMALL)
    assert ids(packed.filter("piece = 0")) == ids(odd)


def test_the_whole_pipeline_works_on_what_each_stage_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
    spans = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert spans.filter("n != end OR n > 4096").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6, 10])
def test_toxicity_fits_on_few_labels(spark, n):
    texts = [(i, f"you stupid fool number {i}" if i % 2 else f"a kind sentence number {i}") for i in range(10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    scores = [r["score"] for r in toxicity.score(docs, lexicon).collect()]
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)


def test_toxicity_fits_where_no_labelled_document_has_a_text(spark):
    docs = spark.createDataFrame([(1, None), (2, None), (3, "unlabelled text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 3


def test_html_extraction_with_clashing_names(spark):
    html = "<html><body><article><p>The text.</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a/x", html, 5, "m", "h", "w"), (2, None, None, 6, None, None, None)], "page_id long, url string, html string, _main long, _page string, host string, Row string")
    rows = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert rows[1]["text"] == "The text." and rows[2]["text"] == ""
    assert (rows[1]["_main"], rows[1]["_page"], rows[1]["host"], rows[1]["Row"]) == (5, "m", "h", "w")
    assert html_extract.extract(pages.limit(0)).columns == [*pages.columns, "text"]
