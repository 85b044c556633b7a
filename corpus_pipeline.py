"""Cleaning and packing of a text corpus: language ID, toxicity, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partonflow.llm import langid, line_dedup, minhash, packing, toxicity
from partonflow.llm.common import stored, unused


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: str, made: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps; its columns may have names that ``docs`` has as well."""
    clash = {name: f"_own_{name}" for name in made if name in docs.columns}
    judged = judge(docs.withColumnsRenamed(clash)).filter(keep).drop(*made)
    return judged.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or far from every centroid go."""
    model = langid.fit(docs)
    return _judged(docs, lambda d: langid.predict(d, model), "NOT rejected", ("lang_pred", "score", "rejected"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half, learnt from the labels."""
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda d: toxicity.score(d, lexicon), "score < 0.5", ("score",))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines similar to an earlier line; ``n_chars`` follows the text."""
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, and all documents without words.

    Of rows that repeat an id and a text one stays, also where the id is NULL.  Rows
    with NULL ids and texts that are only similar stay, as there is no smallest id.
    """
    found = minhash.near_duplicates(docs, percent=80)
    gone = found.filter("doc_id != component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    key, again = unused("_text", docs.columns), unused("_id", docs.columns)
    keyed = left.withColumn(key, F.xxhash64("text"))
    twice = docs.groupBy(F.col("doc_id").alias(again), F.xxhash64("text").alias(f"{key}_again")).count().filter("count > 1").drop("count")
    same = keyed["doc_id"].eqNullSafe(twice[again]) & (keyed[key] == twice[f"{key}_again"])
    single = keyed.join(twice, same, "left_anti")
    return single.unionByName(keyed.join(twice, same, "left_semi").dropDuplicates(["doc_id", key])).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: Learnt models, hashing and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
