"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partonflow.llm import bpe, byte_prefix, centroids, dialogue, fingerprint, html_extract, langid, line_dedup, lm_score, minhash, packing, toxicity, vector_graph
from partonflow.llm.common import crc_bucket
from partonflow.llm.sql import SQL

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _queries[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, path).select("doc_id", "ids"), path)
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), lexicon).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 10) == 0
    scored = lm_score.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = byte_prefix.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return made.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


def damaged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversation rows that are left after the damage, and those that it drops."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", "role", "text", F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("damage"))
    text = F.coalesce("text", space)
    left = rows.filter("damage != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return left.drop("copy"), rows.filter("damage = 0")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, dropped = damaged(table(spark, sf_dir, "conversations"))
    found, parts = dialogue.repair(left, dropped)
    digest = F.sha2(F.coalesce("transcript", F.lit("")), 256)
    whole = found.filter("NOT shared").withColumn("repaired_sha256", digest)
    shared = found.filter("shared").alias("f").join(dialogue.digests(parts).alias("d"), F.col("f.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    joined = shared.select("f.*", F.coalesce("d.repaired_sha256", digest).alias("repaired_sha256"))
    return whole.unionByName(joined).drop("shared", "transcript")
