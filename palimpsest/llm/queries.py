"""The queries of this folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard, langid, lattice, packing, pieces, pii, substrings, toxicity, urls, voronoi
from palimpsest.llm.oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: int):
    """crc32 of the doc_id as text, modulo `of`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, table(spark, sf_dir, "pages"), URL_RULES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return toxicity.score(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(spark, table(spark, sf_dir, "documents"), 13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pieces.digest(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(spark, table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return packing.pack(spark, table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(spark, table(spark, sf_dir, "embeddings"), 0.93)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.train(spark, docs, remainder(5) != 0)
    return langid.predict(docs, dictionaries).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_toxicity, op3_exact_top_k, op4_substring_dedup, op5_sentencepiece, op6_ngram_jaccard_join, op7_contextual_pii, op8_best_fit_packing, op9_embedding_near_dedup, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
