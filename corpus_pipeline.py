"""A corpus pipeline of five of the operators; each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir). Between stages the rows are written as
Parquet in the shared folder and read again, by `run` or by whoever runs STAGES.
All stages but the last return the columns of `documents`, whatever they are.
Every row is judged by its own text, also where rows repeat or lack a doc_id.
The session's Arrow batches are limited to 2,000 rows from the first stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import jaccard, packing, pii, substrings, toxicity
from palimpsest.llm.queries import remainder, table
from palimpsest.plans.scratch import BATCH_ROWS, BATCHES, Scratch

#: From this score on a document counts as toxic.
TOXIC = 0.3


def with_small_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches for this application: its stages move whole texts, and 10,000 of them at once, as is Spark's default, are much of a worker's memory."""
    if not 0 < int(spark.conf.get(BATCHES)) <= BATCH_ROWS:
        spark.conf.set(BATCHES, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text scores as toxic go; other rows with their doc_id, or without one, stay."""
    with_small_batches(spark)
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return toxicity.below(docs, model, TOXIC)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that near-duplicate links join, one with the smallest doc_id stays, and all rows that are linked with nothing."""
    with_small_batches(spark)
    return jaccard.first_of_each(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut from each row's own text. A text that loses all is empty."""
    with_small_batches(spark)
    return substrings.cut(spark, docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in square brackets."""
    with_small_batches(spark)
    return pii.masked(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens."""
    with_small_batches(spark)
    from public_tokenizers import path

    return packing.pack(spark, docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Trees, hashes and tokenizers are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
