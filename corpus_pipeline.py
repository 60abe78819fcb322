"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of ``documents``. Null keys go through; rows
that repeat a key are separate documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import decontamination, jaccard, language_id, line_dedup, packing
from timeloom.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of an Arrow batch. An executor's heap is full after some stages; beside it, a worker that gets batches of 4 MB has 200 MB and more.
BATCH_BYTES = "1m"

#: What a worker encodes at a time and remembers while it packs.
PACKED = {"chunk": 250_000, "words": 60_000, "parts": 100_000}

#: A text without any of these has no word.
_WORD = "[0-9A-Za-z]|[^\\x00-\\x7F]"


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """Documents that still have a word, with n_chars counted again, in the columns of ``like``."""
    columns: list[Column] = [F.length("text").cast(like.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in like.columns]
    return docs.where(F.col("text").rlike(_WORD)).select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows that name a language; texts that are null or have no letter go, a missing lang is filled in."""
    model = language_id.train(docs, "doc_id", "text", "lang")
    found = language_id.identify(docs, model, docs.columns)
    found = found.withColumnRenamed(found.columns[len(docs.columns)], "_lang_pred").where("_lang_pred != 'und'")
    return found.select(*[F.coalesce("lang", "_lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go of which an earlier occurrence stays; a document without a word left goes."""
    return _with_text(line_dedup.dedup(docs, least_words=1), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that five-word shingles at a similarity of 0.8 connect: that with the smallest id."""
    return jaccard.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that a test phrase covers are cut out; a document without a word left goes."""
    return _with_text(decontamination.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], **PACKED)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def _small_batches(stage: Stage) -> Stage:
    """Python workers get small Arrow batches: five operators use them one after the other, beside the executor's heap. The session keeps the setting."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _small_batches(identify_language)),
    ("line_dedup", _small_batches(dedup_lines)),
    ("ngram_jaccard_join", _small_batches(dedup_documents)),
    ("benchmark_decontamination", _small_batches(decontaminate)),
    ("best_fit_packing", _small_batches(pack)),
]

#: SimHash, Viterbi scores and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
