"""From raw documents to token ids: the stages of a training corpus, each one operator.

Counted as part of the subpackage ``llm``: language ID, exact dedup, near dedup, mixing,
SentencePiece.  Each stage is written to the shared folder as Parquet and reread as the next
one's documents.  All but the last keep the columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import chosen_path, curriculum, language_fusion, queries, radix_dedup, sentencepiece_viterbi
from logsift.llm.common import free_name, with_row_key
from logsift.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text has no letters or whose language stays below the posterior threshold.
    Where no document declares a language there is none to judge by, and all that have letters stay."""
    row = free_name(docs, "lt_row")
    keyed = with_row_key(docs, row)
    found = language_fusion.identify(keyed.select(F.col(row).alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host")))
    gone = found.filter("not accepted and (language is not null or n_grams = 0)").select(F.col("id").alias(row))
    return keyed.join(gone, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return radix_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five words, similarity 0.8 or more)."""
    return chosen_path.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents up to its target (some twice), in training order."""
    return curriculum.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with the digest of what they decode to."""
    return sentencepiece_viterbi.coded(docs, sentencepiece_viterbi.Model.load(queries.tokenizer_file(queries.PIECES)))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("sentencepiece", encode)]

#: Language model, near duplicates and tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline/{uuid.uuid4().hex}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
