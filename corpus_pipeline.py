"""Training-corpus pipeline over `documents`: five of the training-data operators in a row.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns documents with the same columns; the last returns what the
mix takes of each document. `run` writes each stage's result as Parquet under
the checkpoint folder and reads it again, so a lost executor never reaches
back over a stage.

Decisions: documents whose language is rejected go; of each near-duplicate
class one document stays; documents that hold a benchmark phrase go; secrets
are replaced by a mark within the text; sources are mixed to target weights.

Defined cases, for all stages: a null text counts as an empty one and stays
null where its row stays; texts of any length are worked on whole; of wholly
equal rows the near-duplicate stage keeps one, the other stages treat each on
its own; other columns pass through unchanged, whatever their names, up to the
last stage, which has its own columns; a null id, language or source is a
value like any other; empty `documents` give an empty result, an empty
`benchmark` lets all documents stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, language_id, mixing, near_dedup, secret_scan
from tessera.session import checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay. A null, empty or letterless text has none, so it goes."""
    return language_id.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one of the least id (null first).

    Texts without words are alike only if they are equal.
    """
    return near_dedup.keep_one(docs, shingle=5, threshold=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a phrase of any benchmark item stay; items without words have no phrase."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret in a text becomes a mark, and `n_chars` of a changed text is counted anew."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in words; null is the last source.

    Texts without words have size 0 and give nothing.
    """
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
]

# Trained likelihoods, ProbMinHash classes and the randomness battery have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents` of sf_dir: doc_id, source, size, source_size, target, taken."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
