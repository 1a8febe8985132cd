"""From raw documents to token ids: language, near-duplicates, benchmark passages, personal data, BPE.

Each stage takes all rows that the one before kept, as a table in the shared folder, and all but the last return the
columns they got. A document without text or letters goes in the first stage; later stages meet whatever is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodseries.llm import bpe, decontaminate, language_id, near_dup, pii
from prodseries.llm.storage import dropped, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, or between two, go."""
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return near_dup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed spans are replaced by their kind; all documents stay."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dup", near_duplicates),
    ("decontaminate", benchmark),
    ("pii", personal_data),
    ("bpe", tokens),
]
#: SQL can express neither the language model nor BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return docs
