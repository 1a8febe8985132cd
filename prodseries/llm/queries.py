"""The registered queries of the operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prodseries.llm import (
    bpe, decontaminate, filter_audit, fixity, hard_negatives, language_id, licenses, near_dup, pii, source_mix, token_rollups, unit_dedup, vector_search,
)
from prodseries.llm.storage import stored


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as an archive, audited against a replica that has suffered; each is hashed from its own bytes."""
    placed = stored(fixity.layout(read(spark, sf_dir, "pages")), "layout")  # places and hashes, without the bytes
    return fixity.audit(fixity.index(placed), fixity.worn(placed))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(read(spark, sf_dir, "documents"))


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = token_rollups.Rollup(spark)
    token_rollups.feed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), rollup)
    return rollup.totals()


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(read(spark, sf_dir, "embeddings"))


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.repeats(read(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_fixity, op2_decontaminate, op3_language_id, op4_token_rollups, op5_vector_search, op6_unit_dedup, op7_near_dup,
        op8_pii, op9_license_scan, op10_bpe, op11_hard_negatives, op12_source_mix, op13_filter_audit,
    )
}
#: The others have no SQL: tests hold them against brute force, the tokenizers library or held-out texts.
ORACLES: dict[str, str] = {
    "op1_warc_fixity": fixity.SQL, "op2_decontaminate": decontaminate.SQL, "op4_token_rollups": token_rollups.SQL,
    "op11_hard_negatives": hard_negatives.SQL, "op13_filter_audit": filter_audit.SQL,
}
