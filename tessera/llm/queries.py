"""The queries of the subpackage, by name; each takes a session and a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import defects, leakage, mixing, packing, pii, tokens
from tessera.plans.session import spread
from tessera.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


# What each query reads of the growing tables; these columns alone are dealt out where a table has few splits.
_READ = {"documents": ("doc_id", "text", "source", "lang", "subject"), "sft_pairs": ("pair_id", "problem", "solution", "source", "lang", "subject", "ingested_at")}


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A test table; of a growing one the stated columns (or all that the queries use), spread over the cores."""
    held = tables.table(spark, folder, name)
    return spread(held.select(*(columns or _READ[name]))) if name in _READ else held


def _mixtures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.select_mixtures(*(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mixture_sources"), table(spark, folder, "mixture_targets")))


def p1_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mixtures(spark, folder)[1]


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_shares(*_mixtures(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(*(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "sft_pairs", "pair_id", "problem", "solution"), table(spark, folder, "eval_items")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects.find_defects(table(spark, folder, "sft_pairs", "pair_id", "problem", "solution"))


def p4_record_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.record_tokens(table(spark, folder, "documents"), table(spark, folder, "sft_pairs"))


def p4_token_totals(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_totals(p4_record_tokens(spark, folder))


def p5_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(table(spark, folder, "documents", "doc_id", "text"))


def p6_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_sequences(table(spark, folder, "documents", "doc_id", "text"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p6_sequences(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(pii.detect(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "name_lexicon"), redacted=False))


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.detect(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "name_lexicon")).select("doc_id", "text")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_selection, p1_shares, p2_found, p3_found, p4_record_tokens, p4_token_totals, p5_ids, p6_sequences, p6_fill, p7_found, p7_redacted)}


def oracle_sql() -> dict[str, str]:
    """None of these operators can be stated in SQL; tests/llm holds them against brute force."""
    return {}
