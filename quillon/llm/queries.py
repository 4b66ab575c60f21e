"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, html, jaccard, langid, mixing, pii, search, secrets, substrings, toxicity
from quillon.llm.oracles import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.langid_digest(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_digest(_table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substrings_digest(_table(spark, sf_dir, "documents"))


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_digest(_table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_search": op2_search,
    "op3_jaccard": op3_jaccard,
    "op4_langid": op4_langid,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_html": op8_html,
    "op9_mixing": op9_mixing,
    "op10_decontaminate": op10_decontaminate,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
