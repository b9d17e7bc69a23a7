"""The subpackage's queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamisol.llm import copies, garbled, leakage, linkage, lookalikes, mixing, quality, variants
from tamisol.session import ship, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return lookalikes.found(table(spark, d, "sanctions"), table(spark, d, "customer_kyc"))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return lookalikes.canonical_names(table(spark, d, "sanctions"), table(spark, d, "customer_kyc"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return variants.name_classes(table(spark, d, "sanctions_alerts"), table(spark, d, "sanctions"), table(spark, d, "prior_cases"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return variants.entity_and_case_links(table(spark, d, "sanctions_alerts"), table(spark, d, "sanctions"), table(spark, d, "prior_cases")).select("link", "left_key", "right_key")


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return linkage.classes(table(spark, d, "sanctions"), table(spark, d, "list_conventions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return linkage.matches(table(spark, d, "sanctions"), table(spark, d, "list_conventions")).select("id_a", "id_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return copies.copies(table(spark, d, "sanctions"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return copies.collapsed(table(spark, d, "sanctions"))


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return garbled.repaired(table(spark, d, "sanctions"), "id", "full_name", "raw_data").withColumnRenamed("key", "id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # a text whose search was given up without finding anything isn't known to be garbled
    rows = p6_restored(spark, d).filter(F.col("complete") | (F.col("restored") != F.col("original")) | F.col("original").contains("\ufffd"))
    return rows.select("id", "field")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).filter("reason = 'share'").select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return mixing.selection(table(spark, d, "documents"), table(spark, d, "mix_targets"), table(spark, d, "common_words"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_selection(spark, d), table(spark, d, "mix_targets"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return quality.classified(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return quality.found(table(spark, d, "documents"), table(spark, d, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_canonical, p2_found, p2_links, p3_found, p3_matches, p5_found, p5_collapsed, p6_found, p6_restored, p8_found, p8_leaks, p8_cleaned, p9_selection, p9_shares, p10_found, p10_statistics)}


def oracle_sql() -> dict[str, str]:
    return {}
