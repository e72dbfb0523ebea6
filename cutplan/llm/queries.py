"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cutplan.llm import chat, decontaminate, language, line_dedup, merkle, near_dedup, ogg, packing, pii, quality, spelling, substring_dedup, suffix_trees
from cutplan.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": lambda spark, d: line_dedup.digest(table(spark, d, "documents")),
        "op2_language": lambda spark, d: language.digest(table(spark, d, "documents")),
        "op3_near_dedup": lambda spark, d: near_dedup.digest(table(spark, d, "documents")),
        "op4_packing": lambda spark, d: packing.digest(table(spark, d, "documents")),
        "op5_quality": lambda spark, d: quality.digest(table(spark, d, "documents"), table(spark, d, "labels")),
        "op6_pii": lambda spark, d: pii.digest(table(spark, d, "documents")),
        "op7_decontaminate": lambda spark, d: decontaminate.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op8_chat": lambda spark, d: chat.digest(table(spark, d, "conversations")),
        "op9_ogg": lambda spark, d: ogg.digest(table(spark, d, "documents")),
        "op10_substring_dedup": lambda spark, d: substring_dedup.digest(table(spark, d, "documents")),
        "op11_merkle": lambda spark, d: merkle.digest(table(spark, d, "documents")),
        "op12_spelling": lambda spark, d: spelling.digest(table(spark, d, "documents")),
        "op13_suffix_trees": lambda spark, d: suffix_trees.digest(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op3_near_dedup": near_dedup.ORACLE,
        "op7_decontaminate": decontaminate.ORACLE,
        "op8_chat": chat.ORACLE,
        "op10_substring_dedup": substring_dedup.ORACLE,
        "op11_merkle": merkle.ORACLE,
        "op12_spelling": spelling.ORACLE,
        "op13_suffix_trees": suffix_trees.ORACLE,
    }
