"""Registered queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    conversation_trie,
    decontaminate,
    html_extract,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    substring_dedup,
    toxicity,
    url_filter,
    vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_html_extraction": html_extract.op9_html_extraction,
        "op10_language_id": language_id.op10_language_id,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_conversation_trie": conversation_trie.op12_conversation_trie,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE_SQL,
        "op5_decontamination": decontaminate.ORACLE_SQL,
        "op7_mixing": mixing.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op11_line_dedup": line_dedup.ORACLE_SQL,
        "op12_conversation_trie": conversation_trie.ORACLE_SQL,
        "op13_vector_codes": vector_codes.ORACLE_SQL,
    }
