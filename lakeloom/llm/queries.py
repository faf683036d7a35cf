"""Queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import bpe, decontam, langid, language_model, quality_mil, rules_forest, simhash, suffix_dedup, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_lm_score": language_model.op2_lm_score,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality": quality_mil.op4_quality,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_language_id": langid.op7_language_id,
    "op8_quality_rules": rules_forest.op8_quality_rules,
    "op9_simhash": simhash.op9_simhash,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": url_filter.ORACLE,
    "op6_decontamination": decontam.ORACLE,
}
