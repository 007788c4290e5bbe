"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunks, decontaminate, jaccard, language, mixing, ngram, pii, rules, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": ngram.op1_lm_scoring,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_mixing": mixing.op3_mixing,
        "op4_sharding": sharding.op4_sharding,
        "op5_language": language.op5_language,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_line_dedup": chunks.op7_line_dedup,
        "op8_jaccard_join": jaccard.op8_jaccard_join,
        "op9_quality_rules": rules.op9_quality_rules,
        "op10_pii": pii.op10_pii,
        # parts of op1 and op10, for their SQL
        "lm_scoring_counts": ngram.lm_scoring_counts,
        "pii_base_counts": pii.pii_base_counts,
    }


def oracle_sql() -> dict[str, str]:
    """The others can't be written in SQL. tests/llm compares op1, op4, op7 and op10 with plain Python, and measures op5 and op6 on
    held-out rows."""
    return {
        "op2_decontaminate": decontaminate.OP2_SQL, "op3_mixing": mixing.OP3_SQL, "op8_jaccard_join": jaccard.OP8_SQL, "op9_quality_rules": rules.OP9_SQL, "lm_scoring_counts": ngram.COUNTS_SQL, "pii_base_counts": pii.BASE_SQL,
    }
