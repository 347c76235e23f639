"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe_automaton, compression_classifier, cross_parsing, html_main_text, line_dedup, minhash, risk_rules, suffix_dedup, trie_counts, winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_main_text": html_main_text.op1,
        "op2_language_id": cross_parsing.op2,
        "op3_quality_rules": risk_rules.op3,
        "op4_bpe": bpe_automaton.op4,
        "op5_suffix_dedup": suffix_dedup.op5,
        "op6_decontamination": winnowing.op6,
        "op7_quality_classifier": compression_classifier.op7,
        "op8_line_dedup": line_dedup.op8,
        "op9_near_dedup": minhash.op9,
        "op10_token_counts": trie_counts.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": risk_rules.OP3_SQL,
        "op6_decontamination": winnowing.OP6_SQL,
        "op9_near_dedup": minhash.OP9_SQL,
    }
