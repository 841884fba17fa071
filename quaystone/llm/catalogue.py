"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_decontaminate, op02_quality, op03_mixing, op04_html, op05_chat, op06_substrings, op07_line_rules, op08_secrets, op09_near_dedup, op10_warc, op11_simhash, op12_manifest, op13_clusters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op01_decontaminate.op1_decontaminate,
        "op2_quality": op02_quality.op2_quality,
        "op3_mixing": op03_mixing.op3_mixing,
        "op4_html": op04_html.op4_html,
        "op5_chat_format": op05_chat.op5_chat_format,
        "op6_substring_dedup": op06_substrings.op6_substring_dedup,
        "op7_line_rules": op07_line_rules.op7_line_rules,
        "op7_clean_lines": op07_line_rules.op7_clean_lines,
        "op8_secrets": op08_secrets.op8_secrets,
        "op9_near_dedup": op09_near_dedup.op9_near_dedup,
        "op10_warc": op10_warc.op10_warc,
        "op11_simhash": op11_simhash.op11_simhash,
        "op12_manifest": op12_manifest.op12_manifest,
        "op13_clusters": op13_clusters.op13_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": op01_decontaminate.ORACLE,
        "op5_chat_format": op05_chat.ORACLE,
        "op6_substring_dedup": op06_substrings.ORACLE,
        "op7_line_rules": op07_line_rules.ORACLE,
        "op9_near_dedup": op09_near_dedup.ORACLE,
        "op10_warc": op10_warc.ORACLE,
        "op12_manifest": op12_manifest.ORACLE,
        "op13_clusters": op13_clusters.ORACLE,
    }
