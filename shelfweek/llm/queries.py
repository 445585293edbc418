"""Queries of this subpackage and their DuckDB statements, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfweek.llm import (
    best_fit, decontaminate, divergence, html_text, importance, licenses, masked_lm, packing, quality_model, quality_rules,
    simhash, toxicity, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": quality_model.op1_quality_model,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_licenses": licenses.op6_licenses,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_masked_lm": masked_lm.op8_masked_lm,
    "op9_html_text": html_text.op9_html_text,
    "op10_packing": packing.op10_packing,
    "op11_importance": importance.op11_importance,
    "op12_best_fit": best_fit.op12_best_fit,
    "op13_divergence": divergence.op13_divergence,
}
SQL: dict[str, str] = {
    "op5_url_filter": url_filter.OP5_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
