"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, langid, licenses, lines, packing, quality, repair, toxicity, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_forest": quality.op1_quality_forest,
        "op2_best_two_fit": packing.op2_best_two_fit,
        "op3_line_dedup": lines.op3_line_dedup,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_toxic_terms": toxicity.op7_toxic_terms,
        "op8_repair_tokens": repair.op8_repair_tokens,
        "op9_url_filter": urlfilter.op9_url_filter,
        "op10_language_spans": langid.op10_language_spans,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": urlfilter.ORACLE_SQL}
