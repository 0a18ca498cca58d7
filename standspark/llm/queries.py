"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, hmm, html, jaccard, langid, secrets, suffixes, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.query,
        "op2_toxicity": toxicity.query,
        "op3_decontamination": decontaminate.query,
        "op4_exact_topk": topk.query,
        "op5_language_id": langid.query,
        "op6_html_extract": html.query,
        "op7_bpe": bpe.query,
        "op8_lm_score": hmm.query,
        "op9_suffix_dedup": suffixes.query,
        "op10_ngram_jaccard": jaccard.query,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can express in time on whole tables; tests compare the rest with brute force."""
    return {"op4_exact_topk": topk.SQL}
