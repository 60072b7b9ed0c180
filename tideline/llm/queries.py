"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, infill, lines, lm, mixing, neardup, quality, resampling, substrings, toxicity, urls, windows
from .common import table

#: The rank file of the byte-level BPE queries; the operator takes any path.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": lambda s, d: substrings.substring_report(table(s, d, "documents")),
        "op2_url_templates": lambda s, d: urls.url_report(table(s, d, "pages")),
        "op3_minhash_near_dedup": lambda s, d: neardup.neardup_report(table(s, d, "documents")),
        "op4_mixing": lambda s, d: mixing.mixing_report(table(s, d, "documents")),
        "op5_toxicity": lambda s, d: toxicity.toxicity_report(table(s, d, "documents"), table(s, d, "labels")),
        "op6_bpe": lambda s, d: bpe.bpe_report(table(s, d, "documents"), RANKS, public_tokenizers.PATTERN),
        "op7_gru_lm": lambda s, d: lm.lm_report(table(s, d, "documents")),
        "op8_line_dedup": lambda s, d: lines.line_report(table(s, d, "documents")),
        "op9_fingerprints": lambda s, d: fingerprints.fingerprint_report(table(s, d, "documents")),
        "op10_repetition_rules": lambda s, d: quality.quality_report(table(s, d, "documents")).drop("longest_repeat"),
        "op11_importance_resampling": lambda s, d: resampling.resampling_report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op12_fill_in_middle": lambda s, d: infill.fill_in_middle_report(table(s, d, "documents")),
        "op13_window_dedup": lambda s, d: windows.window_report(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_templates": urls.oracle(), "op3_minhash_near_dedup": neardup.oracle(), "op4_mixing": mixing.oracle(), "op8_line_dedup": lines.ORACLE, "op10_repetition_rules": quality.oracle(),
        "op11_importance_resampling": resampling.ORACLE, "op12_fill_in_middle": infill.ORACLE, "op13_window_dedup": windows.ORACLE,
    }
