"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fill_in_middle, fingerprints, lattice_lm, mixing, pii, quality, simhash, substrings, token_counts, url_filters, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1,
    "op2_quality_classifier": quality.op2,
    "op3_document_fingerprints": fingerprints.op3,
    "op4_lattice_scores": lattice_lm.op4,
    "op5_substring_dedup": substrings.op5,
    "op6_source_mixing": mixing.op6,
    "op7_url_filters": url_filters.op7,
    "op8_simhash": simhash.op8,
    "op9_personal_data": pii.op9,
    "op10_benchmark_decontamination": decontaminate.op10,
    "op11_byte_bpe": bpe.op11,
    "op12_fill_in_middle": fill_in_middle.op12,
    "op13_embedding_whitening": whitening.op13,
}

SQL: dict[str, str] = {
    "op5_substring_dedup": substrings.SQL5,
    "op6_source_mixing": mixing.SQL6,
    "op7_url_filters": url_filters.SQL7,
    "op10_benchmark_decontamination": decontaminate.SQL10,
    "op12_fill_in_middle": fill_in_middle.SQL12,
}
