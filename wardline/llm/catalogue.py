"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, html_extract, language_id, mixing, near_dedup, private_data, quality_rules, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_suffix_array_dedup": suffix_dedup.op2_suffix_array_dedup,
    "op3_private_data": private_data.op3_private_data,
    "op4_language_id": language_id.op4_language_id,
    "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_source_mixing": mixing.op10_source_mixing,
}
ORACLE_SQL = {
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op10_source_mixing": mixing.ORACLE_SQL,
}
