"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from inkwell.llm import ann, decontaminate, filter_audit, langid, line_dedup, lm_score, mixing, near_dup, set_join, sharding, suffix_dedup, url_filter, whitening

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_url_filters": url_filter.op2_url_filters,
    "op3_mixing": mixing.op3_mixing,
    "op4_language_id": langid.op4_language_id,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_ann": ann.op9_ann,
    "op10_sharding": sharding.op10_sharding,
    "op11_whitening": whitening.op11_whitening,
    "op12_set_join": set_join.op12_set_join,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op2_url_filters": url_filter.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op10_sharding": sharding.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
