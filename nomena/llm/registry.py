"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, collocations, decontaminate, hard_negatives, html_extract, line_dedup, mixing, near_dups, pu_quality, quality_rules, secret_scan, sharding, substring_dedup

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_shards": sharding.op4_shards,
    "op5_ngram_jaccard": near_dups.op5_ngram_jaccard,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_quality_classifier": pu_quality.op9_quality_classifier,
    "op10_mix": mixing.op10_mix,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op6_line_dedup": line_dedup.ORACLE_OP6,
    "op7_chat_format": chat_format.ORACLE_OP7,
    "op10_mix": mixing.ORACLE_OP10,
    "op11_substring_dedup": substring_dedup.ORACLE_OP11,
    "op12_hard_negatives": hard_negatives.ORACLE_OP12,
    "op13_collocations": collocations.ORACLE_OP13,
}
