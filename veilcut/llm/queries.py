"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, html_extract, line_dedup, mixing, quality, simhash, substring_dedup, suffix_dedup, surrogates, warc

QUERIES = {
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op3_pii_surrogates": surrogates.op3_pii_surrogates,
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op6_warc": warc.op6_warc,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op8_quality": quality.op8_quality,
    "op7_mixing": mixing.op7_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

SQL = {
    "op6_warc": warc.OP6_SQL,
    "op8_quality": quality.OP8_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
}
