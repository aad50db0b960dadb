"""The registered queries of the corpus operators and the SQL that stands against them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_extract, near_dup, packing, quality, sharding, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_quality": quality.op2_quality,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_shards": sharding.op5_shards,
    "op6_packing": packing.op6_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_near_dup": near_dup.op10_near_dup,
}
SQL = {k: v for m in (decontaminate, exact_dedup, html_extract, near_dup, packing, quality, sharding, substring_dedup, token_counts, toxicity) for k, v in m.SQL.items()}
