"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, fingerprints, html_text, line_dedup, near_dedup, packing, quality, segmentation, sharding, suffix_dedup, time_partitions, token_counts, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_packing": packing.op2_packing,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_sharding": sharding.op4_sharding,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_segmentation": segmentation.op8_segmentation,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_html_text": html_text.op10_html_text,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_time_partitions": time_partitions.op12_time_partitions,
    "op13_token_counts": token_counts.op13_token_counts,
}

ORACLES = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
}
