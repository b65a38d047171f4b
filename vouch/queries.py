"""The library's queries by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vouch.plans import evaluation, extraction, fields, lifecycle, rules, screening, statements, streams

FLAGSHIP = "j1_screen_sanctions"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for family in (screening, evaluation, lifecycle, extraction, fields, rules, statements, streams):
    QUERIES |= family.Q
    ORACLES |= family.O

#: Columns whose type in DuckDB is wider than Spark's, or a decimal, with the queries that have them.
TYPES = {
    "confidence DOUBLE, rank INTEGER": "j1_screen_sanctions j1_screen_sanctions_strict j2_screen_pep",
    "sanctions_confidence DOUBLE, pep_confidence DOUBLE": "j5_screen",
    "pep_confidence DOUBLE": "a1_pep_summary",
    "criminal_risk DOUBLE, sanctions_risk DOUBLE, pep_risk DOUBLE, footprint DOUBLE": "a4_component_scores",
    "points DOUBLE": "f9_news_analysis",
    "nth INTEGER": "o5_deep_budget o2_newest p9_in_progress",
    "threshold DOUBLE": "v2_verify_pairs",
    "rank INTEGER": "v4_search_similar v4_search_threshold v4_search_top_k o1_top_k a16_method_report o4_rank_schemas o6_schemas_for o7_prioritize_required",
    "dimensions INTEGER": "v8_assert_dims",
    "asked BIGINT, agreeing BIGINT, missing BIGINT": "j12_verify_fields",
    "position INTEGER": "w8_queue_eta",
    "card DOUBLE": "a34_record_confidence",
    "frame_idx INTEGER": "w4_stable_runs",
    "first INTEGER, last INTEGER": "w5_segments",
    "line_no INTEGER, confidence DOUBLE": "f23_extract_keys",
    "line_no INTEGER": "f29_name_line_score",
    "key_block INTEGER, value_block INTEGER": "l1_spatial_pairs l2_nearby_value l3_block_below l3_block_right l4_label_value l5_nearest_in_height l11_pair_labels",
    "block_id INTEGER": "l6_classify_addresses l8_block_type",
    "block_id INTEGER, island BIGINT": "l9_expand_address",
    "group BIGINT": "w6_layout_blocks w7_merge_lines",
    "both INTEGER, either INTEGER": "u5_token_overlap",
}
for columns, names in TYPES.items():
    casts = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in (pair.rsplit(" ", 1) for pair in columns.split(", ")))
    for name in names.split():
        ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({ORACLES[name]})"
