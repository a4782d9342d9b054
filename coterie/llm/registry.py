"""Queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from .htmltext import op9_html_extraction
from .interactions import OP12_ORACLE, op12_filter_interactions
from .licenses import op6_license_scans
from .lm import op1_lm_scoring
from .mixing import op7_source_mixing
from .neighbours import op10_embedding_near_dedup
from .packing import op8_best_fit_packing
from .preferences import OP3_BRANCHED_ORACLE, OP3_WHOLE_ORACLE, op3_preference_formatting, op3_preference_formatting_whole
from .quality import op5_quality_rules
from .resampling import op13_importance_resampling
from .simhash import op2_simhash_near_dedup
from .urls import OP4_ORACLE, op4_url_filters
from .warc import OP11_ORACLE, op11_warc_archive

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_preference_formatting": op3_preference_formatting,
    "op3_preference_formatting_whole": op3_preference_formatting_whole,
    "op4_url_filters": op4_url_filters,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scans": op6_license_scans,
    "op7_source_mixing": op7_source_mixing,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_html_extraction": op9_html_extraction,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_warc_archive": op11_warc_archive,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op3_preference_formatting": OP3_BRANCHED_ORACLE,
    "op3_preference_formatting_whole": OP3_WHOLE_ORACLE,
    "op4_url_filters": OP4_ORACLE,
    "op11_warc_archive": OP11_ORACLE,
    "op12_filter_interactions": OP12_ORACLE,
}
