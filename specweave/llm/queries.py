"""The opN_ queries of this package and their SQL."""

from __future__ import annotations

from specweave.llm import license_scan, line_dedup, lm_scoring, media, mix_sources, near_dedup, packing, quality_classifier, quality_rules, substring_dedup


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_mix_sources": mix_sources.op2_mix_sources,
        "op3_lm_scoring": lm_scoring.op3_lm_scoring,
        "op4_packing": packing.op4_packing,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op6_media_chunks": media.op6_media_chunks,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.ORACLE_SQL, "op2_mix_sources": mix_sources.ORACLE_SQL}
