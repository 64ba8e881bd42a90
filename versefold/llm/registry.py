"""Queries of this subpackage, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from . import decontamination, jaccard_join, line_dedup, matroska, mixing, pii, quality, secrets, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_matroska": matroska.op4_matroska,
        "op5_quality": quality.op5_quality,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_pii": pii.op8_pii,
        "op9_secrets": secrets.op9_secrets,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.SQL, "op3_jaccard_join": jaccard_join.SQL, "op6_decontamination": decontamination.SQL, "op7_line_dedup": line_dedup.SQL}
