"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from probity.llm import decontamination, jaccard, mixing, pii, quality, rules, secrets, substrings, tokens, urls

MODULES = {
    "op1_substring_dedup": substrings,
    "op2_pii_surrogates": pii,
    "op3_mixing": mixing,
    "op4_url_filters": urls,
    "op5_decontamination": decontamination,
    "op6_quality_classifier": quality,
    "op7_ngram_jaccard_join": jaccard,
    "op8_quality_rules": rules,
    "op9_secret_scans": secrets,
    "op10_token_counts": tokens,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in MODULES.items() if m.ORACLE}
