"""The operators of this subpackage as registered queries, and SQL that gives the same rows."""

from __future__ import annotations

from . import counting, decontamination, jaccard, language, packing, phrases, quality, resampling, rules, secrets, suffix, tokenids, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_secrets": secrets.op5_secrets,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_language": language.op7_language,
    "op8_quality": quality.op8_quality,
    "op9_token_ids": tokenids.op9_token_ids,
    "op10_packing": packing.op10_packing,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_token_counts": counting.op12_token_counts,
    "op13_phrases": phrases.op13_phrases,
}

ORACLES = {
    "op1_warc": warc.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
