"""The registered queries of this subpackage and their DuckDB SQL."""

from quillspark.llm import decontaminate, exact_dedup, license_scan, lm_score, merkle, mixing, ngram_join, pii, quality, spelling, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_pii": pii.op5_pii,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_lm_scoring": lm_score.op7_lm_scoring,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_quality": quality.op11_quality,
    "op12_merkle": merkle.op12_merkle,
    "op13_spelling": spelling.op13_spelling,
    "op8_license_base": license_scan.op8_license_base,
    "op10_near_matches": decontaminate.op10_near_matches,
    "op1_ngram_links": ngram_join.op1_ngram_links,
}
ORACLES = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op8_license_base": license_scan.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
